import base64
import gzip
import hashlib
import os
from collections import Counter

from pyspark.sql import functions as F

from parcelgrid.llm import warc

ROWS = [
    (1, "http://a.example/x y\r\nInjected: 1", "<p>same</p>", "c"), (2, None, "<p>same</p>", "c"), (3, "http://b", None, "c"), (4, "http://c", "", "c"),
    (5, "http://d", "\r\n\r\nWARC/1.1 é\U0001f600 \x00", "c"), (None, "http://e", "<p>same</p>", "c"), (6, "u", "big " * 300_000, "c"),
    (7, "r", "repeated row", "c"), (7, "r", "repeated row", "c"), (8, "r", "repeated row", "c"),
]
SCHEMA = "page_id long, url string, html string, offset string"


def expect(rows, least=0):
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = Counter()
    for i, _, h, _ in rows:
        payload = (h or "").encode()
        to = last[h or ""] if i is not None and len(payload) >= least and last[h or ""] != i else None
        out[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if to is not None else "response", to)] += 1
    return out


def read_back(index, folder):
    rows = warc.read_records(index, folder).collect()
    return rows, Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for least, size in ((0, 1 << 30), (5, 2000)):
        folder = f"file://{tmp_path}/{least}"
        index = warc.write_archives(pages, folder, least, archive_bytes=size)
        rows, got = read_back(index, folder)
        assert got == expect(ROWS, least)
        assert Counter((r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response") <= Counter((i, (h or "").encode()) for i, _, h, _ in ROWS)
        # plain gzip tools read an archive from one end to the other
        files = os.listdir(f"{tmp_path}/{least}")
        text = b"".join(gzip.open(f"{tmp_path}/{least}/{f}").read() for f in files)
        assert text.count(b"WARC/1.1\r\n") == len(ROWS) and b"\r\nInjected" not in text


def test_selected_records_only(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    index = warc.write_archives(pages, f"file://{tmp_path}")
    rows, _ = read_back(index.where(F.col("page_id").isin(3, 5)), f"file://{tmp_path}")
    assert sorted(r.page_id for r in rows) == [3, 5]


def test_ranges():
    assert warc.ranges([0, 10, 20, 500], [10, 10, 10, 5], gap=5, most=100) == [(0, 3), (3, 4)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=5, most=20) == [(0, 2), (2, 3)]
    assert warc.ranges([0], [10**9]) == [(0, 1)]
    assert warc.ranges([], []) == []


def test_empty(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert index.count() == 0 and warc.read_records(index, f"file://{tmp_path}/none").count() == 0
