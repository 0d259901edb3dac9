"""Web archives by index first: where each record is, then coalesced reads of what is wanted.

Writing: every page becomes one gzip member of an archive file, its payload the page's UTF-8.
Of pages with equal payloads of at least ``least_bytes`` the one with the largest page_id is the
response; the others are revisit records that name it and hold HTTP headers only. Each task
writes archives of its own in the given folder, which all executors reach, and returns one index
row for each record: archive, offset, length, url and digest. The index is written as a table. A
task that runs again writes new files, and only those of the attempt that counted are in the
index.

Reading: the wanted index rows are sorted by archive and offset and dealt out in ranges; a task
joins neighbours with small gaps into one read of a bounded size, and cuts the records out of it.
Responses are checked against their digest.

Payload digests decide who is the response, in an aggregation over digests and a join of digests
without payloads, so that a payload with a third of all pages is one row on one side; payloads
are shuffled once, by page_id.

Defined results: a null html is an empty payload; a null url is written as urn:page:<page_id>; a
null page_id is always a response; repeated rows (page_id and payload) get a record each, of one
type; an empty table gives an empty index and no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise, scratch_folder

ARCHIVE_BYTES = 256 << 20
GAP = 64 << 10
READ_BYTES = 8 << 20
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed; ``refers_to`` is None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = f"urn:page:{page_id}" if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}


def decode(record: bytes) -> tuple:
    """A row of RECORD; raises if a response's payload does not have the digest it names."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    page = int(warc["x-page-id"]) if warc["x-page-id"] else None
    if warc["warc-type"] == "revisit":
        return page, warc["warc-target-uri"], "revisit", int(warc["x-refers-to-page"]), size, digest, None
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the record of page {page} is damaged")
    return page, warc["warc-target-uri"], "response", None, size, digest, payload


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to (null for responses) of every page."""
    own = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    light = own.select("page_id", "sha1", F.octet_length("payload").alias("size")).where(
        (F.col("size") >= least_bytes) & F.col("page_id").isNotNull()
    )
    last = light.groupBy("sha1").agg(F.max("page_id").alias("refers_to"))
    revisits = light.join(last, "sha1").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()
    return own.join(revisits, ["page_id", "sha1"], "left")


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes the archives into ``folder`` (a URI that all executors reach) and returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for page, sha1, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "sha1", "url", "payload", "refers_to")), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(encode(page, url, payload, digest, refers_to, date)) + packer.flush()
                out.write(member)
                rows.append((page, name, at, len(member), url, digest))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema, preserve_index=False)
        if out is not None:
            out.close()

    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return materialise(with_types(pages, least_bytes).mapInArrow(run, INDEX))


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Which records (first, after last) of one archive to read at once; offsets ascend."""
    out, first = [], 0
    for i in range(1, len(offsets) + 1):
        if (
            i == len(offsets)
            or offsets[i] - offsets[i - 1] - lengths[i - 1] > gap
            or offsets[i] + lengths[i] - offsets[first] > most
        ):
            out.append((first, i))
            first = i
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORD.split(", ")]
        for frame in frames:
            for archive, own in frame.groupby("archive", sort=False):
                offsets, lengths = own["offset"].tolist(), own["length"].tolist()
                with system.open_input_file(f"{root}/{archive}") as held:
                    for first, last in ranges(offsets, lengths):
                        start = offsets[first]
                        block = held.read_at(offsets[last - 1] + lengths[last - 1] - start, start)
                        rows = [
                            decode(zlib.decompress(block[offsets[i] - start : offsets[i] - start + lengths[i]], 31))
                            for i in range(first, last)
                        ]
                        out = pd.DataFrame(rows, columns=names)
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = index.select("archive", "offset", "length").repartitionByRange("archive", "offset")
    return dealt.sortWithinPartitions("archive", "offset").mapInPandas(run, RECORD)


def archive_folder(pages: DataFrame) -> str:
    """A new folder below the session's shared one, as a URI of the default file system if it names none."""
    spark = pages.sparkSession
    shared = scratch_folder(spark).rstrip("/")
    if "://" not in shared:
        store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")
        shared = ("file://" if store == "file:" else store) + shared
    return f"{shared}/warc-{uuid.uuid4().hex}"


#: The same over tables without null or repeated page_ids, as what query op6 returns.
SQL = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages
), bits AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1, CAST(CAST(unhex(sha1) AS BIT) AS VARCHAR) AS b FROM own
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * (substr(b, 5 * i + 1, 1) = '1')::INT + 8 * (substr(b, 5 * i + 2, 1) = '1')::INT + 4 * (substr(b, 5 * i + 3, 1) = '1')::INT
    + 2 * (substr(b, 5 * i + 4, 1) = '1')::INT + (substr(b, 5 * i + 5, 1) = '1')::INT AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY sha1) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY sha1) THEN max(page_id) OVER (PARTITION BY sha1) END AS refers_to
FROM bits
"""
