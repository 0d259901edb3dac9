import math
import re
from collections import defaultdict

from parcelgrid.llm import line_dedup as ld

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """{(doc_id, text): deleted line numbers} of distinct rows in order."""
    first, gone = {}, defaultdict(set)
    for key in rows:
        units = []
        for i, line in enumerate((key[1] or "").split("\n")):
            units += [(line, k, i) for k in range(math.ceil(len(WORD.findall(line)) / ld.UNIT_WORDS))]
        for s in range(len(units) - ld.RUN + 1):
            run = tuple(u[:2] for u in units[s : s + ld.RUN])
            if run in first:
                gone[key] |= set(range(units[s][2], units[s + ld.RUN - 1][2] + 1))
            first.setdefault(run, key)
    return gone


def test_equals_brute_force(spark, odd_docs):
    out = ld.dedup_lines(odd_docs).collect()
    rows = sorted({(r.doc_id, r.text) for r in odd_docs.collect()}, key=lambda k: (k[0] is not None, k[0] or 0))
    gone = brute(rows)
    assert len(out) == odd_docs.count()
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(i, t)]))
    for r in out:
        assert r.text in texts[r.doc_id]
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[9].text == "start\nend" and "shared0" in by_id[8].text
    assert by_id[7].text == "same line\n"


def test_planted_passages_go_and_short_repeats_stay(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    lines = "\n".join(f"line {i} of a run" for i in range(5))
    rows = [(i, f"own {i} words\n{passage if i % 2 else lines}\nfooter {i} line\nmore {i}\ncommon end") for i in range(200)]
    out = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("p0 p1" not in out[i].text and "of a run" not in out[i].text for i in range(2, 200))
    assert passage in out[1].text and lines in out[0].text
    assert all("common end" in r.text and f"own {i} words" in r.text for i, r in out.items())


def test_same_columns_and_empty(spark, odd_docs, no_docs):
    assert ld.dedup_lines(odd_docs).columns == [*odd_docs.columns, "deleted"]
    clash = odd_docs.withColumn("deleted", odd_docs["kept"])
    assert ld.dedup_lines(clash).columns == [*clash.columns, "deleted_"]
    assert ld.dedup_lines(no_docs).count() == 0
