"""Repeated substrings of a length or more, found on Burrows-Wheeler transforms and removed.

Strings meet by content. Every start of a ``length``-byte string is marked with the least hash of
the grams inside its string, so equal strings carry equal marks wherever they stand. Neighbouring
starts of one mark are one run; the run's text is its context. Equal contexts of a mark are counted
together (a copy of any popularity is combined before the shuffle), and the distinct contexts of a
mark, its bucket, meet in one task.

There the contexts are joined into one text, its rotations sorted by their first bytes and its
Burrows-Wheeler transform taken. Intervals of rows that begin with one string are extended
backwards, breadth first: all strings of n bytes before any of n + 1. An extension that ends where
no shorter one did tells the common prefix of the two rows there, so common prefixes come by
increasing value, and the search stops at ``length``: rows that no value parts begin with one
string of that length. It occurs again if the rows' counts are two or more. (The first eight bytes
are read off the sorted keys, as a table of short strings would give them.)

A bucket whose distinct contexts hold over CROWD bytes, as of a popular passage in ever new surroundings, is
marked anew with longer grams, last with the whole strings, where a bucket is one string. So a task
holds buckets of bounded size, whatever the data, and nothing is dropped.

Defined results: texts are UTF-8 bytes and a null text is empty; strings never cross documents and
are judged on the input; shorter texts lose nothing; equal texts of ``length`` bytes or more lose
all bytes, repeated rows too; rows of one doc_id, or of none, are told apart by their texts; what is
left need not be UTF-8 and so is binary; a very long text is marked block by block; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import byte_texts, slices, text_key

LENGTH = 400
#: Bytes of a bucket's distinct contexts that may meet in a task.
CROWD = 1 << 20
#: Most starts in a run, and bytes of text that are marked or transformed at once.
RUN = 512
BLOCK = 1 << 19
SHARD = 1 << 19
#: Bytes that one sort key holds.
KEY = 8
SEPARATOR = 0xFF

MARKS = "f long, h long, doc_id long, text_key long, a long, b long, inner boolean"
FOUND = "f long, h long, starts array<struct<lo:long,hi:long>>"
CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def widths(length: int) -> tuple[int, ...]:
    """The grams that mark a string, level by level; the last is the string itself."""
    return (max(1, length // 4), max(1, length * 9 // 10), length)


# ---------------------------------------------------------------------- marks

@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes for each byte value, the powers of an odd base and those of its inverse."""
    rng = np.random.default_rng(11)
    values = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    return values, *(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, by scans of blocks from both sides."""
    if width == 1:
        return values
    n = len(values) - width + 1
    filled = np.full(-(-len(values) // width) * width, 2**64 - 1, np.uint64)
    filled[: len(values)] = values
    blocks = filled.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def marked_runs(held: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(f, h, a, b, inner): the runs [a, b) of starts of one mark f within the ranges [lo, hi) of starts.

    h is a hash of the run's context, the bytes a to b + length - 1. Only if ``inner``, the marking
    gram stands twice in the context, it may hold one string at two starts.
    """
    for at in range(0, len(held) - length + 1, BLOCK):
        n = min(BLOCK, len(held) - length + 1 - at)
        first, last = np.searchsorted(hi, at, "right"), np.searchsorted(lo, at + n)
        if first >= last:
            continue
        edges = np.zeros(n + 1, np.int8)
        np.add.at(edges, np.maximum(lo[first:last] - at, 0), 1)
        np.add.at(edges, np.minimum(hi[first:last] - at, n), -1)
        wanted = np.flatnonzero(np.cumsum(edges[:n]))
        if not len(wanted):
            continue
        values, powers, inverse = _tables(BLOCK + length)
        part = held[at : at + n + length - 1]
        sums = np.zeros((2, len(part) + 1), np.uint64)
        for k in (0, 1):
            np.cumsum(values[k][part] * powers[: len(part)], out=sums[k, 1:])
        grams = _mix((sums[0, width:] - sums[0, :-width]) * inverse[: len(part) - width + 1])
        window = length - width + 1
        least = least_of_windows(grams, window)
        around = np.r_[np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]
        marking = np.flatnonzero(grams == ~least_of_windows(~around, window))
        mark = least[wanted]
        new = np.flatnonzero((np.diff(wanted) != 1) | (mark[1:] != mark[:-1])) + 1
        a, b = wanted[np.r_[0, new]], wanted[np.r_[new - 1, len(wanted) - 1]] + 1
        f = mark[np.r_[0, new]]
        pieces = -(-(b - a) // RUN)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a, b, f = (np.repeat(x, pieces) for x in (a, b, f))
            a = a + nth * RUN
            b = np.minimum(b, a + RUN)
        h = _mix((sums[1, b + length - 1] - sums[1, a]) * inverse[a] + (b - a).astype(np.uint64))
        first, last = np.searchsorted(marking, a), np.searchsorted(marking, b + window - 1)
        runs = np.repeat(np.arange(len(a)), last - first)
        nth = np.arange(len(runs)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        same = grams[marking[first[runs] + nth]] == f[runs]
        yield f, h, a + at, b + at, np.bincount(runs[same], minlength=len(a)) > 1


def marks(docs: DataFrame, width: int, length: int) -> DataFrame:
    """The marked runs of every text (doc_id, text_key, text), or of its ``ranges`` of starts if there are any."""
    ranged = "ranges" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = byte_texts(batch)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begins = np.cumsum(sizes) - sizes
            if ranged:
                own = batch.column("ranges").to_pylist()
                asked = sorted({(begin + r["lo"], begin + r["hi"]) for begin, rs in zip(begins.tolist(), own, strict=True) for r in rs})
                lo, hi = np.array(asked, np.int64).reshape(-1, 2).T
            else:
                lo, hi = begins[sizes >= length], (begins + sizes - length + 1)[sizes >= length]
            held = np.frombuffer(b"".join(texts), np.uint8)
            for f, h, a, b, inner in marked_runs(held, lo, hi, width, length):
                doc = np.searchsorted(begins + sizes, a, "right")
                columns = [pa.array(f.view(np.int64)), pa.array(h.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), batch.column("text_key").take(pa.array(doc))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(a - begins[doc]), pa.array(b - begins[doc]), pa.array(inner)], [c.split()[0] for c in MARKS.split(", ")])

    return docs.mapInArrow(run, MARKS)


# ------------------------------------------------------------------ transform

def sorted_rotations(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations of a text sorted by their first ``least`` bytes or more, and their first KEY bytes."""
    n = len(text)
    around = np.resize(text, n + KEY).astype(np.uint64)
    around[n:] = np.resize(text, n + KEY)[n:]
    key = np.zeros(n, np.uint64)
    for j in range(KEY):
        key = (key << np.uint64(8)) | around[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = KEY
    while width < least:
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(tied):
            break
        items = order[tied]
        pair = rank[items] * n + rank[(items + width) % n]
        by = np.argsort(pair)
        items, pair = items[by], pair[by]
        order[tied] = items
        apart = np.r_[True, pair[1:] != pair[:-1]]
        new[tied] = apart
        rank[items] = tied[np.flatnonzero(apart)[np.cumsum(apart) - 1]]
        width *= 2
    return order, key


def parted(text: np.ndarray, order: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """For each row of the sorted rotations whether it shares fewer than ``least`` bytes with the row before.

    Breadth-first backward extension: a queue holds, for strings of the level's length, the
    intervals whose end was parted by the string's last byte; each is extended by every byte that
    stands before one of its rows.
    """
    n = len(text)
    if n < 2:
        return np.ones(n, bool)
    before = text[order - 1]
    backward = np.empty(n, np.int64)
    backward[np.argsort(before, kind="stable")] = np.arange(n)
    initial = text[order]
    differ = np.r_[np.uint64(1) << np.uint64(63), key[1:] ^ key[:-1]]
    cut = differ != 0
    edges = np.r_[np.flatnonzero(cut), n]
    ends = edges[1:-1]
    by_last = (differ[ends] >> np.uint64(8)) == 0
    lo, hi = edges[:-2][by_last], ends[by_last]
    for _ in range(KEY, least):
        if not len(lo):
            break
        sizes = hi - lo
        whose = np.repeat(np.arange(len(lo)), sizes)
        rows = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(whose))
        to = backward[rows]
        by = np.argsort(to)
        to, whose = to[by], whose[by]
        first = initial[to]
        new = np.flatnonzero((np.diff(to) != 1) | (np.diff(whose) != 0) | (first[1:] != first[:-1])) + 1
        lo, hi = to[np.r_[0, new]], to[np.r_[new - 1, len(to) - 1]] + 1
        unseen = ~np.r_[cut, True][hi]
        lo, hi = lo[unseen], hi[unseen]
        cut[hi] = True
    return cut


def repeated_starts(contexts: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges (first, last) of starts whose string occurs twice or more in all."""
    text = np.frombuffer(b"".join(c + bytes([SEPARATOR]) for c in contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    begins = np.cumsum(sizes) - sizes
    order, key = sorted_rotations(text, length)
    cut = parted(text, order, key, length)
    context = np.repeat(np.arange(len(contexts)), sizes)
    whole = np.arange(len(text)) + length < (begins + sizes)[context]
    times = np.where(whole, np.array(counts, np.int64)[context], 0)
    group = np.cumsum(cut) - cut[0]
    total = np.zeros(group[-1] + 1, np.int64)
    np.add.at(total, group, times[order])
    again = np.empty(len(text), bool)
    again[order] = total[group] >= 2
    edges = np.flatnonzero(np.diff(again & whole, prepend=False, append=False))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        of = int(context[first])
        out[of].append((first - int(begins[of]), end - 1 - int(begins[of])))
    return out


def repeated_in_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """(f, h, starts) of the contexts (f, h, times, context) that hold a repeated string; buckets of f stay together."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        starts = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
        kept = [(r[0], r[1], [{"lo": x, "hi": y} for x, y in s]) for r, s in zip(rows, starts, strict=True) if s]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate(kinds)], ["f", "h", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("f", "h", "times", "context")), strict=True):
                if rows and row[0] != rows[-1][0] and held >= SHARD:
                    yield solved(rows)
                    rows, held = [], 0
                if rows and row[:2] == rows[-1][:2]:
                    continue
                rows.append(row)
                held += len(row[3])
        if rows:
            yield solved(rows)

    return contexts.repartition("f").sortWithinPartitions("f", "h").mapInArrow(run, FOUND)


# ----------------------------------------------------------------------- jobs

def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def _joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their key; only the keys' side is held, and no text is sorted."""
    named = lists.withColumnRenamed("doc_id", "listed_id").withColumnRenamed("text_key", "listed_key").hint("shuffle_hash")
    own = _with_key(docs)
    return own.join(named, F.col("doc_id").eqNullSafe(F.col("listed_id")) & (F.col("text_key") == F.col("listed_key")), how).drop("listed_id", "listed_key")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(f, h, times, context): the texts of the wanted runs (f, h, times, doc_id, text_key, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = [
                (r["f"], r["h"], r["times"], text[r["a"] : r["b"] + length - 1])
                for text, runs in zip(byte_texts(batch), batch.column("runs").to_pylist(), strict=True)
                for r in runs
            ]
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["f", "h", "times", "context"])

    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("f", "h", "times", "a", "b")).alias("runs"))
    return _joined(docs, lists, "inner").select("text", "runs").mapInArrow(run, "f long, h long, times long, context binary")


def repeated_strings(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_key, lo, hi): ranges of starts (last included) of strings that also start elsewhere."""
    if length < KEY:
        raise ValueError(f"strings of {KEY} bytes or more are asked for")
    found, now = None, _with_key(docs)
    for level, width in enumerate(widths(length)):
        every = materialise(marks(now, width, length))
        times = every.groupBy("f").agg(F.count("*").alias("all"), F.max("inner").alias("any"))
        held = materialise(every.join(times.where("all >= 2 OR any").select("f").hint("merge"), "f", "left_semi").drop("inner"))
        firsts = [F.first(c).alias(c) for c in ("doc_id", "text_key", "a", "b")]
        contexts = materialise(held.groupBy("f", "h").agg(F.count("*").alias("times"), *firsts))
        sizes = contexts.groupBy("f").agg(F.sum(F.col("b") - F.col("a") + (length - 1)).alias("size"))
        last = level == len(widths(length)) - 1
        crowded_now = (F.col("size") > crowd) & F.lit(not last)
        sized = materialise(contexts.join(sizes.hint("merge"), "f").withColumn("crowded", crowded_now).drop("size"))
        solved = materialise(repeated_in_buckets(_contexts(docs, sized.where("NOT crowded").drop("crowded"), length), length))
        here = held.join(solved.hint("merge"), ["f", "h"]).select("doc_id", "text_key", "a", F.explode("starts").alias("s"))
        here = here.select("doc_id", "text_key", (F.col("a") + F.col("s.lo")).alias("lo"), (F.col("a") + F.col("s.hi")).alias("hi"))
        found = here if found is None else found.unionByName(here)
        crowded = sized.where("crowded").select("f").distinct()
        if last or crowded.isEmpty():
            return found
        again = held.join(crowded.hint("merge"), "f", "left_semi").groupBy("doc_id", "text_key")
        now = _joined(docs, again.agg(F.collect_set(F.struct(F.col("a").alias("lo"), F.col("b").alias("hi"))).alias("ranges")), "inner")
    raise AssertionError("the last level ends the search")


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal runs [start, end) of bytes that strings starting in the ranges cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the removed runs of bytes and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, spans, kept = byte_texts(batch), [], []
            for text, starts in zip(texts, batch.column("starts").to_pylist(), strict=True):
                gone = merged([(s["lo"], s["hi"]) for s in starts or []], length)
                bounds = [0, *(x for span in gone for x in span), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(bounds[::2], bounds[1::2], strict=True)))
                spans.append([{"start": s, "end": e} for s, e in gone])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    starts = repeated_strings(docs, length, crowd).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    return _joined(docs, starts, "left").mapInArrow(run, CUT)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what :func:`without_repeats` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: The same rule plainly: every string of every text, counted; gaps and islands of what they cover.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS nr FROM documents),
s AS (SELECT nr, unnest(range(length(h) // 2 - {LENGTH} + 1)) AS pos, h FROM d WHERE length(h) // 2 >= {LENGTH}),
k AS MATERIALIZED (SELECT nr, pos, md5(substring(h, CAST(2 * pos + 1 AS BIGINT), {2 * LENGTH})) AS key FROM s),
r AS (SELECT nr, pos FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
i AS (SELECT nr, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY nr ORDER BY pos) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT nr, pos, sum(new) OVER (PARTITION BY nr ORDER BY pos) AS island FROM i),
p AS (SELECT nr, island, min(pos) AS lo, max(pos) + {LENGTH} AS hi FROM g GROUP BY nr, island),
b AS (SELECT nr, lo, hi, coalesce(lag(hi) OVER (PARTITION BY nr ORDER BY lo), 0) AS since FROM p),
c AS (SELECT b.nr, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
        string_agg(substring(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (lo - since) AS BIGINT)), '' ORDER BY lo) AS head
      FROM b JOIN d ON b.nr = d.nr GROUP BY b.nr)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substring(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN c ON d.nr = c.nr
"""
