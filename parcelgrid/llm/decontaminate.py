"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Looks for test items of which at least ``threshold`` of the distinct five-word shingles occur in a
document. Words are runs of ASCII letters and digits and of all other non-ASCII characters, in
lower case; an item of fewer words is one shingle, which any document that holds these words in
a row contains.

MinHash compares sets of like size, so documents are partitioned by their number of distinct
shingles: class c holds up to 2^c of them and signs with 2^c * BINS bins, each keeping the least
hash that falls in it (one permutation). An item signs the same way for every class that could
hold it; sharing one bin's minimum makes a candidate. With BINS = 4 a shared shingle is its bin's
minimum with a probability of at least 0.88, so an item of n shingles escapes with at most
0.12 ^ (threshold * n): 1e-11 for 16 of them. Smaller items are looked up by all their shingles.

A document signs only if it holds a shingle of any item at all, told by a bit array of a fixed
size (2^BIT_POWER bits, one megabyte) that is broadcast. It is built by an aggregation, only
passes too much if there are very many items, and never loses one. Candidates bring the text of
their matching shingles, and containment is counted on those texts, never on hashes.

Defined results: a null or wordless text contains nothing and a null or wordless item is
contained in nothing; repeated rows count as one document; items of equal item_id are one item
with the shingles of all and those without an id are left out; null doc_ids are passed on; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import slices, text_key, without

SHINGLE = 5
THRESHOLD = 0.8
BINS = 4
SMALL = 16
BIT_POWER = 23

ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
BYTE_HASH = _mix(np.arange(1, 257, dtype=np.uint64) * ODD)
PLACE = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * STEP) | np.uint64(1)


class Words:
    """The words of a text: where they start and end in its lower-case UTF-8, and their hashes."""

    def __init__(self, text: bytes, block: int = 1 << 20) -> None:
        self.text = text
        held = np.frombuffer(text, np.uint8)
        inside = WORD_BYTE[held]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        parts, first = [], 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + block)))
            starts, sizes = self.starts[first:last], self.ends[first:last] - self.starts[first:last]
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            letters = held[np.repeat(starts, sizes) + place]
            powers = np.cumprod(np.full(int(sizes.max()), STEP, np.uint64))
            parts.append(_mix(np.add.reduceat(BYTE_HASH[letters] * powers[place], np.cumsum(sizes) - sizes)))
            first = last
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def shingles(self, width: int) -> np.ndarray:
        """The hash of every run of ``width`` words."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            total += self.hashes[k : k + n] * PLACE[k]
        return _mix(total)

    def run(self, first: int, width: int) -> bytes:
        at = slice(first, first + width)
        return b" ".join(self.text[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True))


def lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").lower().encode() for x in batch.column("text").to_pylist()]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, width, hash, words): the distinct shingles of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), lowered(batch), strict=True):
                words = Words(text)
                width = min(SHINGLE, len(words))
                if width:
                    hashes = words.shingles(width).view(np.int64).tolist()
                    rows += {(item, width, h, words.run(i, width).decode()) for i, h in enumerate(hashes)}
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "width", "hash", "words"])

    own = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "item_id long, width int, hash long, words string").distinct()


def bit_array(shingles: DataFrame) -> np.ndarray:
    """One bit for each shingle, in 64-bit words. At most 2^BIT_POWER / 64 rows come to the driver."""
    slot = F.shiftrightunsigned(F.col("hash"), 64 - BIT_POWER)
    rows = (
        shingles.select(F.shiftright(slot, 6).alias("at"), (slot % 64).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (BIT_POWER - 6), np.int64)
    for r in rows:
        bits[r["at"]] = r["bits"]
    return bits.view(np.uint64)


def _class(n: int) -> int:
    """c for sets of more than 2^(c-1) and up to 2^c shingles."""
    return max(0, (n - 1).bit_length())


def _bin(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """The bin of each hash for a size class; the low bits, as the bit array takes the high ones."""
    return hashes & np.uint64((BINS << size_class) - 1)


def _minima(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """The least hash of every bin; ``hashes`` ascend."""
    return hashes[np.unique(_bin(hashes, size_class), return_index=True)[1]]


def item_signatures(shingles: DataFrame, classes: int = 40) -> DataFrame:
    """(item_id, hash, size_class): an item's bin minima for every class of documents.

    A small item has all its shingles for all classes, told by the class -1. A shingle that is
    its bin's minimum from some class on stays so in larger ones, so only its first is kept.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.unique(frame["hash"].to_numpy(np.int64).view(np.uint64))
        first = np.full(len(hashes), classes, np.int32)
        if len(hashes) < SMALL:
            first[:] = -1
        else:
            for c in range(classes - 1, -1, -1):
                first[np.isin(hashes, _minima(hashes, c))] = c
        return pd.DataFrame({"item_id": key[0], "hash": hashes.view(np.int64), "size_class": first})

    return shingles.select("item_id", "hash").groupBy("item_id").applyInPandas(run, "item_id long, hash long, size_class int")


def matches(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(doc_id, text_key, hash, size_class, words): shingles of documents that some item may hold.

    size_class is the document's where the shingle is its bin's minimum, else null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    shift, low = np.uint64(64 - BIT_POWER), np.uint64(63)

    def passed(hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> shift
        return np.flatnonzero((shared.value[slot >> np.uint64(6)] >> (slot & low)) & np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for i, text in enumerate(lowered(batch)):
                words = Words(text)
                for width in widths:
                    hashes = words.shingles(width)
                    at = passed(hashes)
                    if not len(at):
                        continue
                    distinct = np.unique(hashes)
                    size_class = _class(len(distinct))
                    found, first = np.unique(hashes[at], return_index=True)
                    least = np.isin(found, _minima(distinct, size_class))
                    for s in range(0, len(found), 50_000):
                        part = slice(s, s + 50_000)
                        n = len(found[part])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(batch.column("doc_id").slice(i, 1).to_pylist() * n, pa.int64()),
                                pa.array(batch.column("text_key").slice(i, 1).to_pylist() * n, pa.int64()),
                                _signed(found[part]),
                                pa.array([size_class if x else None for x in least[part].tolist()], pa.int32()),
                                pa.array([words.run(int(k), width).decode() for k in at[first[part]].tolist()]),
                            ],
                            ["doc_id", "text_key", "hash", "size_class", "words"],
                        )

    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, text_key long, hash long, size_class int, words string")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_shingles, containment) of every document and item at the threshold."""
    shingles = materialise(item_shingles(items))
    signatures = materialise(item_signatures(shingles))
    sizes = shingles.groupBy("item_id").agg(F.countDistinct("words").alias("n_shingles"))
    widths = [r["width"] for r in shingles.select("width").distinct().orderBy("width").collect()]  # at most SHINGLE
    found = materialise(matches(docs, bit_array(shingles), widths))
    doc = ["doc_id", "text_key"]
    candidates = (
        found.join(signatures.withColumnRenamed("size_class", "from_class"), "hash")
        .where("from_class = -1 OR size_class >= from_class")
        .select(*doc, "item_id")
        .distinct()
    )
    shared = (
        found.select(*doc, "words")
        .join(shingles.select("item_id", "words").distinct(), "words")
        .groupBy(*doc, "item_id")
        .agg(F.countDistinct("words").alias("n_shared"))
    )
    keyed = candidates.toDF("c_id", "c_key", "c_item")
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")) & (F.col("item_id") == F.col("c_item"))
    held = shared.join(sizes, "item_id").where(F.col("n_shared") >= threshold * F.col("n_shingles"))
    return held.join(keyed, same, "left_semi").select(
        *doc, "item_id", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment")
    )


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return without(docs, materialise(contaminated(docs, items, threshold).select("doc_id", "text_key")))


#: The same as what query op7 returns.
SQL = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), items AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM (SELECT *, least({SHINGLE}, len(w)) AS k FROM item_words WHERE len(w) > 0) q
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS w FROM documents
), docs AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT k FROM items) widths
)
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment FROM (
  SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (k, s) GROUP BY ALL) x
JOIN (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY 1) n USING (item_id)
WHERE n_shared >= {THRESHOLD} * n_shingles
"""
