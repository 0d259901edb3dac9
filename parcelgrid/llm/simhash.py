"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Two
fingerprints link if they differ in at most ``radius`` bits.

Covering (structured masks instead of sampled ones): every bit position i gets a non-zero vector
m(i) of radius + 1 bits; for every non-zero v, table v keeps the bits with an odd m(i)·v. At most
``radius`` vectors leave some v orthogonal to all of them, so a pair within the radius agrees on
all bits that table v keeps: it collides there with certainty. A fingerprint that meets no other
in any of the 2^(radius+1) - 1 tables has no link and goes no further.

Within a crowded table pairs are not listed. Two fingerprints differ in at most two bits exactly
if some value is at most one flipped bit from both, so the colliding ones are grouped by those
65 values. A group holds at most 65 distinct fingerprints, whatever the data, all within two bits
of each other; it gives a star of links instead of all pairs.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of them all; equal texts share a fingerprint and so a component;
repeated rows are all returned; a null doc_id never names a component unless it stands alone
(then null); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parcelgrid.sources.tables import materialise

from .components import components
from .rows import byte_texts, fresh, slices, text_key, without

BITS = 64
SEED = 42
BLOCK = 1 << 15


def shingle_hashes(text: bytes, shingle: int = 3) -> Iterator[np.ndarray]:
    """In blocks, the hash of every run of ``shingle`` words, or of all if there are fewer; no words have none."""
    words = text.lower().split()
    if not words:
        return
    width = min(shingle, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        hashes = [
            xxh64_intdigest(joined[s:e], SEED)
            for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        ]
        yield np.array(hashes, "<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    set_bits, count = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * set_bits > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(batch)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"]
            )

    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, text_key long, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each covering table keeps, as signed longs."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    kept = [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))
    ]
    return np.array(kept, np.uint64).view(np.int64).tolist()


def colliding(fps: DataFrame, radius: int) -> DataFrame:
    """The distinct fingerprints that meet another one in some covering table."""
    cells = [F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for v, m in enumerate(masks(radius))]
    rows = fps.select("fp", F.explode(F.array(*cells)).alias("cell")).select("fp", "cell.*")
    shared = rows.groupBy("v", "kept").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    return rows.join(shared, ["v", "kept"], "left_semi").select("fp").distinct()


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) over distinct fingerprints: stars that connect exactly what pairs within the radius connect."""
    if radius != 2:
        raise ValueError("the exact grouping by flipped bits is written for a radius of two bits")
    flips = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64)).view(np.int64).tolist()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])
    groups = (
        colliding(fps, radius)
        .select("fp", F.explode(near).alias("near"))
        .groupBy("near")
        .agg(F.min("fp").alias("b"), F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    return groups.select(F.explode("members").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) for every row of ``docs``; root is the least fingerprint of the component."""
    own = materialise(fingerprints(docs, shingle))
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = materialise(rooted.join(named, "root").select("fp", "component_id", "root"))
    return own.join(names, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of every group of near copies: the one with the component's doc_id.

    ``found`` has (doc_id, text_key, component_id) of every row, by default those of near_duplicates.

    Of rows that share that doc_id, the one with the least text_key stays, and of repeated rows
    with one doc_id and text any one.
    """
    found = near_duplicates(docs) if found is None else found
    keys = materialise(found.groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("times")))
    best = keys.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")
    )
    stays = best.select("best.doc_id", "best.text_key")
    gone = materialise(keys.select("doc_id", "text_key").subtract(stays))
    rest = without(docs, gone)
    repeated = materialise(keys.where("times > 1").select("doc_id", "text_key"))
    if repeated.isEmpty():
        return rest
    key = fresh(docs, "own_key")
    alone = without(rest, repeated)
    again = without(rest, materialise(keys.where("times = 1").select("doc_id", "text_key")))
    again = again.withColumn(key, text_key()).dropDuplicates(["doc_id", key]).drop(key)
    return alone.unionByName(again)
