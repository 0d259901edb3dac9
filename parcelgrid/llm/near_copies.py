"""Near copies by the Jaccard similarity of five-word shingles: banded MinHash, verified exactly.

A text's set holds the hashes of its word shingles; texts of one set are one node. A node signs
with the least value of each of BANDS * ROWS permutations; two nodes that agree in all ROWS values
of some band are candidates, so a pair of similarity s escapes with (1 - s^ROWS)^BANDS: 3e-6 at
0.8, less above. SimHash does not reach this: such pairs differ in up to 11 of 64 bits, for which
a covering search needs 4,095 tables.

Every link is a pair whose similarity was counted on the whole sets. Candidates are not listed pair
by pair. First each node of a bucket meets the bucket's leader, the node that meets most others over
all bands, as an original does among its copies; then, in buckets that the links so far leave apart,
the nodes outside the leader's component meet a leader of their own. What still lies apart goes
through an exact join by rare shingles: two sets of the threshold share one of their rarest shingles
(the first n - ceil(t n) + 1 in order of frequency), and far enough from the end that the rest can
still reach the overlap asked for. Texts of one template that differ by more than the threshold
allows begin with shingles of their own, so they meet nobody, however many there are; only where copies of one template without its original
lie just beyond the threshold (as 2 words of 100) do they still meet by a shingle that most of them
hold. Pairs of one component are never looked at again.

Defined results: words are separated by ASCII white space, ASCII letters in lower case; fewer
words than a shingle make one shingle of them all; blank and null texts have one set; a null
doc_id never names a component unless it stands alone (then null); an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parcelgrid.sources.tables import materialise

from . import simhash
from .components import components
from .rows import byte_texts, fresh, slices, text_key

SHINGLE = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 5
BLOCK = 1 << 12
#: One odd factor for each permutation of the 64-bit hashes.
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LINKS = "a long, b long"


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    blocks = list(simhash.shingle_hashes(text, shingle)) or [np.array([xxh64_intdigest(b"", simhash.SEED)], "<u8")]
    return np.unique(np.concatenate(blocks))


def signature(held: np.ndarray) -> np.ndarray:
    """The least value of every permutation."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for s in range(0, len(held), BLOCK):
        mixed = held[s : s + BLOCK]
        np.minimum(least, (FACTORS[:, None] * (mixed ^ (mixed >> np.uint64(31)))[None, :]).min(axis=1), out=least)
    return least


def _node(held: np.ndarray) -> int:
    return xxh64_intdigest(held.tobytes(), simhash.SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, n, bands): the size of the node's set and a hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t) for t in byte_texts(batch)]
            bands = [
                np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(signature(s).reshape(BANDS, ROWS))], np.uint64).view(np.int64)
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), _signed([_node(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "n", "bands"],
            )

    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, text_key long, node long, n long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the rows of ``docs`` that ``wanted`` (doc_id, text_key) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [_signed([_node(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"]
            )

    a, b = (fresh(docs, n) for n in ("wanted_id", "wanted_key"))
    named = wanted.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).hint("shuffle_hash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("own_key", text_key())
    held = own.join(named, F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("own_key") == F.col(b)), "left_semi")
    return held.select("text").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are at least so similar."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes")).where(
        F.col("shared") / (F.col("sizes") - F.col("shared")) >= threshold
    ).select("a", "b")


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) of nodes (node, n) with their bucket's ``leader`` whose sizes allow the threshold."""
    near = F.least("n", "leader.n") >= threshold * F.greatest("n", "leader.n")
    rows = rows.where("node <> leader.node").where(near)
    return rows.select(F.greatest("node", "leader.node").alias("a"), F.least("node", "leader.node").alias("b")).distinct()


def _led(met: DataFrame) -> DataFrame:
    """Rows (band, cell, node, n, weight, ...) with their bucket's leader."""
    best = met.groupBy("band", "cell").agg(F.max(F.struct("weight", "node", *[c for c in ("n", "root") if c in met.columns])).alias("leader"))
    return met.join(best, ["band", "cell"])


def _placed(met: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the root of their node's component."""
    roots = components(links).toDF("node", "found")
    return met.join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")


def by_rare_shingles(apart: DataFrame, sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Distinct (a, b): a superset of the pairs of nodes (node, n, root) at the threshold with different roots.

    Frequencies are those among these nodes; a shingle that one of them holds alone comes first and
    meets nothing, so only the others are ranked.
    """
    held = materialise(apart.join(sets, "node").select("node", "n", "root", F.explode("hashes").alias("token")))
    known = held.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("df > 1")
    ranked = held.join(known.select("token", "df", (F.col("lo") != F.col("hi")).alias("joins")), "token").groupBy("node", "n", "root").agg(
        F.sort_array(F.collect_list(F.struct("df", "token", "joins"))).alias("common")
    )
    alone = F.col("n") - F.size("common")
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - F.col("alone")
    rows = ranked.withColumn("alone", alone).where(first > 0).withColumn("first", F.slice("common", F.lit(1), first.cast("int")))
    rows = rows.select("node", "n", "root", "alone", F.posexplode("first").alias("at", "s")).where("s.joins")
    rows = materialise(rows.select("node", "n", "root", F.col("s.token").alias("token"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest")))
    left, right = (rows.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "root", "rest")]) for k in "ab")
    reach = F.least("rest_a", "rest_b") * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    both = left.join(right, (left["token"] == right["token"]) & (F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near & reach)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(a, b) over nodes (node, n, bands, doc_id, text_key): verified pairs that connect what all pairs at the threshold connect."""
    cells = nodes.select("node", "n", F.posexplode("bands").alias("band", "cell"))
    crowds = cells.groupBy("band", "cell").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(cells.join(crowds, ["band", "cell"]))
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    met = materialise(shared.drop("size").join(weights, "node"))
    rows = nodes.join(met.select("node").distinct(), "node", "left_semi").select("doc_id", "text_key")
    sets = materialise(sets_of(docs, rows))
    found = materialise(similar(_pairs(_led(met), threshold), sets, threshold))
    placed = materialise(_placed(met, found))
    others = _led(placed).where("root <> leader.root").drop("leader")
    found = materialise(found.union(similar(_pairs(_led(others), threshold), sets, threshold)))
    placed = materialise(_placed(met, found))
    split = placed.groupBy("band", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    apart = materialise(placed.join(split, ["band", "cell"], "left_semi").select("node", "n", "root").distinct())
    return found.union(materialise(similar(by_rare_shingles(apart, sets, threshold), sets, threshold)))


def group_links(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): a star over the nodes of every group (doc_id, text_key, root) of rows; ``own`` has (doc_id, text_key, node)."""
    named = groups.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "root").distinct()
    rows = own.select("doc_id", "text_key", "node").distinct()
    held = materialise(rows.join(named, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))).select("root", "node").distinct())
    least = held.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("size")).where("size > 1")
    return held.join(least, "root").select(F.col("node").alias("a"), "b").where("a <> b")


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, component_id) for every row of ``docs``.

    ``groups`` has (doc_id, text_key, root) of every row, as :func:`simhash.near_duplicates` gives
    them: rows of one root belong together as well, so a component is joined by links of both kinds.
    """
    own = materialise(signed(docs))
    some = [F.first(c).alias(c) for c in ("n", "bands", "doc_id", "text_key")]
    nodes = materialise(own.groupBy("node").agg(F.min("doc_id").alias("least_id"), *some))
    linked = links(docs, nodes, threshold)
    if groups is not None:
        linked = linked.union(group_links(own, groups))
    roots = components(linked).toDF("node", "root")
    rooted = nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = materialise(rooted.join(named, "root").select("node", "component_id"))
    return own.join(names, "node").select("doc_id", "text_key", "component_id")


def keep_one(docs: DataFrame, threshold: float = SIMILAR, groups: DataFrame | None = None) -> DataFrame:
    """One row of every group of near copies, as :func:`simhash.keep_one` chooses it."""
    return simhash.keep_one(docs, near_duplicates(docs, threshold, groups))
