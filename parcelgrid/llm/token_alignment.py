"""Tokens of two tokenizers on the same text, aligned by their bytes.

Every text is a blank and the text, as both tokenizers see it. Each token covers a range of those
bytes. Per batch of documents, ``pandas.merge_asof`` keyed by document finds for the start of every
token the other side's token that covers it, in both directions; the union of the two is exactly
the pairs whose ranges overlap, since of two overlapping ranges one begins inside the other. Ends
that both sides share cut the tokens into groups.

How many documents link an id pair is counted over the corpus. A task works on blocks of documents;
a block lists its distinct pairs once with their document counts, and its documents refer to that
list. Only the lists meet in the shuffle; they come back with the corpus-wide counts to the block's
documents, one block at a time, so neither a broadcast nor a task grows with the number of pairs.

Defined results: a text that is null, empty, or that a tokenizer does not give back byte by byte
(a normaliser changed it) has no tokens, zeros and an empty digest; repeated rows are aligned and
counted each; a null doc_id is passed on; ties for an id's most frequent partner all count; a very
long text is one block by itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import slices

#: Bytes of text that are aligned at once, and that make a block.
PART = 1 << 20
BLOCK = 8 << 20
ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string,"
    " at array<int>, times array<int>, pairs array<long>, docs array<long>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def _numbers(ids: int, end: bytes) -> np.ndarray:
    """For each id its decimal text and ``end``."""
    return np.array([b"%d%s" % (i, end) for i in range(ids)], object)


class Side:
    """A tokenizer's ids and their bytes."""

    def __init__(self, spellings: list[bytes], last: bytes) -> None:
        self.spellings = spellings
        self.sizes = np.array([len(s) for s in spellings], np.int64)
        self.inner, self.last = _numbers(len(spellings), b","), _numbers(len(spellings), last)

    def exact(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.spellings.__getitem__, ids)) == text


#: White space in such a run is split by recursion where ranks are used, so the whole tokenizer takes these texts.
LONG_BLANK = re.compile(r"\s{2000}")


class BytePairs(Side):
    """Byte-level BPE: a tokenizer's file, and the same vocabulary as ranks, which encodes faster and spells every id."""

    def __init__(self, whole: str, ranked: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(whole)
        self.whole.encode_special_tokens = True
        with open(ranked, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        spellings = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spellings[rank] = token
        super().__init__(spellings, b"|")
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self.whole.encode(" " + t, add_special_tokens=False).ids if LONG_BLANK.search(t) else self.encoding.encode_ordinary(" " + t)
            for t in texts
        ]


class Pieces(Side):
    """Pieces with byte fallback, which put the blank before the text themselves."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        super().__init__(
            [bytes([int(x[3:5], 16)]) if self.processor.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)], b";"
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Files(NamedTuple):
    """Where the two tokenizers are; ``whole`` and ``ranks`` hold the same one, ``pattern`` splits its words."""

    whole: str
    ranks: str
    pattern: str
    pieces: str


@cache
def sides(files: Files) -> tuple[BytePairs, Pieces]:
    return BytePairs(files.whole, files.ranks, files.pattern), Pieces(files.pieces)


def linked(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (doc, start) of the tokens that overlap; both ascend by start over all documents."""
    a, b = a.assign(a=np.arange(len(a)), a_start=a["start"]), b.assign(b=np.arange(len(b)))
    forth = pd.merge_asof(a, b, on="start", by="doc")
    back = pd.merge_asof(b, a, on="start", by="doc")
    back = back[back["a_start"] != back["start"]]
    return np.r_[forth["a"].to_numpy(), back["a"].to_numpy()], np.r_[forth["b"].to_numpy(), back["b"].to_numpy()]


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both sides share, and the group of every token."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def spelled(side_a: Side, ids_a: np.ndarray, groups_a: np.ndarray, side_b: Side, ids_b: np.ndarray, groups_b: np.ndarray) -> np.ndarray:
    """``a1,a2|b1;a3|`` and so on, one entry per token in order; the last entry of a document ends in a semicolon."""
    words = []
    for side, ids, groups in ((side_a, ids_a, groups_a), (side_b, ids_b, groups_b)):
        ends = np.r_[groups[1:] != groups[:-1], True][: len(ids)]
        words.append(np.where(ends, side.last[ids], side.inner[ids]))
    return np.concatenate(words)[np.argsort(np.r_[2 * groups_a, 2 * groups_b + 1], kind="stable")]


class Part:
    """The aligned documents of a batch of texts."""

    def __init__(self, a: Side, b: Side, texts: list[str | None]) -> None:
        n = len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        held = [" ".encode() + texts[i].encode() for i in asked]
        ids = [side.encode([texts[i] for i in asked]) for side in (a, b)]
        good = [k for k in range(len(asked)) if a.exact(ids[0][k], held[k]) and b.exact(ids[1][k], held[k])]
        docs = np.array([asked[k] for k in good], np.int64)
        sizes = np.array([len(held[k]) for k in good], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.n = [np.zeros(n, np.int64) for _ in range(4)]
        self.groups = [""] * n
        self.digests = [""] * n
        self.pairs = self.doc = self.times = np.zeros(0, np.int64)
        if not good:
            return
        flat, frames, ends, whose = [], [], [], []
        for side, own, count in ((a, ids[0], self.n[0]), (b, ids[1], self.n[1])):
            numbers = np.array([len(own[k]) for k in good], np.int64)
            count[docs] = numbers
            flat.append(np.fromiter((x for k in good for x in own[k]), np.int64, numbers.sum()))
            whose.append(np.repeat(np.arange(len(good)), numbers))
            ends.append(np.cumsum(side.sizes[flat[-1]]))
            frames.append(pd.DataFrame({"doc": whose[-1], "start": ends[-1] - side.sizes[flat[-1]]}))
        common, group_a, group_b = grouped(*ends)
        self.n[2][docs] = np.diff(np.searchsorted(common, np.r_[begins, sizes.sum()], "right"))
        words = spelled(a, flat[0], group_a, b, flat[1], group_b).tolist()
        bounds = np.r_[0, np.cumsum(self.n[0][docs] + self.n[1][docs])].tolist()
        for k, doc in enumerate(docs.tolist()):
            text = b"".join(words[bounds[k] : bounds[k + 1]])[:-1]
            self.groups[doc] = text.decode()
            self.digests[doc] = hashlib.sha256(text).hexdigest()
        at_a, at_b = linked(*frames)
        of = whose[0][at_a]
        self.n[3][docs] = np.bincount(of, minlength=len(good))
        width = len(a.sizes) * len(b.sizes)
        key = of * width + flat[0][at_a] * len(b.sizes) + flat[1][at_b]
        key, self.times = np.unique(key, return_counts=True)
        self.doc, self.pairs = docs[key // width], key % width


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _block(block: int, ids: list[pa.Array], parts: list[Part], with_groups: bool) -> pa.RecordBatch:
    """The documents' rows, and a last one with the distinct pairs and the documents that hold each."""
    distinct, at = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    docs = np.bincount(at, minlength=len(distinct)).astype(np.int64)
    n = sum(len(p.groups) for p in parts)
    sizes = np.concatenate([np.bincount(p.doc, minlength=len(p.groups)) for p in parts])
    times = np.concatenate([p.times for p in parts])
    empty = np.zeros(n, np.int64)
    blank = pa.nulls(n, pa.string())
    columns = {
        "block": pa.array(np.full(n + 1, block)),
        "doc_id": pa.concat_arrays([*ids, pa.nulls(1, pa.int64())]),
        **{c: pa.array(np.r_[np.concatenate([p.n[k] for p in parts]), 0]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups": pa.concat_arrays([pa.array([g for p in parts for g in p.groups], pa.string()) if with_groups else blank, pa.nulls(1, pa.string())]),
        "groups_sha256": pa.array([d for p in parts for d in p.digests] + [None], pa.string()),
        "at": _lists(at.astype(np.int32), np.r_[sizes, 0]),
        "times": _lists(times.astype(np.int32), np.r_[sizes, 0]),
        "pairs": _lists(distinct, np.r_[empty, len(distinct)]),
        "docs": _lists(docs, np.r_[empty, len(distinct)]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def aligned(docs: DataFrame, files: Files, with_groups: bool = False) -> DataFrame:
    """Every document aligned, by blocks; a block's last row (groups_sha256 is null) lists its pairs.

    ``at`` are places in that list, ``times`` how often the document links the pair. A pair is
    a * (ids of b) + b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(files)
        block, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in slices([batch], "text", PART):
                ids.append(part.column("doc_id"))
                parts.append(Part(a, b, part.column("text").to_pylist()))
                held += part.column("text").nbytes
                if held >= BLOCK:
                    yield _block(block, ids, parts, with_groups)
                    block, ids, parts, held = block + 1, [], [], 0
        if parts:
            yield _block(block, ids, parts, with_groups)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, ALIGNED)


def pair_counts(held: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): the documents that link an id pair, and whether no partner of its first id has more."""
    listed = held.where("groups_sha256 IS NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = materialise(listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))
    id_a = F.expr(f"pair DIV {ids_b}")
    most = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", id_a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(docs: DataFrame, files: Files, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) of every document."""
    held = materialise(aligned(docs, files, with_groups))
    ids_b = len(sides(files)[1].sizes)
    listed = held.where("groups_sha256 IS NULL").select(F.col("block").alias("listed"), F.posexplode("pairs").alias("at", "pair"))
    priced = listed.join(pair_counts(held, ids_b), "pair").select("listed", "at", "n", "best")
    rows = held.where("groups_sha256 IS NOT NULL").drop("pairs", "docs")

    def run(own: pa.Table, prices: pa.Table) -> pa.Table:
        number, best = np.zeros(prices.num_rows, np.int64), np.zeros(prices.num_rows, np.int64)
        at = prices["at"].to_numpy()
        number[at], best[at] = prices["n"].to_numpy(), prices["best"].to_numpy()
        places, times = (own[c].combine_chunks().flatten().to_numpy() for c in ("at", "times"))
        doc = np.repeat(np.arange(own.num_rows), own["at"].combine_chunks().value_lengths().to_numpy())
        sums = []
        for values in (best, number):
            total = np.zeros(own.num_rows, np.int64)
            np.add.at(total, doc, values[places] * times)
            sums.append(pa.array(total))
        kept = own.drop_columns(["block", "at", "times"])
        for name, column in zip(("n_best", "count_sum"), sums, strict=True):
            kept = kept.append_column(name, column)
        return kept.select([c.split()[0] for c in COUNTED.split(", ")])

    return rows.groupBy("block").cogroup(priced.groupBy("listed")).applyInArrow(run, COUNTED)
