"""Masked pseudo-likelihood from a small bidirectional network, trained in numpy over all documents.

The network predicts a token from the two tokens on each side: the sum of one embedding per
neighbour and offset goes through tanh to a two-step softmax (the token's class, then the token
within its class). A document's score is the sum over its tokens of log p(token | both sides).

1. Words are counted over all documents; the ``VOCABULARY`` most frequent are tokens by
   themselves. Every other word is one of ``OTHERS`` tokens told by its last three letters.
2. Documents are encoded once and written (two bytes a token).
3. ``ROUNDS`` training rounds: every partition starts from the round's parameters, masks the
   positions whose turn it is and fits them by AdaGrad; the parameters that come out are averaged,
   weighed by positions, in an aggregation over small blocks of them. Each position of each document
   is masked in exactly one round, told by its place and the document's length, so the network is
   fitted to the whole corpus and to no sample of it; what is gathered grows with the documents, and
   what the driver holds is one set of parameters of a fixed size.
4. Every position of every document is scored with the last parameters, which are broadcast.

The same rows in the same partitions give the same scores; other partitions train in another
order and give slightly different ones.

Defined results: words are lower-cased and separated by ASCII white space; a null or blank text
has 0 tokens, score 0 and a null mean; neighbours beyond the text's ends are an edge token;
repeated rows are scored each (and train each); a null doc_id is passed on; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import byte_texts, slices

VOCABULARY = 1400
OTHERS = 624
CLASS = 46
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 3
BATCH = 4096
RATE = 0.08
COUNTED = 500_000
TOKENS = VOCABULARY + OTHERS + 1  # the last is the edge
EDGE = TOKENS - 1
CLASSES = -(-TOKENS // CLASS)
SCORED = 1 << 15
BLOCKS = 64


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents. A task sends what it counted whenever it holds COUNTED words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in slices(batches, "text", 1 << 20):
            for text in byte_texts(batch):
                held.update(words_of(text))
            if len(held) > COUNTED:
                yield out()
                held = Counter()
        if held:
            yield out()

    own = docs.select(F.col("text").cast("string"))
    return own.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> list[bytes]:
    """The most frequent words, at most VOCABULARY; ties by the word.

    Written first: so the tops of the partitions meet in a task and not in the driver.
    """
    rows = materialise(word_counts(docs).orderBy(F.desc("n"), "word").limit(VOCABULARY)).collect()
    return [bytes(r["word"]) for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))]


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return VOCABULARY + crc32(word.decode()[-3:].encode()) % OTHERS


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids({w: i for i, w in enumerate(words)})
        for batch in slices(batches, "text"):
            out = [np.array([ids[w] for w in words_of(t)], "<u2").tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids binary")


class Network:
    """Parameters in one float32 vector: neighbour embeddings, bias, class and token outputs."""

    SHAPES = ((len(OFFSETS), TOKENS, WIDTH), (WIDTH,), (CLASSES, WIDTH), (CLASSES,), (CLASSES * CLASS, WIDTH), (CLASSES * CLASS,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        parts = np.split(values, np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1])
        self.near, self.bias, self.to_class, self.class_bias, self.to_token, self.token_bias = (
            p.reshape(s) for p, s in zip(parts, self.SHAPES, strict=True)
        )

    @classmethod
    def fresh(cls) -> np.ndarray:
        values = np.random.default_rng(1).normal(0, 0.1, cls.SIZE).astype(np.float32)
        net = cls(values)
        for p in (net.bias, net.class_bias, net.token_bias):
            p[:] = 0
        # ids that no token has
        net.token_bias[TOKENS:] = -30
        return values

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.near[0][context[0]]
        for k in range(1, len(OFFSETS)):
            total += self.near[k][context[k]]
        return np.tanh(total + self.bias)

    def steps(self, context: np.ndarray, token: np.ndarray, learn: Network | None = None) -> np.ndarray:
        """log p of each token; adds the gradients to ``learn`` if given."""
        of = token // CLASS
        order = np.argsort(of.astype(np.uint8), kind="stable")
        context, token, of = context[:, order], token[order], of[order]
        edges = np.searchsorted(of, np.arange(CLASSES + 1)).tolist()
        h = self.hidden(context)
        # one column a position, so that the softmax runs along contiguous rows
        across = np.ascontiguousarray(h.T)
        columns = np.arange(len(token))

        def softmax(weights: np.ndarray, bias: np.ndarray, s: int, e: int) -> np.ndarray:
            p = weights @ across[:, s:e] + bias[:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            return p

        p = softmax(self.to_class, self.class_bias, 0, len(token))
        logs = np.log(p[of, columns] + 1e-30)
        if learn is not None:
            p[of, columns] -= 1
            learn.to_class += p @ h
            learn.class_bias += p.sum(axis=1)
            back = p.T @ self.to_class
        for c in range(CLASSES):
            s, e = edges[c], edges[c + 1]
            if s == e:
                continue
            own, at = slice(c * CLASS, (c + 1) * CLASS), token[s:e] - c * CLASS
            q = softmax(self.to_token[own], self.token_bias[own], s, e)
            logs[s:e] += np.log(q[at, columns[: e - s]] + 1e-30)
            if learn is not None:
                q[at, columns[: e - s]] -= 1
                learn.to_token[own] += q @ h[s:e]
                learn.token_bias[own] += q.sum(axis=1)
                back[s:e] += q.T @ self.to_token[own]
        if learn is not None:
            back *= 1 - h * h
            learn.bias += back.sum(axis=0)
            values = back.ravel().astype(np.float64)
            for k in range(len(OFFSETS)):
                cells = (context[k][:, None] * WIDTH + np.arange(WIDTH)).ravel()
                learn.near[k] += np.bincount(cells, values, TOKENS * WIDTH).reshape(TOKENS, WIDTH).astype(np.float32)
        out = np.empty_like(logs)
        out[order] = logs
        return out


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The neighbours of positions; ``ids`` has two edge tokens around every document."""
    return np.stack([ids[at + o] for o in OFFSETS])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids with edges between documents, the positions of tokens, and how many each document has."""
    edge = np.array([EDGE] * 2, "<u2").tobytes()
    ids = np.frombuffer(edge + b"".join(t + edge for t in texts), "<u2").astype(np.int64)
    return ids, np.flatnonzero(ids != EDGE), np.array([len(t) // 2 for t in texts], np.int64)


def turns(sizes: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each position of documents with so many tokens is masked."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(sizes, sizes).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(40)) % np.uint64(rounds)


def trained(held: DataFrame, values: np.ndarray, round_no: int, rounds: int = ROUNDS) -> np.ndarray:
    """The parameters after one round over all documents; ``rounds`` of them mask every position once."""
    spark = held.sparkSession
    start = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, grad = Network(start.value.copy()), Network(np.zeros(Network.SIZE, np.float32))
        squares = np.full(Network.SIZE, 1e-3, np.float32)
        chance, seen, kept = np.random.default_rng(round_no), 0, []

        def fit(context: np.ndarray, token: np.ndarray) -> None:
            grad.values[:] = 0
            net.steps(context, token, grad)
            np.add(squares, grad.values * grad.values, out=squares)
            net.values -= RATE * grad.values / np.sqrt(squares)

        for batch in slices(batches, "ids", 2 << 20):
            ids, at, sizes = joined([x or b"" for x in batch.column("ids").to_pylist()])
            at = at[turns(sizes, rounds) == round_no]
            kept.append((contexts(ids, at), ids[at]))
            if sum(len(t) for _, t in kept) < BATCH:
                continue
            context, token = (np.concatenate(x, axis=-1) for x in zip(*kept, strict=True))
            order = chance.permutation(len(token))
            for s in range(0, len(order), BATCH):
                part = order[s : s + BATCH]
                fit(context[:, part], token[part])
            seen, kept = seen + len(token), []
        if kept and (context := np.concatenate([c for c, _ in kept], axis=1)).shape[1]:
            fit(context, np.concatenate([t for _, t in kept]))
            seen += context.shape[1]
        if seen:
            parts = np.array_split(net.values, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts])],
                ["block", "seen", "part"],
            )

    def mean(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["seen", "part"])
        weights = frame["seen"].to_numpy(np.float64)
        parts = np.stack([np.frombuffer(p, np.float32) for p in frame["part"]])
        part = (weights @ parts / weights.sum()).astype(np.float32)
        return pd.DataFrame({"block": [key[0]], "seen": [int(weights.sum())], "part": [part.tobytes()]})

    schema = "block int, seen long, part binary"
    some = held.mapInArrow(run, "block int, seen long, part binary").withColumn("dealt", F.spark_partition_id() % 64)
    # first within 64 groups of partitions, then over them, so that no task gets every partition's block
    partial = some.groupBy("block", "dealt").applyInPandas(lambda key, f: mean(key, f), schema)
    rows = {r["block"]: r["part"] for r in partial.groupBy("block").applyInPandas(mean, schema).collect()}
    if not rows:
        return values
    return np.concatenate([np.frombuffer(rows[k], np.float32) for k in range(BLOCKS)])


def scored(held: DataFrame, values: np.ndarray) -> DataFrame:
    shared = held.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in slices(batches, "ids", 2 << 20):
            ids, at, sizes = joined([x or b"" for x in batch.column("ids").to_pylist()])
            logs = np.zeros(len(at))
            for s in range(0, len(at), SCORED):
                part = at[s : s + SCORED]
                logs[s : s + SCORED] = net.steps(contexts(ids, part), ids[part])
            ends = np.cumsum(sizes)
            total = np.concatenate([[0.0], np.cumsum(logs)])
            sums = total[ends] - total[ends - sizes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(np.round(sums, 4))], ["doc_id", "n_tokens", "score"]
            )

    return held.mapInArrow(run, "doc_id long, n_tokens long, score double")


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, score, mean_score): trains on ``docs`` and scores each of them."""
    held = materialise(encoded(docs, vocabulary(docs)))
    values = Network.fresh()
    for k in range(rounds):
        values = trained(held, values, k, rounds)
    out = scored(held, values)
    return out.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.round(F.col("score") / F.col("n_tokens"), 6)))
