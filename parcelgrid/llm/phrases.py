"""Phrases whose words occur together oftener than apart, per language, by Rabin-Karp fingerprints.

A text is cut into pieces at punctuation and line ends, pieces into words at blanks. Prefix
polynomials over the bytes give every word's hash, prefix polynomials over the words' hashes that of
every run of n words, all in numpy: a run's hash is the difference of two prefixes, moved to the
origin by the inverse power, so it does not depend on the place. A fingerprint takes in the language.

Runs are counted by length, each told by its fingerprint and a second one that is independent of
it; each task adds them up before the shuffle. A run of n words can be frequent only if its first
and its last n - 1 words are, so what was frequent at one length is sent on as an array of 2^BITS
bits, whatever its number, and others are not counted at the next length; false bits only cost work.

With its number a run carries a witness, 16 bits of the key of a text that holds it; the least one
stays. One more pass sends a pointer to an occurrence only from the texts that are a run's witness,
told by bits of both fingerprints and the witness together. So the pointers are about as many as the
frequent runs, and do not grow with the tasks that meet these. The text at the pointer is read and
hashed anew; a phrase that does not give both fingerprints, or a run without a pointer, is an error.
So only frequent phrases ever become text.

Cuts, scores and the drop of phrases inside longer ones are joins of the frequent phrases; products
are exact decimals of 38 digits.

Defined results: a null lang is ``und``; null, empty and blank texts have no words; repeated rows all
count; equal scores go by number, then by the phrase's bytes; a lang without candidates gives no
row; an empty table gives an empty table; other columns, doc_id too, are ignored. A long text is
hashed block by block, cut where a piece ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import byte_texts, slices

LONGEST = 5
FREQUENT = 100
TOP = 2000
SCALE = 1000
#: Percent of a phrase's occurrences that inside one longer phrase make it a part of that.
ABSORBED = 100
BITS = 25
BLOCK = 1 << 20
#: Entries that a task adds up before it sends them on.
HELD = 1 << 20
#: Shares of a language that are ranked apart before they meet.
SHARES = 64

#: 0 for bytes of words, 1 for blanks, 2 for what ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
ENDS = bytes(np.flatnonzero(KIND == 2).tolist())

#: Bits of a text's key that make it a witness.
WITNESS = 0xFFFF
COUNTS = "fp long, seal long, witness long, times long"
POINTERS = "words int, fp long, seal long, text_key long, start int, end int"
ROOM = 1 << 16
#: More than any place in a text, as an Arrow text has at most 2^31 bytes.
ROW = 1 << 32
BLANKS = re.compile("[ \t]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@cache
def _tables() -> tuple[np.ndarray, list[int]]:
    rng = np.random.default_rng(23)
    values = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values, [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64, and those of its inverse."""
    held = _powers.get(base)
    if held is None or len(held[0]) < size:
        size = max(size, BLOCK + ROOM)
        held = tuple(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        if size <= BLOCK + ROOM:
            _powers[base] = held
    return held


class Prefixes:
    """Prefix polynomial of a sequence of values; hashes any run of them."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of joined texts: where they are, their piece, and the hashes of runs of them."""

    def __init__(self, text: bytes, seeds: np.ndarray, begins: np.ndarray) -> None:
        """``seeds`` are hashes of the texts' languages; the texts begin at ``begins`` and end with a piece."""
        held = np.frombuffer(text, np.uint8)
        kinds = KIND[held]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.pieces = np.cumsum(kinds == 2, dtype=np.int32)[self.starts]
        self.texts = np.searchsorted(begins, self.starts, "right") - 1
        self.seeds = seeds[self.texts]
        values, bases = _tables()
        self.prefixes = []
        for letters, base in zip(values, bases, strict=True):
            words = Prefixes(letters[held], base).hashes(self.starts, self.ends)
            self.prefixes.append(Prefixes(words, base))

    def whole(self, n: int) -> np.ndarray:
        """For each place whether n words of one piece begin there."""
        count = max(0, len(self.starts) - n + 1)
        return self.pieces[:count] == self.pieces[n - 1 :]

    def hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """The fingerprints (or second ones) of the runs of n words at the places."""
        return _mix(self.prefixes[which].hashes(at, at + n) ^ self.seeds[at])


def seed(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode(), 5)


def parts(text: bytes, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(start, part): parts of about ``block`` bytes that end where a piece does, the first end from there on."""
    at = 0
    while at < len(text):
        end = min(len(text), at + block)
        while end < len(text) and text[end - 1] not in ENDS:
            end += 1
        yield at, text[at:end]
        at = end


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, rows, shifts) of a batch (lang, text): row of the batch and place in its text of every joined part."""
    seeds = np.array([seed(x) for x in batch.column("lang").to_pylist()], np.uint64)
    joined, rows, begins, shifts, size = [], [], [], [], 0
    for row, text in enumerate(byte_texts(batch)):
        for start, part in parts(text.lower()):
            joined.append(part + b"\n")
            rows.append(row)
            begins.append(size)
            shifts.append(start - size)
            size += len(part) + 1
            if size >= BLOCK:
                yield Words(b"".join(joined), seeds[rows], np.array(begins)), np.array(rows), np.array(shifts)
                joined, rows, begins, shifts, size = [], [], [], [], 0
    if joined:
        yield Words(b"".join(joined), seeds[rows], np.array(begins)), np.array(rows), np.array(shifts)


class Sums:
    """Numbers added up by key, in bounded memory. Other columns are those of some occurrence."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], keys: int) -> None:
        self.names, self.kinds, self.keys, self.held, self.size = names, kinds, keys, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Keys first, then the number, then the rest."""
        self.held.append(self.added(columns))
        self.size += len(self.held[-1][0])
        if self.size >= HELD:
            whole = self.added([np.concatenate(c) for c in zip(*self.held, strict=True)])
            self.held, self.size = [whole], len(whole[0])
            if self.size >= HELD // 2:
                yield from self.rest()

    def added(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        keys = columns[: self.keys]
        if not len(keys[0]):
            return columns
        order = np.argsort(keys[0], kind="stable")
        held = [c[order] for c in keys]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in held], axis=0)]
        if (new[1:] & (held[0][1:] == held[0][:-1])).any():  # the first key alone does not tell them apart
            order = np.lexsort(keys[::-1])
            held = [c[order] for c in keys]
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in held], axis=0)]
        columns = [c[order] for c in columns]
        first = np.flatnonzero(new)
        return [*(c[first] for c in columns[: self.keys]), np.add.reduceat(columns[self.keys], first), *(c[first] for c in columns[self.keys + 1 :])]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            whole = self.added([np.concatenate(c) for c in zip(*self.held, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(whole, self.kinds, strict=True)], self.names)
        self.held, self.size = [], 0


def passed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    slot = hashes >> np.uint64(64 - BITS)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def possible(words: Words, n: int, shorter: np.ndarray | None) -> np.ndarray:
    """The places of runs of n words whose first and last n - 1 words may be frequent."""
    whole = words.whole(n)
    if n > 1 and len(whole):
        before = words.whole(n - 1)
        before[before] = passed(shorter, words.hashes(np.flatnonzero(before), n - 1))
        whole &= before[:-1] & before[1:]
    return np.flatnonzero(whole)


def sources(docs: DataFrame) -> DataFrame:
    """(lang, text, text_key): what is hashed; equal rows have equal keys."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return own.withColumn("text_key", F.xxhash64("lang", "text"))


def counted(texts: DataFrame, n: int, shorter: Broadcast | None) -> DataFrame:
    """(fp, seal, witness, times) summed per task: the runs of n words that may be frequent."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["fp", "seal", "times", "witness"], [pa.int64()] * 4, 2)
        for batch in batches:
            for part in slices([batch], "text"):
                held = witnesses(part)
                for words, rows, _ in blocks(part):
                    at = possible(words, n, None if shorter is None else shorter.value)
                    columns = [words.hashes(at, n), words.hashes(at, n, 1), np.ones(len(at), np.int64), held[rows[words.texts[at]]]]
                    for out in sums.add(columns):
                        yield out.select(names)
        for out in sums.rest():
            yield out.select(names)

    return texts.mapInArrow(run, COUNTS)


def witnesses(batch: pa.RecordBatch) -> np.ndarray:
    """The witness of each text of a batch with a text_key."""
    return batch.column("text_key").to_numpy() & WITNESS


def signs(fp: np.ndarray, seal: np.ndarray, witness: np.ndarray) -> np.ndarray:
    """A hash of a run at a text that is its witness."""
    return _mix(fp ^ _mix(seal + witness.astype(np.uint64)))


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a run and its witness; their first BITS bits are different bits of the sign."""
    return hashes, hashes << np.uint64(BITS)


def bit_array(fps: DataFrame) -> np.ndarray:
    """A bit for each fingerprint; at most 2^(BITS - 6) rows come to the driver, as Arrow."""
    slot = F.shiftrightunsigned("fp", 64 - BITS)
    rows = fps.select(F.shiftright(slot, 6).alias("place"), (slot % 64).cast("int").alias("bit"))
    held = rows.groupBy("place").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[held["place"].to_numpy()] = held["bits"].to_numpy()
    return bits.view(np.uint64)


def signed(runs: DataFrame) -> DataFrame:
    """(fp): the slots of the runs (fp, seal, witness), two of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, seal, witness = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "seal", "witness"))
            for s in slots(signs(fp, seal, witness)):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["fp"])

    return runs.select("fp", "seal", "witness").mapInArrow(run, "fp long")


def pointers(texts: DataFrame, levels: list[tuple[Broadcast, Broadcast]]) -> DataFrame:
    """An occurrence of each run in the texts that are its witness; by length ``levels`` has the bits of runs and of their slots."""
    names = [c.split()[0] for c in POINTERS.split(", ")]
    order = ["fp", "seal", "times", "words", "text_key", "start", "end"]
    kinds = {"words": pa.int32(), "start": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(order, [kinds.get(c, pa.int64()) for c in order], 2)
        for batch in batches:
            for part in slices([batch], "text"):
                keys, held = part.column("text_key").to_numpy(), witnesses(part)
                for words, rows, shifts in blocks(part):
                    for n, (frequent, places) in enumerate(levels, 1):
                        at = np.flatnonzero(words.whole(n))
                        fp = words.hashes(at, n)
                        chosen = passed(frequent.value, fp)
                        at, fp = at[chosen], fp[chosen]
                        seal = words.hashes(at, n, 1)
                        one, two = slots(signs(fp, seal, held[rows[words.texts[at]]]))
                        chosen = passed(places.value, one) & passed(places.value, two)
                        at, fp, seal = at[chosen], fp[chosen], seal[chosen]
                        of = words.texts[at]
                        ones = np.ones(len(at), np.int64)
                        spans = [words.starts[at] + shifts[of], words.ends[at + n - 1] + shifts[of]]
                        for out in sums.add([fp, seal, ones, n * ones, keys[rows[of]], *spans]):
                            yield out.select(names)
        for out in sums.rest():
            yield out.select(names)

    return texts.mapInArrow(run, POINTERS)


def spelled(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, a) of the runs (words, fp, seal, a, text_key, start, end), read where they point and checked.

    A text is hashed once, however many runs point into it.
    """
    names = ["words", "fp", "seal", "a", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text"):
                lists = batch.column("wanted")
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                asked = {c: lists.flatten().field(c).to_numpy() for c in names}
                left = len(owner)
                langs, raw = batch.column("lang").to_pylist(), byte_texts(batch)
                wanted_key = owner * ROW + asked["start"]
                for words, rows, shifts in blocks(batch):
                    keys = rows[words.texts] * ROW + words.starts + shifts[words.texts]
                    at = np.searchsorted(keys, wanted_key)
                    here = np.flatnonzero(np.r_[keys, -1][at] == wanted_key)
                    here = here[at[here] + asked["words"][here] <= len(keys)]
                    for n in np.unique(asked["words"][here]).tolist():
                        own = here[asked["words"][here] == n]
                        fp, seal = (words.hashes(at[own], n, k).view(np.int64) for k in (0, 1))
                        own = own[(fp == asked["fp"][own]) & (seal == asked["seal"][own])]
                        left -= len(own)
                        pointed = zip(owner[own].tolist(), asked["start"][own].tolist(), asked["end"][own].tolist(), strict=True)
                        runs = [(langs[row], BLANKS.sub(" ", raw[row][s:e].lower().decode())) for row, s, e in pointed]
                        columns = [pa.array(c, pa.string()) for c in zip(*runs, strict=True)] if runs else [pa.array([], pa.string())] * 2
                        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(asked[c][own]) for c in ("fp", "seal", "a"))], ["lang", "phrase", "fp", "seal", "a"])
                if left:
                    raise ValueError(f"the text at {left} pointers is not their phrase")

    lists = found.groupBy("text_key").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    held = texts.join(lists.withColumnRenamed("text_key", "wanted_key").hint("shuffle_hash"), F.col("text_key") == F.col("wanted_key"))
    held = held.dropDuplicates(["text_key"])  # copies of a text are read once
    read = held.select("lang", "text", "wanted").mapInArrow(run, "lang string, phrase string, fp long, seal long, a long")
    return read.dropDuplicates(["fp", "seal"]).select("lang", "phrase", "a")


def frequent_phrases(docs: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of all phrases of up to ``longest`` words that occur so often, (lang, n) of all words)."""
    texts = sources(docs)
    context = docs.sparkSession.sparkContext
    levels: list[tuple[Broadcast, Broadcast]] = []
    runs = None
    for n in range(1, longest + 1):
        sums = counted(texts, n, levels[-1][0] if levels else None).groupBy("fp", "seal")
        held = sums.agg(F.min("witness").alias("witness"), F.sum("times").alias("a")).where(F.col("a") >= frequent)
        held = materialise(held)
        levels.append((context.broadcast(bit_array(held)), context.broadcast(bit_array(signed(held)))))
        runs = held if runs is None else runs.unionByName(held)
    some = [F.first(c).alias(c) for c in ("words", "text_key", "start", "end")]
    pointed = pointers(texts, levels).groupBy("fp", "seal").agg(*some)
    missing = F.raise_error(F.lit("a frequent run has no pointer")).cast("long")
    found = runs.select("fp", "seal", "a").join(pointed, ["fp", "seal"], "left").withColumn("text_key", F.coalesce("text_key", missing))
    found = materialise(found)
    return materialise(spelled(texts, found)), materialise(word_numbers(texts))


def word_numbers(texts: DataFrame) -> DataFrame:
    """(lang, n): the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes = np.zeros(batch.num_rows, np.int64)
            for words, rows, _ in blocks(batch):
                np.add.at(sizes, rows[words.texts], 1)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(sizes)], ["lang", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def scored(phrases: DataFrame, numbers: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score): phrases of two words or more at their lowest-scoring cut."""
    held = phrases.withColumn("words", F.split("phrase", " "))
    cuts = held.where(F.size("words") > 1).select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")).withColumn(
        "tail", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")
    )
    heads, tails = (phrases.select(F.col("lang"), F.col("phrase").alias(of), F.col("a").alias(as_)) for of, as_ in (("head", "l"), ("tail", "r")))
    whole = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(numbers, "lang")
    score = f"CAST({SCALE}BD * CAST(a AS DECIMAL(18,0)) * n AS DECIMAL(38,0)) DIV CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    best = whole.withColumn("score", F.expr(score)).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("n").alias("n"), F.first(F.size("words")).alias("n_words")
    )
    return best.select("lang", "phrase", "n_words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def on_their_own(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """The candidates that no longer one holds in ``absorbed`` percent of their occurrences or more."""
    words = F.split("phrase", " ")
    longer = candidates.where("n_words > 2").select("lang", F.col("a").alias("a_longer"), "n_words", words.alias("words"))
    pieces = longer.select("lang", "a_longer", "n_words", "words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    pieces = pieces.select("lang", "a_longer", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("place"))
    inside = pieces.select("lang", F.array_join(F.slice("words", F.col("place"), F.col("size")), " ").alias("phrase"), "a_longer")
    most = inside.groupBy("lang", "phrase").agg(F.max("a_longer").alias("a_longer"))
    gone = candidates.join(most, ["lang", "phrase"]).where(F.lit(100) * F.col("a_longer") >= absorbed * F.col("a")).select("lang", "phrase")
    return candidates.join(gone, ["lang", "phrase"], "left_anti")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of every language with their rank; shares of a language are cut before they meet."""
    by = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    place = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))
    few = candidates.withColumn("share", share).withColumn("place", place).where(F.col("place") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top).drop("share", "place")


def collocations(docs: DataFrame, frequent: int = FREQUENT, top: int = TOP, absorbed: int = ABSORBED, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    phrases, numbers = frequent_phrases(docs, frequent, longest)
    candidates = materialise(scored(phrases, numbers))
    return ranked(on_their_own(candidates, absorbed), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rule plainly, every run of words as text.
SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT lang, words, i, unnest(range(1, {LONGEST} + 1)) AS size FROM s),
f AS MATERIALIZED (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, count(*) AS a
  FROM k WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= {FREQUENT}),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS cut FROM f WHERE size > 1),
o AS (SELECT c.*, x.a AS l, y.a AS r, n.n,
    (CAST({SCALE} AS HUGEINT) * c.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c JOIN n ON c.lang = n.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1 : c.size], ' ')),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT lang, a, size, words, unnest(range(2, size)) AS part FROM b),
i AS (SELECT lang, a, words, part, unnest(range(1, size - part + 2)) AS place FROM q),
m AS (SELECT lang, array_to_string(words[place : place + part - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
v AS (SELECT b.* FROM b LEFT JOIN m ON b.lang = m.lang AND b.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < {ABSORBED} * a),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v)
SELECT * FROM z WHERE rank <= {TOP}
"""
