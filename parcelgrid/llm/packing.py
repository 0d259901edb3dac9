"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swaps.

A document is its token ids and an end id. Only a document longer than a sequence is cut, into
full pieces and a rest. Full pieces are sequences by themselves. All other pieces are dealt by a
hash to groups of about ``GROUP`` pieces; each group is packed in one task: best fit over the
pieces in decreasing length, then a local search over all underfull bins, which moves a piece,
exchanges one for one or two for one, until none increases the sum of squared fills. Bins that
lose their last piece vanish. What is in each group's underfull bins then meets that of other
groups in a second round, so that dealing into groups costs no bin per group.

Tokens of a text are those of its chunks between ASCII white space, since the tokenizer's words
end there; a worker keeps the ids of chunks it has seen, at most ``CACHE``.

Defined results: a null or empty text is one piece that holds the end id; equal rows are packed
each on its own; a null doc_id is passed on; an empty table gives an empty table; other columns
are ignored. Which of two equally good places a piece gets is not defined.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import byte_texts, slices

CAPACITY = 4096
END_ID = 1
GROUP = 40_000
CACHE = 1_200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

#: The tokenizer's word pattern and the letters that stand for bytes.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Chunks of these letters need no Unicode normalisation, and lower-case letter by letter.
PLAIN = regex.compile("[!-~¡-įı-ňŊ-ɏ]+")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks(dict):
    """Token ids (little-endian bytes) by chunk."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        others = [b for b in range(256) if b not in PRINTED]
        self.letters = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(others)}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = self.words[word] = pack_ids([t.id for t in tokens])
            if len(self.words) > CACHE:
                self.words = {}
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)) and "<|" not in text:
            ids = b"".join(map(self.word, WORD.findall(text.lower())))
        else:
            ids = pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[chunk] = ids
        return ids

    def document(self, text: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def chunks(path: str) -> Chunks:
    return Chunks(path)


def token_pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]); ids are little-endian unsigned 32-bit."""
    end = pack_ids([END_ID])
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(tokenizer)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), strict=True):
                ids = known.document(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] * with_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] * with_ids)]
    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms for which there are bins, ascending
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([])
            room, own = capacity, len(bins) - 1
        else:
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[own].append(i)
        left = room - n
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(own)
    return bins


class _Index:
    """Where a piece could go: for every underfull bin the room it has, and has without one of its pieces.

    Entries (space, bin) are sorted within classes of rooms of [2^(c-1), 2^c). An exchange that
    gives a bin n tokens for a piece (or nothing) leaves it ``space - n``. It adds to the sum of
    squared fills exactly if that is less than both bins' rooms before it.
    """

    def __init__(self, bins: list[list[int]], capacity: int) -> None:
        self.bins, self.capacity = bins, capacity
        self.rooms = [capacity - sum(b) for b in bins]
        self.classes: list[list[tuple[int, int]]] = [[] for _ in range(capacity.bit_length() + 1)]
        for i, room in enumerate(self.rooms):
            self.classes[room.bit_length()] += self._entries(i)
        for entries in self.classes:
            entries.sort()

    def _entries(self, i: int) -> list[tuple[int, int]]:
        room = self.rooms[i]
        return [(room + n, i) for n in {0, *self.bins[i]}] if room and self.bins[i] else []

    def best(self, n: int, own: int, most: int) -> tuple[int, int] | None:
        """(room left, bin) of the bin that n tokens from bin ``own`` fill best, with less than ``most`` left."""
        found = None
        for bits, entries in enumerate(self.classes):
            if not entries:
                continue
            bound = n + min(most, 1 << bits)
            for k in range(bisect_left(entries, (n, -1)), len(entries)):
                space, i = entries[k]
                if space >= bound:
                    break
                if i != own and space - n < self.rooms[i]:
                    found, most = (space - n, i), space - n
                    break
            if not most:
                break
        return found

    def change(self, i: int, out: tuple[int, ...], into: tuple[int, ...]) -> None:
        entries = self.classes[self.rooms[i].bit_length()]
        for e in self._entries(i):
            entries.pop(bisect_left(entries, e))
        for n in out:
            self.bins[i].remove(n)
        self.bins[i].extend(into)
        self.rooms[i] += sum(out) - sum(into)
        entries = self.classes[self.rooms[i].bit_length()]
        for e in self._entries(i):
            insort(entries, e)

    def exchange(self, b: int) -> bool:
        """Makes the exchange of one or two pieces of bin b that fills another bin best; False if none gains."""
        lengths = sorted(set(self.bins[b]), reverse=True)
        twice = {n for n in lengths if self.bins[b].count(n) > 1}
        ways = {n: (n,) for n in lengths}
        for k, n in enumerate(lengths):
            for m in lengths[k if n in twice else k + 1 :]:
                ways.setdefault(n + m, (n, m))
        best, most = None, self.rooms[b]
        for n, way in ways.items():
            if hit := self.best(n, b, most):
                most, best = hit[0], (way, n, hit[1])
                if not most:
                    break
        if best is None:
            return False
        take, n, a = best
        given = most + n - self.rooms[a]
        give = (given,) if given else ()
        self.change(a, give, take)
        self.change(b, take, give)
        return True


def swap_search(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties bins (of lengths) by exchanges between all underfull ones.

    From the emptiest on, moves a bin's pieces to others, one for one, two for one, or one or two
    for none, as long as that increases the sum of squared fills; partners are looked up by the
    space they have. Stops at the least possible number of bins or when no exchange gains.
    """
    least = -(-sum(map(sum, bins)) // capacity)
    done = [b for b in bins if sum(b) == capacity]
    index = _Index([list(b) for b in bins if sum(b) < capacity], capacity)
    left, changed = len(bins), True
    while changed and left > least:
        changed = False
        for b in sorted(range(len(index.bins)), key=lambda i: -index.rooms[i]):
            while index.bins[b] and index.rooms[b] and index.exchange(b):
                changed = True
            left = len(done) + sum(map(bool, index.bins)) if not index.bins[b] else left
            if left <= least:
                break
    return done + [b for b in index.bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into ``lengths``."""
    bins = swap_search([[lengths[i] for i in b] for b in best_fit(lengths, capacity)], capacity)
    of: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        of.setdefault(n, []).append(i)
    return [[of[n].pop() for n in b] for b in bins]


def _placed(frame: pd.DataFrame, bins: list[list[int]], first: int) -> pd.DataFrame:
    rows = np.fromiter((i for b in bins for i in b), np.int64, len(frame))
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    out = frame.iloc[rows].copy()
    out["sequence_id"] = first + np.repeat(np.arange(len(bins), dtype=np.int64), sizes)
    ends = out["length"].cumsum()
    before = ends - out["length"]
    out["offset"] = before - before.groupby(out["sequence_id"]).transform("first")
    return out


def _round(pieces: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """Packs each of ``groups`` groups; sequence ids are unique over rounds and groups."""
    names = [c.split()[0] for c in PLACED.split(", ")]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins = pack_lengths(frame["length"].tolist(), capacity)
        # a group holds a bounded number of bins, so 2^32 ids each never meet
        out = _placed(frame, bins, (2 * int(key[0]) + round_no) << 32)
        return out[names]

    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no)), F.lit(groups))
    names_in = [c.split()[0] for c in PIECES.split(", ")]
    return pieces.select(*names_in, salt.alias("dealt")).groupBy("dealt").applyInPandas(pack, PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` should be a written table: it is read often."""
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    count = short.count()
    groups = -(-count // group)
    if groups <= 1:
        return full.unionByName(_round(short, 1, 0, capacity))
    first = materialise(_round(short, groups, 0, capacity))
    fills = first.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    # The emptiest bin of each group and all that are mostly empty are packed anew with those of other groups.
    least = fills.groupBy((F.shiftright("sequence_id", 33)).alias("dealt")).agg(
        F.min_by("sequence_id", F.struct("fill", "sequence_id")).alias("sequence_id")
    )
    loose = materialise(
        fills.where(F.col("fill") * 2 < capacity).select("sequence_id").union(least.select("sequence_id")).distinct()
    )
    again = first.join(loose, "sequence_id", "left_semi").drop("sequence_id", "offset")
    settled = first.join(loose, "sequence_id", "left_anti")
    return full.unionByName(settled.select(full.columns)).unionByName(
        _round(again, -(-groups // group), 1, capacity).select(full.columns)
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity=capacity)), capacity)
