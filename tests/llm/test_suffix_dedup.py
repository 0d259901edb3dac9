"""Repeated substrings against plain counting of every string of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from parcelgrid.llm import suffix_dedup as sd


def repeated(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1] for t in texts]


def plain(texts, length):
    out = []
    for text, starts in zip(texts, repeated(texts, length), strict=True):
        gone = np.zeros(len(text), bool)
        for i in starts:
            gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion_finds_every_repeat(seed):
    rng = random.Random(seed)
    length, letters = rng.choice([8, 9, 13, 40]), rng.choice([b"ab", b"abcdefghi", bytes([0, 1, 0xFE])])
    texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(length, 160))) for _ in range(rng.randrange(1, 8))]
    texts = list(dict.fromkeys([*texts, texts[0][:70] + b"x" * length + texts[-1][3:], letters[:1] * 90]))
    got = [[i for a, b in rs for i in range(a, b + 1)] for rs in sd.repeated_starts(texts, [1] * len(texts), length)]
    assert got == repeated(texts, length)
    twice = sd.repeated_starts(texts, [2] * len(texts), length)
    assert twice == [[(0, len(t) - length)] for t in texts]


@pytest.mark.parametrize("seed", range(10))
def test_equal_strings_have_one_mark(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(120)) for _ in range(3)] + [b"a" * 1500]
    for width in sd.widths(20):
        held: dict = {}
        for text in texts:
            n = len(text) - 19
            starts = []
            for f, _, a, b, inner in sd.marked_runs(np.frombuffer(text, np.uint8), np.array([0]), np.array([n]), width, 20):
                for mark, lo, hi, again in zip(f.tolist(), a.tolist(), b.tolist(), inner.tolist(), strict=True):
                    starts += range(lo, hi)
                    own = [text[s : s + 20] for s in range(lo, hi)]
                    assert hi - lo <= sd.RUN and (again or len(set(own)) == len(own))
                    for string in own:
                        held.setdefault(string, set()).add(mark)
            assert starts == list(range(n))
        assert all(len(marks) == 1 for marks in held.values())


def _table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("crowd", [sd.CROWD, 300])
def test_query_equals_plain_counting(spark, crowd):
    """With little room for a bucket the longer grams and the whole strings get their turn."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 9)))
    passage, short = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(22))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(20)]
    texts += [f"{word()} {passage} {word()}" for _ in range(15)] + [f"{word()} {word()} {short} {word()} {word()}" for _ in range(15)]
    texts += [passage, passage, "ab" * 400, "x" * 99, "x" * 100, "x" * 101, "", passage[:40] * 3]
    got = {r[0]: tuple(r)[1:] for r in sd.digests(sd.without_repeats(_table(spark, texts), 100, crowd)).collect()}
    assert [got[i] for i in range(len(texts))] == plain([t.encode() for t in texts], 100)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    want = plain([(r.text or "").encode() for r in rows], sd.LENGTH)
    got = sd.digests(sd.without_repeats(odd_docs)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    assert sd.without_repeats(no_docs).count() == 0


def test_repeated_rows_lose_all(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    table = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text[:399])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in sd.digests(sd.without_repeats(table)).collect())
    assert got == [("1", len(text), len(text)), ("1", len(text), len(text)), ("2", 399, 0), ("None", len(text), len(text))]


def test_very_long_text_is_marked_in_blocks(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij ") for _ in range(sd.BLOCK + 5000))
    tail = long[sd.BLOCK - 300 : sd.BLOCK + 300]
    got = {r.doc_id: tuple(r)[2:4] for r in sd.digests(sd.without_repeats(_table(spark, [long, tail]))).collect()}
    assert got == {0: (600, 1), 1: (600, 1)}
