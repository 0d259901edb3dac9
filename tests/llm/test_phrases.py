"""Collocations against a plain count of every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parcelgrid.llm import phrases as ph


def plain(rows, frequent, top, absorbed, longest=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, numbers = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            numbers[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    held = {k: a for k, a in counts.items() if a >= frequent}
    found = {}
    for (lang, *words), a in held.items():
        cuts = [(1000 * a * numbers[lang] // (held[lang, *words[:k]] * held[lang, *words[k:]]), k) for k in range(1, len(words))]
        if cuts:
            score, k = min(cuts)
            found[lang, *words] = (a, held[lang, *words[:k]], held[lang, *words[k:]], numbers[lang], score)
    gone = set()
    for (lang, *words), (a, *_) in found.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                part = (lang, *words[i : i + n])
                if 100 * a >= absorbed * found[part][0]:
                    gone.add(part)
    out = []
    for lang in {k[0] for k in found}:
        own = [(-v[4], -v[0], " ".join(k[1:]).encode(), v) for k, v in found.items() if k[0] == lang and k not in gone]
        out += [(lang, i, p.decode(), *v) for i, (_, _, p, v) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "the", "The", "é", "漢", "x-y", "it's", " z", "Ö"]
    blanks, ends = [" ", "  ", "\t", " \t "], [". ", ",", "\n", "!?", "\r\n", "\x0b", " ; "]
    out = []
    for _ in range(60):
        text = "".join(rng.choice(words) + (rng.choice(ends) if rng.random() < 0.15 else rng.choice(blanks)) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "fr", None, "und"]), text))
    return [*out, out[0], out[0], (None, None), ("en", ""), ("de", " . "), ("it", "once only")]


@pytest.mark.parametrize(("seed", "frequent", "top", "absorbed"), [(1, 3, 2000, 100), (2, 5, 7, 90), (3, 2, 30, 60)])
def test_equals_plain_count(spark, seed, frequent, top, absorbed):
    own = rows(seed)
    table = spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(own)], "n long, text string, lang string, words string")
    got = sorted(tuple(r) for r in ph.collocations(table, frequent, top, absorbed).collect())
    assert got and got == plain(own, frequent, top, absorbed)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([("en", "a b", big - 1), ("en", "a", 3 * big + 1), ("en", "b", big + 7)], "lang string, phrase string, a long")
    numbers = spark.createDataFrame([("en", 7 * 10**13 + 11)], "lang string, n long")
    (row,) = ph.scored(phrases, numbers).collect()
    assert row.score == 1000 * (big - 1) * (7 * 10**13 + 11) // ((3 * big + 1) * (big + 7))


def test_hash_does_not_depend_on_the_place():
    text = b"one  two three. one two\tthree four\n"
    words = ph.Words(text, np.array([7], np.uint64), np.zeros(1, np.int64))
    for n, a, b in ((1, 0, 3), (2, 0, 3), (3, 0, 3)):
        for which in (0, 1):
            x, y = (int(words.hashes(np.array([at]), n, which)[0]) for at in (a, b))
            assert x == y
    assert ph.possible(words, 3, np.full(1 << (ph.BITS - 6), 2**64 - 1, np.uint64)).tolist() == [0, 3, 4]
    other = ph.Words(text, np.array([8], np.uint64), np.zeros(1, np.int64))
    assert int(words.hashes(np.array([0]), 2)[0]) != int(other.hashes(np.array([0]), 2)[0])


def test_colliding_fingerprints_are_told_apart(spark):
    """Runs of one fingerprint and different second ones are added up apart; a wrong pointer is an error."""
    sums = ph.Sums(["fp", "seal", "times"], [ph.pa.int64()] * 3, 2)
    held = [np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.ones(4, np.int64)]
    assert list(sums.add(held)) == []
    (out,) = sums.rest()
    assert out.to_pydict() == {"fp": [5, 5, 9], "seal": [1, 2, 1], "times": [2, 1, 1]}
    texts = ph.sources(spark.createDataFrame([("en", "some words here")], "lang string, text string"))
    key = texts.first().text_key
    wrong = spark.createDataFrame([(2, 1, 1, 100, key, 0, 10)], "words int, fp long, seal long, a long, text_key long, start int, end int")
    with pytest.raises(Exception, match="not their phrase"):
        ph.spelled(texts, wrong).collect()


def test_long_texts_are_cut_where_a_piece_ends():
    text = b"word word. " * 50
    cut = list(ph.parts(text, 64))
    assert b"".join(p for _, p in cut) == text and all(p[-1:] == b"." for _, p in cut[:-1])
    assert [at for at, _ in cut] == np.cumsum([0, *(len(p) for _, p in cut[:-1])]).tolist()
    assert list(ph.parts(b"no end " * 30, 64)) == [(0, b"no end " * 30)]


def test_odd_documents(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    table = odd_docs.withColumn("lang", F.when(F.col("doc_id") > 4, F.lit("en")))
    own = [(r.lang, r.text) for r in table.collect()]
    assert sorted(tuple(r) for r in ph.collocations(table, 2).collect()) == plain(own, 2, 2000, 100)
    assert ph.collocations(no_docs.withColumn("lang", F.lit("en"))).count() == 0
