import re
from collections import Counter

from parcelgrid.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_measures_equal_brute_force(spark, docs, odd_docs):
    for table in (docs, odd_docs):
        got = q.judged(table).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
        ).collect()
        want = Counter((r.doc_id, *base(r.text)) for r in table.collect())
        assert Counter(map(tuple, got)) == want


def test_verdict_follows_the_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = q.judged(docs).join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_estimation_finds_the_right_accuracies(spark):
    """Votes drawn from known accuracies."""
    import random

    rng = random.Random(1)
    right_good, right_bad = (0.95, 0.9, 0.97, 0.9), (0.8, 0.7, 0.9, 0.75)
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = ""
        for g, b in zip(right_good, right_bad, strict=True):
            right = rng.random() < (g if good else b)
            votes += "-" if rng.random() < 0.2 else ("g" if right == good else "b")
        patterns[votes] += 1
    table = spark.createDataFrame(list(patterns.items()), "votes string, n long")
    model = q.fit(table, 4, rounds=60)
    assert abs(model.share - 0.8) < 0.03
    assert all(abs(a - b) < 0.05 for a, b in zip(model.right_good + model.right_bad, right_good + right_bad, strict=True))


def test_keep_good_and_empty(spark, odd_docs, no_docs):
    kept = q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {(r.doc_id, r.n_words) for r in q.judged(odd_docs).where("kept").collect()}
    assert {(r.doc_id, len(WORD.findall(r.text))) for r in kept.collect()} == want
    assert q.judged(no_docs).count() == 0 and q.keep_good(no_docs).count() == 0
