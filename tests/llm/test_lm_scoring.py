import math
import random
from collections import Counter

import numpy as np

from parcelgrid.llm import lm_scoring as lm


def test_probabilities_sum_to_one():
    net = lm.Network(lm.Network.fresh() * 5)
    context = np.random.default_rng(0).integers(0, lm.TOKENS, (4, 3))
    total = np.zeros(3)
    for t in range(lm.CLASSES * lm.CLASS):
        total += np.exp(net.steps(context, np.full(3, t)))
    assert np.allclose(total, 1, atol=1e-3)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    net = lm.Network(lm.Network.fresh() * 3)
    context, token = rng.integers(0, lm.TOKENS, (4, 6)), rng.integers(0, lm.TOKENS, 6)
    grad = lm.Network(np.zeros(lm.Network.SIZE, np.float32))
    net.steps(context, token, grad)
    large = np.argsort(-np.abs(grad.values))[:20]
    for i in large:
        held = net.values[i]
        net.values[i] = held + 1e-2
        up = net.steps(context, token).sum()
        net.values[i] = held - 1e-2
        down = net.steps(context, token).sum()
        net.values[i] = held
        assert abs((down - up) / 2e-2 - grad.values[i]) < 0.02 + 0.03 * abs(grad.values[i])


def test_learns_from_both_sides(spark):
    """Held-out accuracy: the middle word is told by its neighbours only together."""
    rng = random.Random(3)

    def text():
        out = []
        for _ in range(60):
            a, b = rng.randrange(2), rng.randrange(2)
            out += [f"l{a}", f"m{a ^ b}", f"r{b}", "."]
        return " ".join(out)

    train = [(i, text()) for i in range(900)]
    odd = [(10_000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in train[:40]]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(train + odd, "doc_id long, text string"), rounds=6).collect()}
    fine = [out[i].mean_score for i in range(900)]
    mixed = [out[10_000 + i].mean_score for i in range(40)]
    # counts of single words alone would give -1.73
    assert np.mean(fine) > -0.85 and np.mean(fine) > np.mean(mixed) + 0.5


def test_scores_equal_a_plain_sum(spark, docs):
    words = lm.vocabulary(docs)
    ids = lm.Ids({w: i for i, w in enumerate(words)})
    held = lm.encoded(docs, words)
    values = lm.Network.fresh()
    got = {r.doc_id: r for r in lm.scored(held, values).collect()}
    net = lm.Network(values)
    for r in docs.limit(10).collect():
        t = [lm.EDGE] * 2 + [ids[w] for w in lm.words_of(r.text.encode())] + [lm.EDGE] * 2
        want = sum(float(net.steps(np.array([[t[k + o]] for o in lm.OFFSETS]), np.array([t[k]]))[0]) for k in range(2, len(t) - 2))
        assert got[r.doc_id].n_tokens == len(t) - 4 and abs(got[r.doc_id].score - want) < 0.01 * (1 + len(t) / 100)


def test_vocabulary_counts_all(docs):
    count = Counter()
    for r in docs.collect():
        count.update(lm.words_of(r.text.encode()))
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[: lm.VOCABULARY]
    assert lm.vocabulary(docs) == [w for w, _ in want]


def test_every_position_is_fitted_once(spark):
    """Positions told by unlike tokens: each is a target in exactly one of the rounds."""
    sizes = np.array([0, 1, 7, 4000, 0, 2500], np.int64)
    for rounds in (1, 3, 6):
        turn = lm.turns(sizes, rounds)
        share = np.bincount(turn.astype(np.int64), minlength=rounds) / sizes.sum()
        assert len(turn) == sizes.sum() and len(share) == rounds and np.all(np.abs(share - 1 / rounds) < 0.03)
    texts = [np.arange(at, at + 40, dtype="<u2").tobytes() for at in range(0, 1600, 40)]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, ids binary").coalesce(1).cache()
    before = np.zeros(lm.Network.SIZE, np.float32)
    fitted = np.zeros(1600)
    for k in range(3):
        bias = lm.Network(lm.trained(held, before.copy(), k, 3)).token_bias[:1600]
        # in one batch only a target's own bias rises
        fitted += bias > 0
    assert np.all(fitted == 1)


def test_odd_and_empty(odd_docs, no_docs):
    rows = lm.score(odd_docs, rounds=1).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.mean_score is None) == (r.n_tokens == 0) and math.isfinite(r.score) and (r.score < 0) == (r.n_tokens > 0)
    assert lm.score(no_docs).count() == 0
