import random

import corpus_pipeline as cp
import pytest

from parcelgrid.llm import near_copies as near


def plain_set(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def roots(sets, threshold=0.8):
    root = list(range(len(sets)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def planted(seed=4):
    """Originals and copies with a few words replaced, by chains, stars and pairs just below 0.8 too."""
    rng, texts = random.Random(seed), []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for k in range(6):
            now = list(words)
            for at in rng.sample(range(len(now)), max(1, int(len(now) * (0.005 + 0.007 * k)))):
                now[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(now))
            if k % 2:
                words = now
    return texts


def test_components_equal_brute_force(spark, odd_docs):
    texts = planted()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table).collect()}
    want = roots([plain_set(t) for t in texts])
    assert len(set(want)) < len(texts) / 2
    assert got == dict(enumerate(want))
    rows = odd_docs.collect()
    group = roots([plain_set(r.text) for r in rows])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    want = sorted((str(r.doc_id), str(least.get(g))) for r, g in zip(rows, group, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near.near_duplicates(odd_docs).collect()) == want


def test_stage_keeps_one_of_near_copies(spark, sf_dir):
    """Copies that differ in several words lie more than two SimHash bits apart."""
    texts = planted(9)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(cp.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, table, sf_dir).collect()) == sorted(set(roots([plain_set(t) for t in texts])))


def test_a_large_group_is_not_listed_pair_by_pair(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(i, " ".join(words[: i % 200] + [f"x{i}"] + words[i % 200 + 1 :])) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near.near_duplicates(table).collect()} == {0}


def templates(n, words, changed, seed=6):
    """Texts of one template with a few words changed in each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(words)]
    out = []
    for i in range(n):
        now = list(base)
        for at in rng.sample(range(words), changed):
            now[at] = f"x{i}y{at}"
        out.append(" ".join(now))
    return out


def made(spark, monkeypatch, texts):
    """The components, and how many pairs of nodes had their sets compared."""
    compared = []
    whole = near.similar

    def counting(pairs, sets, threshold):
        pairs = near.materialise(pairs)
        compared.append(pairs.count())
        return whole(pairs, sets, threshold)

    monkeypatch.setattr(near, "similar", counting)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near.near_duplicates(table).collect()}, sum(compared)


@pytest.mark.parametrize(("words", "changed", "original"), [(80, 3, False), (100, 2, True)])
def test_templates_grow_in_proportion(spark, monkeypatch, words, changed, original):
    """Also texts that differ by more than the threshold allows are not compared pair by pair."""
    counts = {}
    for n in (150, 600):
        texts = templates(n, words, changed) + templates(1, words, 0) * original
        got, counts[n] = made(spark, monkeypatch, texts)
        assert got == dict(enumerate(roots([plain_set(t) for t in texts])))
        monkeypatch.undo()
    assert counts[600] <= 8 * max(counts[150], 150)


def test_rare_shingles_lose_no_pair(spark):
    rng = random.Random(3)
    sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(40)]
    sets += [s ^ set(rng.sample(range(60), rng.randrange(4))) for s in sets if len(s) > 5]
    sets = [sorted(s) for s in {frozenset(s) for s in sets if s}]
    table = spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>")
    apart = table.selectExpr("node", "CAST(size(hashes) AS BIGINT) AS n", "node AS root")
    for t in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in near.by_rare_shingles(apart, table, t).collect()}
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len({*x} & {*y}) >= t * len({*x} | {*y})}
        assert want <= got and all(i > j for i, j in got)


def test_empty(no_docs):
    assert near.near_duplicates(no_docs).count() == 0 and near.keep_one(no_docs).count() == 0
