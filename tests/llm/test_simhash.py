import random

import numpy as np
import xxhash

from parcelgrid.llm import simhash
from parcelgrid.llm.components import components


def plain_fingerprint(text):
    words = text.lower().split() if isinstance(text, bytes) else []
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(docs):
    for r in docs.limit(60).collect():
        assert simhash.fingerprint(r.text.encode()) == plain_fingerprint(r.text.encode())
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A") == xxhash.xxh64_intdigest(b"a", 42)


def test_masks_cover_every_pair_of_bits():
    kept = [m & (2**64 - 1) for m in simhash.masks(2)]
    assert len(kept) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in kept)


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(v)
    values |= {0, 1, 3, 7, 15, 2**64 - 1}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(table)).collect()}
    want = reach(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}


def test_near_duplicates_equal_brute_force(docs, odd_docs):
    for table in (docs, odd_docs):
        rows = table.select("doc_id", "text").collect()
        fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
        root = reach(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for r, f in zip(rows, fps, strict=True):
            if r.doc_id is not None:
                least[root[f]] = min(r.doc_id, least.get(root[f], r.doc_id))
        want = sorted((str(r.doc_id), f, str(least.get(root[f]))) for r, f in zip(rows, fps, strict=True))
        got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(table).collect())
        assert got == want


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    found = simhash.near_duplicates(odd_docs).collect()
    assert kept.count() == len({str(r.component_id) + (str(r.fp) if r.component_id is None else "") for r in found})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
