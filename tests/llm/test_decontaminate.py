import random
import re

import numpy as np

from parcelgrid.llm import decontaminate as dc

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def shingles(text, width=None):
    words = WORD.findall((text or "").lower().encode())
    width = width or min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(docs, items):
    out = set()
    for i, t in docs:
        for j, u in items:
            own = shingles(u)
            if own and j is not None:
                shared = own & shingles(t, len(next(iter(own))))
                if len(shared) >= 0.8 * len(own):
                    out.add((i, j, len(shared), len(own)))
    return out


def test_words_and_shingles():
    text = "the  cat's 12-ab, été x".encode()
    w = dc.Words(text)
    assert [text[s:e] for s, e in zip(w.starts, w.ends, strict=True)] == WORD.findall(text)
    assert w.run(1, 3) == b"cat s 12"
    long = b" ".join(b"word%d" % i for i in range(5000))
    assert (dc.Words(long, block=100).hashes == dc.Words(long).hashes).all()
    assert len(np.unique(dc.Words(long).shingles(5))) == 4996
    assert len(dc.Words(b"")) == len(dc.Words(b" ,")) == 0


def test_equals_brute_force_on_every_size(spark):
    rng = random.Random(4)
    items, docs = [], []
    for j, n in enumerate([1, 2, 4, 5, 6, 9, 15, 19, 20, 25, 40, 80, 300, 2000]):
        items.append((j, " ".join(f"i{j}x{rng.randrange(10**6)}" for _ in range(n))))
    for i in range(80):
        filler = [f"f{rng.randrange(3000)}" for _ in range(rng.choice([3, 50, 400, 6000]))]
        words = items[i % len(items)][1].upper().split()
        for _ in range(rng.choice([0, 0, 1, max(1, len(words) // 40)])):
            words[rng.randrange(len(words))] = "changed"
        at = rng.randrange(len(filler))
        docs.append((i, " ".join(filler[:at] + words + filler[at:])))
    docs += [(900, None), (901, ""), (902, ", ."), (None, items[10][1]), (903, items[9][1]), (903, items[9][1])]
    items += [(50, None), (51, " "), (None, "never looked for here at all"), (52, items[10][1])]
    got = dc.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == brute(docs, items)


def test_keep_clean_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"shared{i}" for i in range(20)))], "item_id long, text string")
    kept = dc.keep_clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 2 and not {8, 9} & {r.doc_id for r in kept.collect()}
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(odd_docs, items.limit(0)).count() == 0
