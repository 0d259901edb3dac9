import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelgrid.llm import packing
from parcelgrid.llm.queries import tokenizer_path


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=150, deadline=None)
def test_bins_hold_every_piece_once(lengths):
    bins = packing.pack_lengths(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert -(-sum(lengths) // 100) <= len(bins) <= len(packing.best_fit(lengths, 100))


def test_swaps_empty_a_bin():
    bins = [[60, 20], [50, 30], [20, 20]]  # best fit would not leave this; two full bins can hold it
    assert sorted(map(sum, packing.swap_search(bins, 100))) == [100, 100]


def test_ids_equal_the_tokenizer(docs, odd_docs):
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [r.text for r in docs.limit(80).collect()] + [r.text for r in odd_docs.collect() if r.text]
    texts += ["don't <|endoftext|> I'LL 'Re x²½ ΑΣ ς \x1c\x85 ǅ ŉ İ á <| |>", "ﬁ x"]
    chunks = packing.Chunks(tokenizer_path())
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(chunks.document(t.encode()), "<u4").tolist() == want


@pytest.mark.parametrize("group", [40_000, 50])
def test_placement(spark, docs, odd_docs, group):
    plain = Tokenizer.from_file(tokenizer_path())
    table = docs.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 100000", "text"))
    pieces = packing.materialise(packing.token_pieces(table, tokenizer_path()))
    rows = packing.pack(pieces, group=group).collect()
    want = defaultdict(int)
    for r in table.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[tuple(r)[:5]] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r.length for r in rows) // 4096) + 3


def test_empty(no_docs):
    assert packing.packed(no_docs, tokenizer_path()).count() == 0


def test_search_ends(spark):
    rng = random.Random(0)
    lengths = [rng.randint(1200, 2900) for _ in range(3000)]
    assert len(packing.pack_lengths(lengths)) <= len(packing.best_fit(lengths, 4096))
