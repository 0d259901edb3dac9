"""Alignment of two tokenizers against a plain loop over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from parcelgrid.llm import token_alignment as ta
from parcelgrid.llm.queries import alignment_files


@pytest.fixture(scope="module")
def plain():
    """(n_a, n_b, groups, links) of a text, by the tokenizers' own files and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    files = alignment_files()
    whole = Tokenizer.from_file(files.whole)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}

    def spell_b(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def ranges(spellings):
        at, out = 0, []
        for s in spellings:
            out.append((at, at + len(s)))
            at += len(s)
        return out

    def run(text):
        if not text:
            return 0, 0, "", []
        a = whole.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        of_a, of_b = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a], [spell_b(i) for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return 0, 0, "", []
        ra, rb = ranges(of_a), ranges(of_b)
        links = [(x, y) for x, (s, e) in zip(a, ra, strict=True) for y, (t, f) in zip(b, rb, strict=True) if s < f and t < e]
        groups, begin = [], 0
        for end in sorted({e for _, e in ra} & {e for _, e in rb}):
            sides = [",".join(str(i) for i, (s, e) in zip(ids, rs, strict=True) if begin <= s and e <= end) for ids, rs in ((a, ra), (b, rb))]
            groups.append("|".join(sides))
            begin = end
        return len(a), len(b), ";".join(groups), links

    return run


def expected(plain, texts):
    own = [plain(t) for t in texts]
    counts = Counter(pair for *_, links in own for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (
            n_a, n_b, len(groups.split(";")) if groups else 0, len(links),
            sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in own
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "plain words and words", "  two  blanks ", "tab\tand\nline\r\n end ", "", None, "<|endoftext|> </s> <s> <unk> <0x41>", "漢字 İstanbul naïve ﬁ é é",
    "\U0001f600\U0001f468‍\U0001f469", "\x00nul\x00", "don't we'll I'm 12345 3.14159", "_____ #### $%&", "▁lower one eighth▁", "a" * 300, " " * 50, "  x", "plain words and words",
]


def test_equals_the_plain_loop(spark, plain):
    rng = random.Random(2)
    words = [w for t in ODD if t for w in t.split()] + ["alignment", "tokenizer", "überall", "œuvre", "don't"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in ta.counted(table, alignment_files()).collect()}
    want = expected(plain, texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) > 30


def test_groups_are_the_output(spark, plain):
    table = spark.createDataFrame([(1, ODD[0]), (2, ODD[6])], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in ta.counted(table, alignment_files(), with_groups=True).collect()}
    assert got == {1: plain(ODD[0])[2], 2: plain(ODD[6])[2]}


def test_query_equals_the_plain_loop_on_a_table(spark, sf_dir, docs, plain):
    """Short documents of the table in full; its counts come from all of them."""
    from parcelgrid.llm.queries import op13_token_alignment

    rows = docs.select("doc_id", "text").collect()
    want = expected(plain, [r.text for r in rows]) if sum(len(r.text or "") for r in rows) < 10**5 else None
    got = {r.doc_id: r for r in op13_token_alignment(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        n_a, n_b, groups, _ = (None,) * 4 if len(r.text or "") > 2000 else plain(r.text)
        if n_a is not None:
            assert (got[r.doc_id].n_a, got[r.doc_id].n_b, got[r.doc_id].n_groups) == (n_a, n_b, len(groups.split(";")) if groups else 0)
            assert got[r.doc_id].groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        if want:
            assert tuple(got[r.doc_id][c] for c in NAMES) == want[i]


@pytest.mark.parametrize("seed", range(20))
def test_links_are_all_overlaps(seed):
    rng = random.Random(seed)
    frames, ranges, base = [[], []], [[], []], 0
    for doc in range(4):
        size = rng.randrange(1, 40)
        for side in (0, 1):
            cuts = [0, *sorted(rng.sample(range(1, size), rng.randrange(size))), size]
            for s, e in zip(cuts, cuts[1:], strict=False):
                frames[side].append((doc, base + s))
                ranges[side].append((base + s, base + e))
        base += size
    a, b = (pd.DataFrame(f, columns=["doc", "start"]) for f in frames)
    x, y = ta.linked(a, b)
    want = {(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e}
    assert len(x) == len(want) and set(zip(x.tolist(), y.tolist(), strict=True)) == want
    common, of_a, of_b = ta.grouped(*(np.array([e for _, e in r]) for r in ranges))
    assert common.tolist() == sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    assert of_a.max() == of_b.max() == len(common) - 1


def test_odd_documents(spark, odd_docs, no_docs, plain):
    rows = odd_docs.where("length(text) < 1000 OR text IS NULL").collect()
    got = ta.counted(odd_docs, alignment_files()).collect()
    assert len(got) == odd_docs.count()
    by_text = {(r.n_a, r.n_b, r.groups_sha256) for r in got}
    assert {(w[0], w[1], w[6]) for w in expected(plain, [r.text for r in rows])} <= by_text
    assert ta.counted(no_docs, alignment_files()).count() == 0


def test_long_blanks_go_to_the_whole_tokenizer():
    a, _ = ta.sides(alignment_files())
    text = "x" + " " * 200_000 + "y"
    (ids,) = a.encode([text])
    assert a.exact(ids, (" " + text).encode())
    short = "x" + " " * 2500 + "y"
    assert a.encode([short]) == [a.encoding.encode_ordinary(" " + short)]
