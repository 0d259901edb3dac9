from collections import defaultdict

from pyspark.sql import functions as F

from parcelgrid.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, window string"


def build(rows):
    return [(*r, "clash", "w") for r in rows]


def test_rotation_and_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 4, None, "?")]
    out = {r.perspective: r for r in cf.perspectives(spark.createDataFrame(build(rows), SCHEMA)).collect()}
    assert set(out) == {"ann", "bob"}
    assert out["ann"].text == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
        "<|user name=unknown|>\n?<|end|>\n"
    )
    assert [out["ann"].text[s.start : s.end] for s in out["ann"].spans] == ["hi < |end|><|end|>\n", "<|end|>\n"]
    assert [out["bob"].text[s.start : s.end] for s in out["bob"].spans] == ["yo<|end|>\n"]


def test_long_and_crowded_conversations(spark):
    """Pieces are bounded, hold every turn once, and are in order."""
    rows = [(1, i, f"p{i % 3}", f"t{i}") for i in range(1000)] + [(2, 5, "p0", f"tie {i}") for i in range(2000)] + [(2, 6, "p1", "after")]
    rows += [(3, None, "p0", "no turn"), (None, 0, "p0", "no conversation"), (4, 0, "system", "alone"), (5, 0, "p0", "twice"), (5, 0, "p0", "twice")]
    table = spark.createDataFrame(build(rows), SCHEMA)
    out = cf.perspectives(table).orderBy("conv_id", "perspective", F.col("first_turn").asc_nulls_first(), "part").collect()
    text, turns = defaultdict(str), defaultdict(int)
    for r in out:
        assert r.n_turns <= 3 * cf.WINDOW
        text[(r.conv_id, r.perspective)] += r.text
        turns[(r.conv_id, r.perspective)] += r.n_turns
    assert turns[(1, "p1")] == 1000 and turns[(2, "p0")] == turns[(2, "p1")] == 2001
    assert turns[(3, "p0")] == turns[(None, "p0")] == turns[(5, "p0")] == 1 and (4, "system") not in turns
    body = [x.split("\n")[1].removesuffix("<|end|>") for x in text[(1, "p0")].split("<|end|>\n") if x]
    assert body == [f"t{i}" for i in range(1000)]
    assert all(text[(2, "p0")].count(f"tie {i}<") == 1 for i in range(2000)) and text[(2, "p1")].rstrip().endswith("after<|end|>")


def test_empty(spark):
    assert cf.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
