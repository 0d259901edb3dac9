import corpus_pipeline as cp

from parcelgrid.llm import decontaminate, line_dedup, quality_rules, simhash
from parcelgrid.sources.tables import materialise


def test_stages_keep_columns_and_take_effect(spark, sf_dir, docs):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    now, held = docs, [docs]
    for _, stage in cp.STAGES:
        now = materialise(stage(spark, now, sf_dir))
        held.append(now)
    assert all(h.columns == docs.columns for h in held[:5])
    good, cut, one, clean, packed = held[1:]
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == {r.doc_id: r.text for r in line_dedup.dedup_lines(good).collect()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    groups = simhash.near_duplicates(cut).collect()
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in groups}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contaminated(one, items).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run_equals_the_stages(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert rows and max(fills.values()) <= 4096


def test_odd_documents_pass(spark, sf_dir, odd_docs, no_docs):
    for table in (odd_docs.withColumnRenamed("n_words", "n_chars"), no_docs):
        now = table
        for _, stage in cp.STAGES[:-1]:
            now = materialise(stage(spark, now, sf_dir))
            assert now.columns == table.columns
        cp.STAGES[-1][1](spark, now, sf_dir).collect()


def test_near_copies_are_joined_by_simhash_and_by_shingles(spark, sf_dir):
    """1 and 2 share most of their shingles' occurrences, but few of their distinct ones; 3 and 4 the reverse."""
    loop = " ".join(f"loop{i}" for i in range(21))
    first, second = (" ".join([loop] * 60 + [f"{x}{i}" for i in range(40)]) for x in "yz")
    words = [f"w{i}" for i in range(100)]
    third, fourth = " ".join(words), " ".join([*words[:50], "other", *words[51:]])
    a, b, c, d = (simhash.fingerprint(t.encode()) for t in (first, second, third, fourth))
    assert (a ^ b).bit_count() <= 2 < (c ^ d).bit_count()
    table = spark.createDataFrame([(1, first), (2, second), (2, second), (3, third), (4, fourth), (5, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_copies(spark, table, sf_dir).collect()) == [1, 3, 5]
