from pyspark.sql import functions as F

from parcelgrid.functions import semantics as s
from parcelgrid.operators import relational as rel


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_missing_condition_gives_missing(spark):
    null = F.lit(None).cast("int")
    row = one(spark, a=s.if_else(null > 1, 1, 0), b=s.first_match([(null > 1, 1)], default=7))
    assert row.a is None and row.b == 7


def test_half_even_at_negative_digits(spark):
    row = one(
        spark,
        a=s.half_even(F.lit(2500.0), -3), b=s.half_even(F.lit(3500.0), -3),
        c=s.half_even(F.lit(250000.0), -5), d=s.half_even(F.lit(0.5), 0),
    )
    assert (row.a, row.b, row.c, row.d) == (2000.0, 4000.0, 200000.0, 0.0)


def test_text_helpers(spark):
    row = one(
        spark,
        number=s.to_number(F.lit(" 12.5 ")), suffix=s.to_number(F.lit("12d")), word=s.to_number(F.lit("n/a")),
        part=s.slice_text(F.lit("abcdef"), 2, 4), low=s.slice_text(F.lit("abcdef"), 0, 2),
        none=s.slice_text(F.lit("abc"), F.lit(None).cast("int"), 2),
        end=s.locate_end(F.lit("x CA 9"), " CA "), no_end=s.locate_end(F.lit("x"), " CA "),
        first=s.replace_first(F.lit("a~b~c"), "~", "$"), squished=s.squish(F.lit("  a \t b ")),
        pasted=s.paste(F.lit("a"), F.lit(None).cast("int")),
    )
    assert row.number == 12.5 and row.suffix is None and row.word is None
    assert row.part == "bcd" and row.low == "ab" and row.none is None
    assert row.end == 5 and row.no_end is None
    assert row["first"] == "a$b~c" and row.squished == "a b" and row.pasted == "a NA"


def test_snake_case():
    names = {
        "NOx_TOTEX": "n_ox_totex", "PM2.5_Total": "pm2_5_total", "Shape__Area": "shape_area",
        "Total VMT": "total_vmt", "YearBuilt1": "year_built1", "UseCode_2": "use_code_2", "CO2_TOTEX": "co2_totex",
    }
    assert {k: s.snake_case(k) for k in names} == names


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    v = F.col("v")
    got = {r.k: (r.t, r.m, r.n) for r in df.groupBy("k").agg(
        s.sum_strict(v).alias("t"), s.mean_strict(v).alias("m"), s.min_strict(v).alias("n")).collect()}
    assert got == {"a": (None, None, None), "b": (2.0, 2.0, 2.0)}


def test_sequential_columns(spark):
    row = s.with_cols(spark.range(1), [("a", F.lit(2)), ("b", F.col("a") * 3)]).first()
    assert row.b == 6


def test_natural_join_matches_missing_and_stays_equi(spark):
    left = spark.createDataFrame([(1, "x", None), (2, None, None)], "id int, k string, j string")
    right = spark.createDataFrame([("x", None, 9), (None, None, 8)], "k string, j string, v int")
    out = rel.natural_join(left, right)
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, 9), (2, 8)]
    assert rel.natural_join(left, right, "left_anti").count() == 0
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k for r in rel.not_in(df, "k", ids).collect()} == {"b", None}
    assert [r.k for r in rel.is_in(df, "k", ids).collect()] == ["a"]


def test_slice_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS page", "id AS line_no", "CAST(id AS STRING) AS line")
    out = rel.slice_rows(df, 6, 8, by=["page"], order=["line_no"])
    assert sorted(r.line_no for r in out.collect()) == [10, 11, 12, 13, 14, 15]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_do_not_depend_on_the_bins(spark):
    # one group holds most rows, half of them one value
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 8 THEN 'hot' ELSE 'cold' END AS g",
        "CASE WHEN id % 2 = 0 THEN 5.0D ELSE CAST((id * 7919) % 1009 AS DOUBLE) END AS v",
    )
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in ps])).alias("q")).collect()}
    for bins in (2, 7, 128):
        got = {r.g: r.quantiles for r in rel.exact_quantiles(df, ["g"], "v", ps, bins=bins).collect()}
        assert set(got) == set(want)
        for g in want:
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g]))
    whole = rel.exact_quantiles(df, [], "v", [0.5]).first().quantiles
    assert abs(whole[0] - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9


def test_quantile_ranking_is_bounded(spark):
    """One group of distinct values: what one task ranks at the end is a small part of it."""
    df = spark.range(20_000).selectExpr("'all' AS g", "CAST((id * 7919) % 20011 AS DOUBLE) AS v")
    pool = rel._quantile_candidates(df, ["g"], "v", [0.25, 0.5, 0.9], 8, 3)
    largest = max(r["count"] for r in pool.groupBy("g", "_bin").count().collect())
    assert largest <= 4 * 20_000 / 8**3
    got = rel.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9], bins=8, levels=3).first().quantiles
    want = df.select(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
