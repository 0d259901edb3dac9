"""Relational operators with the source analysis' rules for missing values and order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise


def not_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose value is not listed; a missing value is kept. ``ids`` has one column."""
    listed = ids.select(F.col(ids.columns[0]).alias("_listed")).distinct()
    return df.join(listed, df[column] == listed["_listed"], "left_anti")


def is_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose value is listed, each once however often it is listed."""
    listed = ids.select(F.col(ids.columns[0]).alias("_listed")).distinct()
    return df.join(listed, df[column] == listed["_listed"], "left_semi")


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    *,
    on: Sequence[str] | None = None,
    exclude: Sequence[str] = ("geometry",),
) -> DataFrame:
    """Join on all shared columns (or ``on``), where a missing value matches a missing value.

    ``eqNullSafe`` keys stay equi-join keys, so the join is hashed or sorted, never nested.
    A semi or anti join first reduces the right side to its distinct keys, so copies on the
    right cost one row each.
    """
    keys = list(on) if on is not None else [
        c for c in left.columns if c in right.columns and c not in exclude
    ]
    if not keys:
        raise ValueError("the two tables share no column")
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()
    else:
        right = right.drop(*[c for c in exclude if c not in keys and c in left.columns])
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """A dense row number from 1 in the order of ``order``; ties in the order of a hash of the row.

    Rows are range-partitioned and sorted, each task numbers its own, and the counts of the
    tasks before (one small row for each task) are added. No task sees more than its range.
    """
    keys = [F.col(c) for c in order]
    tie = F.xxhash64(*df.columns).alias("_tie")
    dealt = df.select("*", tie).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    numbered = materialise(
        dealt.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = numbered.join(F.broadcast(starts), "_part")  # as many rows as tasks wrote
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def hash_ids(df: DataFrame, by: Sequence[str], name: str = "row_id") -> DataFrame:
    """An id that depends on the given columns only, so it stays when other rows come or go."""
    return df.withColumn(name, F.xxhash64(*by))


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union all by name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def concat_pages(pages: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Page tables with positional headers to one table with the given names."""
    return reduce(DataFrame.unionByName, [p.toDF(*names) for p in pages])


def slice_rows(
    df: DataFrame, first: int, last: int, *, by: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Rows ``first``..``last`` (1-based) of every group in the given order.

    The upper bound is a plain ``row_number() <= last``, so Spark keeps at most ``last`` rows
    of a group per task before the shuffle: a group of any size stays cheap.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= last)
    return ranked.where(F.col("_row") >= first).drop("_row")


def keep_first(df: DataFrame, by: Sequence[Column], order: Sequence[Column | str]) -> DataFrame:
    """The least row of every group; one row per group and task is shuffled."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= 1).drop("_row")


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """Per group a mergeable sketch of its values (columns ``by`` and ``sketch``), to keep beside the table.

    Partial sketches are merged before and after the shuffle, so a group of any size sends one per
    task. A quantile's rank is off by about 0.7 % at k = 400, half of that at twice the k. NULLs do not count.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Columns ``by`` and ``quantiles`` of what the groups' kept sketches hold together; values as they occur."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_all"))
    return merged.select(*by, F.kll_sketch_get_quantile_double("_all", wanted).alias("quantiles"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    bins: int = 128,
    levels: int = 2,
) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``by`` and ``quantiles`` (an array).

    A group may hold most of the table, so its values never meet in one task. Equal values
    are first counted; a sketch then only proposes bin edges, the bins' counts tell which
    bins hold the wanted ranks, and only those bins go on. They are binned again at each
    further level, so what is ranked in one task at the end is about one in bins ** levels of a
    group's distinct values. The answer does not depend on how good the sketches are.
    """
    by = list(by)
    groups = [F.col(c) for c in by]
    pool = _quantile_candidates(df, by, value, probabilities, bins, levels)
    within = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = pool.withColumn("_end", F.col("_before") + F.sum("_n").over(within))
    hits = ranked.select(
        *groups, "_v", "_n", "_end", F.explode("_ranks").alias("_r")
    ).where((F.col("_r._rank") < F.col("_end")) & (F.col("_r._rank") >= F.col("_end") - F.col("_n")))
    per = hits.groupBy(*by, F.col("_r._i").alias("_i")).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.min_by("_r._weight", "_v").alias("_share"),
    )
    quantile = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.lit(1.0) - F.col("_share"))
    quantile = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(quantile)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_i"), quantile.alias("q"))))
    return per.groupBy(*by).agg(F.transform(ordered, lambda s: s["q"]).alias("quantiles"))


def _quantile_candidates(
    df: DataFrame, by: list[str], value: str, probabilities: Sequence[float], bins: int, levels: int
) -> DataFrame:
    """(by, _v, _n, _bin, _before, _ranks): the counted values of the bins that hold a wanted rank.

    Counts and each level's values are written, since sketch, sizes and choice all read them.
    """
    groups = [F.col(c) for c in by]
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    counts = materialise(known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))

    # 0-based ranks on both sides of each wanted position
    ranks = []
    for i, p in enumerate(probabilities):
        at = (F.col("_all") - 1) * F.lit(float(p))
        low = F.floor(at)
        part = at - low
        ranks += [
            F.struct(F.lit(i).alias("_i"), low.alias("_rank"), (F.lit(1.0) - part).alias("_weight")),
            F.struct(F.lit(i).alias("_i"), (low + 1).alias("_rank"), part.alias("_weight")),
        ]
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    wanted = totals.select(
        *groups,
        F.lit(0).cast("long").alias("_bin"),
        F.filter(F.array(*ranks), lambda r: r["_weight"] > 0).alias("_ranks"),
        F.lit(0).cast("long").alias("_before"),
    )
    pool = _beside(counts, wanted.select(*by, "_bin", "_before", "_ranks"), by)
    cut_at = [i / bins for i in range(1, bins)]
    for _ in range(levels):
        cuts = pool.groupBy(*by, "_bin").agg(F.percentile_approx("_v", cut_at, 10 * bins).alias("_cuts"))
        position = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col("_v")))
        finer = _beside(pool, cuts, [*by, "_bin"]).withColumn("_part", position).drop("_cuts")
        # at most `bins` rows for each bin of the level before
        running = Window.partitionBy(*by, "_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        sizes = finer.groupBy(*by, "_bin", "_part").agg(
            F.sum("_n").alias("_size"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks")
        )
        sizes = sizes.withColumn("_upto", F.col("_before") + F.sum("_size").over(running))
        first = F.col("_upto") - F.col("_size")
        held = F.filter(F.col("_ranks"), lambda r: (r["_rank"] >= F.col("_upto") - F.col("_size")) & (r["_rank"] < F.col("_upto")))
        wanted = sizes.withColumn("_held", held).where(F.size("_held") > 0).select(
            *groups, "_bin", "_part", F.col("_held").alias("_ranks"), first.alias("_before")
        )
        pool = natural_join(finer.drop("_before", "_ranks"), wanted, "inner", on=[*by, "_bin", "_part"])
        pool = materialise(pool.withColumn("_bin", F.col("_bin") * bins + F.col("_part")).drop("_part"))
    return pool


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join where a missing key matches itself; without keys, the right side is one row."""
    if keys:
        return natural_join(left, right, "inner", on=keys)
    one = right.select(F.struct(*right.columns).alias("_one"))
    return left.withColumn("_one", one.scalar()).select("*", "_one.*").drop("_one")
