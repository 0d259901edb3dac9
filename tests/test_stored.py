"""Tables stored by grid cell: the same rows, no exchange of the stored side, dense cells in parts."""

import re

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.operators import spatial, stored


def boxes(spark, n, prefix, size, crowded=0):
    """Boxes over a square of 10 degrees, the first ``crowded`` of them in one corner."""
    at = lambda k: f"CASE WHEN id < {crowded} THEN 0.01D * (id % {k}) / {k} ELSE pmod(xxhash64(id, {k}), 10000) / 1000D END"
    rows = spark.range(n).selectExpr(f"concat('{prefix}', id) AS {prefix}_id", f"{at(97)} AS x", f"{at(89)} AS y")
    shape = geo.box("x", "y", f"x + {size}", f"y + {size}")
    return rows.select(f"{prefix}_id", F.expr(shape).alias("geometry"))


def pairs(df):
    return sorted((r.a_id, r.b_id or "") for r in df.select("a_id", "b_id").collect())


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_stored_join_moves_only_the_other_side(spark, tmp_path, no_broadcast):
    a, b = boxes(spark, 3000, "a", "0.02D"), boxes(spark, 400, "b", "0.3D")
    path = str(tmp_path / "table")
    stored.save_bucketed(a, path, cell=0.1, buckets=6)
    held = stored.load_bucketed(spark, path)
    for how in ("inner", "left"):
        joined = held.join(b, "intersects", how)
        assert joined.columns == ["a_id", "geometry", "b_id"]
        assert pairs(joined) == pairs(spatial.spatial_join(a, b, "intersects", how, cell=0.1))
    plan = held.join(b, "intersects", "inner")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "cell_cx" in line)
    assert "Bucketed: true" in scan
    shuffles = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert shuffles and all("_d_" not in line and "cell_cx" not in line for line in shuffles)
    plain = spatial.spatial_join(a, b, "intersects", "inner", cell=0.1)._jdf.queryExecution().executedPlan().toString()
    assert any("_d_cx" in line for line in plain.splitlines() if "Exchange hashpartitioning" in line)


def test_half_the_rows_in_one_cell(spark, tmp_path, no_broadcast):
    """The crowded cell is dealt over many buckets, and no pair is lost or made twice."""
    a, b = boxes(spark, 4000, "a", "0.004D", crowded=2000), boxes(spark, 60, "b", "0.5D", crowded=5)
    want = pairs(spatial.spatial_join(a, b, "intersects", "left", cell=0.1))
    path = str(tmp_path / "table")
    stored.save_bucketed(a, path, cell=0.1, buckets=8, crowd=100)
    held = stored.load_bucketed(spark, path)
    assert held.dense.count() == 1 and held.dense.first().parts == 20
    largest = max(r["count"] for r in held.rows.groupBy(F.spark_partition_id()).count().collect())
    assert largest <= 4000 / 8 * 2
    assert pairs(held.join(b)) == want
    assert pairs(spatial.spatial_join(a, b, "intersects", "left", cell=0.1, crowd=100)) == want
    for how in ("left_semi", "left_anti"):
        test = spatial._pair_test("intersects", False, False)
        plain, split = (spatial.grid_join(a, b, test, how, cell=0.1, crowd=c) for c in (None, 100))
        assert sorted(r.a_id for r in plain.collect()) == sorted(r.a_id for r in split.collect())


def test_rows_without_a_shape_and_empty_tables(spark, tmp_path):
    a, b = boxes(spark, 20, "a", "0.02D"), boxes(spark, 5, "b", "5D")
    odd = a.withColumn("geometry", F.when(F.col("a_id") != "a3", F.col("geometry")))
    path = str(tmp_path / "table")
    stored.save_bucketed(odd, path, cell=0.1, buckets=3, crowd=2)
    assert pairs(stored.load_bucketed(spark, path).join(b)) == pairs(spatial.spatial_join(odd, b, cell=0.1))
    stored.save_bucketed(odd.limit(0), path, cell=0.1, buckets=3)
    assert stored.load_bucketed(spark, path).join(b).count() == 0
    with pytest.raises(ValueError, match="named like grid keys"):
        stored.save_bucketed(a.withColumn("cell_k", F.lit(1)), path, cell=0.1, buckets=3)


def test_versions_are_put_in_place_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    stored.save_bucketed(boxes(spark, 10, "a", "0.02D"), path, cell=0.1, buckets=2)
    first = stored.load_bucketed(spark, path)
    failing = boxes(spark, 20, "a", "0.02D").withColumn("a_id", F.expr("CASE WHEN a_id = 'a7' THEN raise_error('no') ELSE a_id END"))
    with pytest.raises(Exception, match="no"):
        stored.save_bucketed(failing, path, cell=0.1, buckets=2)
    assert stored.load_bucketed(spark, path).rows.count() == 10
    stored.save_bucketed(boxes(spark, 30, "a", "0.02D"), path, cell=0.1, buckets=4)
    assert first.rows.count() == 10 and stored.load_bucketed(spark, path).rows.count() == 30
    again = spark.newSession()
    for row in again.sql("SHOW TABLES LIKE 'stored_*'").collect():
        again.sql(f"DROP TABLE {row.tableName}")
    other = stored.load_bucketed(again, path)
    assert other.rows.count() == 30 and "Bucketed" in other.rows._jdf.queryExecution().executedPlan().toString()
