import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.operators import spatial as sp


def boxes(spark, rows, names="id"):
    df = spark.createDataFrame(rows, f"{names} int, x0 double, y0 double, x1 double, y1 double")
    return df.select(names, F.expr(geo.box("x0", "y0", "x1", "y1")).alias("geometry"))


def sample(n, seed, large=0.0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        size = rnd.uniform(0.5, 4) if rnd.random() < large else rnd.uniform(0.01, 0.2)
        out.append((i, x, y, x + size, y + size * rnd.uniform(0.3, 1)))
    return out


def overlap(a, b):
    return a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [0.05, 0.3, 2.0])
def test_mixed_sizes_match_all_pairs(spark, cell):
    a, b = sample(120, 1, 0.1), sample(90, 2, 0.2)
    want = {(l[0], r[0]) for l in a for r in b if overlap(l, r)}
    left, right = boxes(spark, a), boxes(spark, b, "rid")
    inner = sp.spatial_join(left, right, "intersects", "inner", cell=cell)
    rows = [(r.id, r.rid) for r in inner.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    outer = sp.spatial_join(left, right, "intersects", "left", cell=cell)
    lonely = {l[0] for l in a} - {i for i, _ in want}
    assert {(r.id, r.rid) for r in outer.collect()} == want | {(i, None) for i in lonely}
    semi = {r.id for r in sp.spatial_semi(left, right, cell=cell).collect()}
    anti = {r.id for r in sp.spatial_anti(left, right, cell=cell).collect()}
    assert semi == {i for i, _ in want} and anti == lonely
    within = {(r.id, r.rid) for r in sp.spatial_join(left, right, "within", "inner", cell=cell).collect()}
    assert within == {
        (l[0], r[0]) for l in a for r in b if l[1] >= r[1] and l[3] <= r[3] and l[2] >= r[2] and l[4] <= r[4]
    }
    for df in (inner, outer):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df) and "Python" not in plan(df)


def test_same_answer_without_broadcast(spark):
    a, b = sample(150, 3, 0.1), sample(80, 4, 0.2)
    left, right = boxes(spark, a), boxes(spark, b, "rid")
    want = {(l[0], r[0]) for l in a for r in b if overlap(l, r)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = sp.spatial_join(left, right, "intersects", "inner", cell=0.1)
        assert "SortMergeJoin" in plan(out)
        assert {(r.id, r.rid) for r in out.collect()} == want
        anti = {r.id for r in sp.spatial_anti(left, right, cell=0.1).collect()}
        assert anti == {l[0] for l in a} - {i for i, _ in want}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_missing_geometry_is_kept_by_left_and_anti(spark):
    left = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)]).unionByName(
        spark.range(1).select(F.lit(2).alias("id"), F.lit(None).cast(geo.GEOMETRY_DDL).alias("geometry"))
    )
    right = boxes(spark, [(9, 0.5, 0.5, 2.0, 2.0)], "rid")
    assert {(r.id, r.rid) for r in sp.spatial_join(left, right, cell=0.5).collect()} == {(1, 9), (2, None)}
    assert [r.id for r in sp.spatial_anti(left, right, cell=0.5).collect()] == [2]


def test_hot_cell_is_split(spark):
    """A third of the rows in one cell: adaptive execution splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        points = spark.range(0, 30000, 1, 8).select(
            "id",
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
            F.expr(
                    geo.point("if(id % 3 = 0, 0.5D, id * 7 % 997 / 10D)", "if(id % 3 = 0, 0.5D, id * 13 % 991 / 10D)")
                ).alias("geometry"),
        )
        places = boxes(spark, [(i, float(i % 10) * 10, float(i // 10) * 10, i % 10 * 10 + 9.0, i // 10 * 10 + 9.0) for i in range(100)], "pid")
        out = sp.spatial_join(points, places, "intersects", "left", cell=10.0, left_points=True)
        out = out.select("id", "payload", "pid")
        rows = out.collect()
        assert len(rows) == 30000
        assert sum(1 for r in rows if r.id % 3 == 0 and r.pid == 0) == 10000
        assert "skew=true" in plan(out)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_container_join_matches(spark):
    big = boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, 8.0, 8.0, 9.0, 9.0)], "cid")
    small = boxes(spark, [(10, 0.1, 0.1, 0.2, 0.2), (11, 1.5, 1.5, 1.6, 1.6), (12, 2.5, 0.5, 2.6, 0.6)])
    out = sp.container_join(big, small, "contains", "left", key="cid", cell=0.5)
    assert {(r.cid, r.id) for r in out.collect()} == {(1, 10), (1, 11), (2, 11), (3, None)}


def test_circle_modes_and_batch(spark):
    df = boxes(spark, [(1, -118.001, 33.999, -117.999, 34.001), (2, -117.96, 34.0, -117.959, 34.001), (3, -117.9, 34.0, -117.89, 34.01)])
    circle = {r.id for r in sp.in_circle(df, -118.0, 34.0, 4.0).collect()}
    ground = {r.id for r in sp.in_circle(df, -118.0, 34.0, 4.0, "ground").collect()}
    # 0.041 degrees are 4.56 km on the map but 3.78 km on the ground
    assert circle == {1} and ground == {1, 2}
    circles = spark.createDataFrame([("a", -118.0, 34.0, 4.0), ("b", -117.95, 34.0, 20.0)], "c string, lon double, lat double, radius_km double")
    got = {(r.c, r.id) for r in sp.in_circles(df, circles, cell=0.05).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2), ("b", 3)}


def test_parts_and_vertices(spark):
    two = spark.range(1).select(
        F.lit("m").alias("k"),
        F.expr(geo.polygon(f"concat({geo.box('0D', '0D', '1D', '1D')}.rings, {geo.box('5D', '5D', '6D', '7D')}.rings)")).alias("geometry"),
    )
    parts = sp.explode_parts(two).select("k", "geometry.xmin", "geometry.ymax").collect()
    assert sorted((r.k, r.xmin, r.ymax) for r in parts) == [("m", 0.0, 1.0), ("m", 5.0, 7.0)]
    first = sp.explode_parts(two).where("geometry.xmin = 0")
    patched = sp.patch_vertices(first, [("x", 2, 3, 9.0)])
    again = sp.ring_from_points(sp.vertices_table(patched, ["k"]), ["k"], "pos", "x", "y")
    assert again.select(F.expr(geo.area_planar("geometry"))).first()[0] == 9.0


def test_region_difference(spark):
    region = boxes(spark, [(1, -117.3, 33.8, -117.0, 34.0)], "r")
    minus = boxes(spark, [(1, -117.2, 33.85, -117.15, 33.9)], "m")
    rows = [(1, -117.25, 33.95), (2, -117.18, 33.87), (3, -117.2005, 33.87), (4, -117.22, 33.87), (5, -116.5, 33.87)]
    points = spark.createDataFrame(rows, "id int, x double, y double").select("id", F.expr(geo.point("x", "y")).alias("geometry"))
    # point 3 is 46 m from the cut-out
    got = {r.id for r in sp.region_difference(points, region, minus, 100.0, cell=0.1).collect()}
    assert got == {1, 4}
    assert {r.id for r in sp.region_difference(points, region, minus, 10.0, cell=0.1).collect()} == {1, 3, 4}


def _boundaries(spark):
    rows = [("A County", 0.0, 0.0, 10.0, 10.0), ("B County", 10.0, 0.0, 20.0, 10.0)]
    table = spark.createDataFrame(rows, "county string, x0 double, y0 double, x1 double, y1 double")
    return table.select("county", F.expr(geo.box("x0", "y0", "x1", "y1")).alias("geometry"))


def _jobs(spark, build):
    """Result and number of Spark jobs while a query is built."""
    group = f"build-{build.__name__}-{id(build)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = build()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def test_boundaries_are_broadcast(spark):
    from parcelgrid.plans import planned

    combined = spark.range(100).selectExpr("CAST(id AS STRING) AS apn", "'x' AS county", "id * 0.15D AS x").select(
        "apn", "county", F.expr(geo.box("x", "x / 2", "x + 0.1D", "x / 2 + 0.1D")).alias("geometry")
    )
    counties = _boundaries(spark)
    places = counties.select(F.col("county").alias("name"), "geometry")
    plan = planned.locate(combined, counties, places)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_wide_boundaries_are_not_broadcast(spark, monkeypatch):
    counties = _boundaries(spark).withColumn("wide", F.repeat(F.hex(F.rand(1)), 2000))
    points = spark.range(50).select("id", F.expr(geo.point("id * 0.3D", "2D")).alias("geometry"))

    def plan():
        out = sp.spatial_join(points, counties, cell=5.0, left_points=True, boundary=True)
        return out._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(sp, "_BROADCAST_BYTES", 1000)
    assert "strategy=broadcast" not in plan()


def test_no_job_runs_while_a_join_is_built(spark):
    left = spark.range(50).select("id", F.expr(geo.point("id * 0.3D", "2D")).alias("geometry"))
    right = _boundaries(spark)
    _, none = _jobs(spark, lambda: sp.spatial_join(left, right, cell=5.0, left_points=True))
    _, semi = _jobs(spark, lambda: sp.spatial_semi(left, right, cell=5.0, left_points=True))
    _, written = _jobs(spark, lambda: sp.spatial_join(left, right, cell=5.0, left_points=True, boundary=True))
    assert (none, semi) == (0, 0) and 1 <= written <= 2


def test_is_box(spark):
    rings = {
        "box": "0 0, 2 0, 2 1, 0 1, 0 0",
        "turned": "2 1, 2 0, 1 0, 0 0, 0 1, 2 1",
        "bow tie": "0 0, 2 1, 2 0, 0 1, 0 0",
        "there and back": "0 0, 2 0, 2 1, 2 0, 0 0",
        "open": "0 0, 2 0, 2 1, 0 1, 0 0.5",
        "ell": "0 0, 2 0, 2 0.5, 1 0.5, 1 1, 0 1, 0 0",
        "triangle": "0 0, 2 0, 2 1, 0 0",
        "twice": "0 0, 2 0, 2 1, 0 1, 0 0, 2 0, 2 1, 0 1, 0 0",
        "flat": "0 0, 2 0, 2 0, 0 0, 0 0",
    }
    rows = [(name, [[float(c) for c in v.split()] for v in text.split(",")]) for name, text in rings.items()]
    df = spark.createDataFrame(rows, "name string, ring array<array<double>>")
    shape = geo.ring_polygon(f"transform(ring, p -> {geo.vertex('p[0]', 'p[1]')})")
    shapes = df.select("name", F.expr(shape).alias("geometry"))
    two = shapes.where("name = 'box'").select(F.lit("with a hole").alias("name"), F.expr(geo.polygon("array(concat(geometry.rings[0], geometry.rings[0]))")).alias("geometry"))
    point = spark.range(1).select(F.lit("point").alias("name"), F.expr(geo.point("1D", "2D")).alias("geometry"))
    found = shapes.unionByName(two).unionByName(point).where(F.expr(geo.is_box("geometry"))).collect()
    assert sorted(r["name"] for r in found) == ["box", "turned"]


def test_unfolding_index_is_not_broadcast(spark):
    """The planner takes 20,000 boxes for small, without the cells and segments that they unfold to."""
    right = spark.range(20000).select(F.col("id").alias("rid"), F.expr(geo.box("id * 0.001D", "0D", "id * 0.001D + 0.0009D", "0.001D")).alias("geometry"))
    left = spark.range(100).select("id", F.expr(geo.box("id * 0.1D", "0D", "id * 0.1D + 0.0005D", "0.0005D")).alias("geometry"))
    out = sp.spatial_join(left, right, "intersects", "inner", cell=0.001)
    assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert sorted((r.id, r.rid) for r in out.collect()) == [(i, i * 100) for i in range(100)]
    few = sp.spatial_join(left, right.limit(10), "intersects", "inner", cell=0.001)
    assert "SortMergeJoin" not in plan(few)


def _some_triangles(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-118.1, -117.9), rnd.uniform(33.9, 34.1)
        rows.append((i, [(x + rnd.uniform(0, 0.01), y + rnd.uniform(0, 0.01)) for _ in range(3)]))
    df = spark.createDataFrame([(i, [*v, v[0]]) for i, v in rows], "id int, ring array<struct<x:double,y:double>>")
    return rows, df.select("id", F.expr(geo.ring_polygon("ring")).alias("geometry"))


@pytest.mark.parametrize("cell", [0.004, 0.05])
def test_circles_match_all_pairs(spark, cell):
    """The box on the map decides most pairs; shapes at the rim are told by their vertices."""
    import math

    def on_map(x, y):
        return 6378137.0 * math.radians(x), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(y) / 2))

    rows, shapes = _some_triangles(spark, 300, 5)
    rnd = random.Random(6)
    circles = [(f"c{i}", rnd.uniform(-118.1, -117.9), rnd.uniform(33.9, 34.1), rnd.choice([0.5, 2.0, 6.0])) for i in range(40)]
    want = set()
    for c, lon, lat, km in circles:
        cx, cy = on_map(lon, lat)
        want |= {(c, i) for i, vs in rows if all(math.dist(on_map(*v), (cx, cy)) <= km * 1000 for v in vs)}
    table = spark.createDataFrame(circles, "c string, lon double, lat double, radius_km double")
    out = sp.in_circles(shapes, table, cell=cell)
    got = [(r.c, r.id) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert out.columns == ["id", "geometry", "c", "lon", "lat", "radius_km"]
    assert "_m_xmin" in plan(out)


def _rows_written(monkeypatch, *modules):
    written = []

    def spy(df, path=None):
        out = materialise(df, path)
        written.append(out.count())
        return out

    from parcelgrid.sources.stages import materialise

    for module in modules:
        monkeypatch.setattr(module, "materialise", spy)
    return written


def test_merged_sources_write_no_pairs(spark, monkeypatch):
    """40 rows of each source on one spot are 1600 pairs; rows of the first that touch come once."""
    from parcelgrid.plans import parcels

    def stacked(n, x, prefix):
        return spark.range(n).selectExpr(f"concat('{prefix}', CAST(id % 30 AS STRING)) AS apn", "160000D AS shape_area").withColumn(
            "geometry", F.expr(geo.box(f"{x}D", "0D", f"{x}D + 0.001D", "0.001D"))
        )

    first = stacked(40, 0.0, "a").unionByName(stacked(35, 1.0, "b"))
    second = stacked(40, 0.0005, "c").unionByName(stacked(33, 2.0, "d"))
    written = _rows_written(monkeypatch, parcels, sp)
    got = parcels.merge_sources(first, second).groupBy(F.substring("apn", 1, 1).alias("k")).count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 30, "b": 35, "d": 33}
    assert max(written) <= 75


def test_container_pairs_are_not_written(spark, monkeypatch):
    big = boxes(spark, [(i, 0.0, 0.0, 2.0, 2.0) for i in range(30)] + [(77, 5.0, 5.0, 6.0, 6.0)], "cid")
    small = boxes(spark, [(i, 0.5, 0.5, 0.6, 0.6) for i in range(30)])
    written = _rows_written(monkeypatch, sp)
    out = sp.container_join(big, small, "contains", "left", key="cid", cell=3.0)
    got = [(r.cid, r.id) for r in out.collect()]
    assert len(got) == 901 and set(got) == {(c, i) for c in range(30) for i in range(30)} | {(77, None)}
    assert max(written, default=0) < 200
