import math
import random

import pytest

from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.functions import projection as pr


def ring(*points):
    return f"array({', '.join(geo.vertex(f'{float(x)}D', f'{float(y)}D') for x, y in points)})"


def shape(*rings):
    return geo.polygon(f"array(array({', '.join(ring(*r) for r in rings)}))")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
U_SHAPE = [(0, 0), (6, 0), (6, 5), (5, 5), (5, 1), (1, 1), (1, 5), (0, 5), (0, 0)]


def values(spark, **columns):
    return spark.range(1).select(*[F.expr(c).alias(n) for n, c in columns.items()]).first()


def test_area_and_centroid_with_hole(spark):
    g = shape(SQUARE, HOLE)
    row = values(spark, a=geo.area_planar(g), c=geo.centroid(g))
    assert row.a == 15.0
    assert math.isclose(row.c.xmin, (16 * 2 - 1.5) / 15) and math.isclose(row.c.ymin, (16 * 2 - 1.5) / 15)


def test_centroid_may_lie_outside(spark):
    df = spark.range(1).select(F.expr(shape(U_SHAPE)).alias("g"))
    c = df.select(F.expr(geo.centroid("g")).alias("c"), F.expr(geo.edges("g")).alias("e"))
    row = c.select("c", F.expr(geo.covers_point("e", "c.xmin", "c.ymin")).alias("inside")).first()
    assert not row.inside and 1 < row.c.xmin < 5


def test_direction_does_not_change_measures(spark):
    row = values(spark, a=geo.area_planar(shape(SQUARE[::-1], HOLE[::-1])), b=geo.area_planar(shape(SQUARE, HOLE)))
    assert row.a == row.b


def test_canonical_spelling(spark):
    turned = [(4, 4), (4, 0), (2, 0), (2, 0), (0, 0), (0, 4), (4, 4)]
    row = values(
        spark, same=f"{geo.canonical(shape(SQUARE))} = {geo.canonical(shape(turned))}",
        other=f"{geo.canonical(shape(SQUARE))} = {geo.canonical(shape(SQUARE, HOLE))}",
        hole=f"{geo.canonical(shape(SQUARE, HOLE))} = {geo.canonical(shape(SQUARE, HOLE[::-1]))}",
    )
    assert row.same and not row.other and row.hole


def test_geodesic_area_of_one_degree_cell(spark):
    # 1 x 1 degree with geodesic edges on WGS84; ours has a parallel as upper edge, and the
    # difference falls with the square of the edge length
    row = values(spark, a=geo.area_geodesic(geo.box("10D", "0D", "11D", "1D")))
    assert abs(row.a / 12308778361.469 - 1) < 5e-5
    # the whole ellipsoid: 510065621.724 km2
    row = values(spark, a=geo.area_geodesic(geo.box("-180D", "-90D", "180D", "90D")))
    assert abs(row.a / 510065621724088.4 - 1) < 1e-9


def test_projections(spark):
    x, y = pr.state_plane("-116.25D", f"{32 + 10 / 60!r}D")
    back = pr.state_plane_inverse(*pr.state_plane("-118.3D", "34.1D"))
    mx, my = pr.mercator("-118D", "34D")
    row = values(spark, x=x, y=y, lon=back[0], lat=back[1], mx=mx, my=my)
    assert abs(row.x - 6561666.667) < 1e-3 and abs(row.y - 1640416.667) < 1e-3
    assert abs(row.lon + 118.3) < 1e-10 and abs(row.lat - 34.1) < 1e-10
    assert abs(row.mx + 13135699.91) < 0.01 and abs(row.my - 4028802.03) < 0.01


def test_validity(spark):
    row = values(
        spark, ok=geo.is_valid(shape(SQUARE, HOLE)), open=geo.is_valid(shape(SQUARE[:4])),
        flat=geo.is_valid(shape([(0, 0), (1, 0), (2, 0), (0, 0)])), none=geo.is_valid(f"CAST(NULL AS {geo.GEOMETRY_DDL})"),
        point=geo.is_valid(geo.point("1D", "2D")),
    )
    assert row.ok and row.point and not row.open and not row.flat and not row.none


def box_of(side):
    return tuple(f"{side}.{b}" for b in geo.BOX)


def pair_test(spark, a, b, text):
    df = spark.range(1).select(F.expr(a).alias("a"), F.expr(b).alias("b"))
    df = df.select(
        "a", "b", F.expr(geo.edges("a")).alias("ae"), F.expr(geo.heads("a")).alias("ah"), F.expr(geo.edges("b")).alias("be")
    )
    return df.select(F.expr(text).alias("v")).first().v


def intersects(spark, a, b):
    return pair_test(spark, a, b, geo.polygons_intersect("ae", "ah", "be", box_of("a")))


def contains(spark, a, b):
    return pair_test(spark, a, b, geo.polygon_contains("ae", "be", box_of("b")))


def rect(x0, y0, x1, y1):
    return shape([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def test_polygon_intersects(spark):
    square, holed, u = shape(SQUARE), shape(SQUARE, HOLE), shape(U_SHAPE)
    assert intersects(spark, square, rect(4, 0, 5, 1))             # shared edge
    assert intersects(spark, square, rect(4, 4, 5, 5))             # shared corner
    assert intersects(spark, square, rect(1, 1, 2, 2)) and intersects(spark, rect(1, 1, 2, 2), square)
    assert not intersects(spark, holed, rect(1.2, 1.2, 1.8, 1.8))  # inside the hole
    assert not intersects(spark, u, rect(2, 2, 4, 4))              # in the bay, boxes overlap
    assert intersects(spark, u, rect(2, 0.5, 4, 4))
    assert intersects(spark, rect(-1, 1, 7, 2), u)                 # a cross without inner vertices


def test_polygon_contains(spark):
    square, holed, u = shape(SQUARE), shape(SQUARE, HOLE), shape(U_SHAPE)
    assert contains(spark, square, square)
    assert contains(spark, square, rect(0, 0, 1, 1))
    assert not contains(spark, square, rect(3, 3, 5, 4))
    assert not contains(spark, holed, rect(0.5, 0.5, 3, 3))        # the hole is inside it
    assert not contains(spark, holed, rect(1, 1, 2, 2))            # fills the hole
    diamond = [(2, 1), (3, 2), (2, 3), (1, 2), (2, 1)]
    assert not contains(spark, shape(SQUARE, diamond), rect(1, 1, 3, 3))  # hole inscribed in it
    assert contains(spark, shape(SQUARE, diamond), shape([(1, 1), (2, 1), (1, 2), (1, 1)]))
    assert not contains(spark, u, rect(0, 0, 6, 5))
    # all corners on the boundary, an edge spanning the bay
    assert not contains(spark, u, shape([(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)]))
    assert contains(spark, u, rect(0, 0, 6, 1))


def test_point_on_boundary(spark):
    df = spark.range(1).select(F.expr(shape(SQUARE)).alias("g")).select(F.expr(geo.edges("g")).alias("e"))
    for x, y, covers, inside in [(0, 0, 1, 0), (2, 0, 1, 0), (4, 2, 1, 0), (2, 2, 1, 1), (5, 2, 0, 0), (-1, 4, 0, 0)]:
        row = df.select(
            F.expr(geo.covers_point("e", f"{x}D", f"{y}D")).alias("c"), F.expr(geo.contains_point("e", f"{x}D", f"{y}D")).alias("i")
        ).first()
        assert (row.c, row.i) == (bool(covers), bool(inside))


def test_random_points_against_plain_python(spark):
    rnd = random.Random(7)
    points = [(rnd.uniform(-1, 7), rnd.uniform(-1, 6)) for _ in range(400)]

    def plain(x, y):
        return (0 <= x <= 6 and 0 <= y <= 5) and not (1 < x < 5 and y > 1)

    df = spark.createDataFrame(points, "x double, y double").withColumn("g", F.expr(shape(U_SHAPE)))
    df = df.withColumn("e", F.expr(geo.edges("g")))
    got = df.select("x", "y", F.expr(geo.covers_point("e", "x", "y")).alias("v")).collect()
    assert all(r.v == plain(r.x, r.y) for r in got)


def test_measures_on_the_sphere(spark):
    """An octant, a box with a hole, both directions of a ring, two parts, and a point."""
    import math

    from parcelgrid.sources import tables

    texts = {
        "octant": "POLYGON ((0 0, 90 0, 0 90, 0 0))", "octant back": "POLYGON ((0 0, 0 90, 90 0, 0 0))",
        "ring": "POLYGON ((-1 -1, 1 -1, 1 1, -1 1, -1 -1), (-0.5 -0.5, 0.5 -0.5, 0.5 0.5, -0.5 0.5, -0.5 -0.5))",
        "parts": "MULTIPOLYGON (((10 20, 11 20, 11 21, 10 20)), ((30 20, 31 20, 31 21, 30 20)))", "point": "POINT (5 6)",
        "small": "POLYGON ((-117 34, -116.999 34, -116.999 34.001, -117 34.001, -117 34))",
    }
    df = spark.createDataFrame(list(texts.items()), "name string, wkt string").withColumn("g", F.expr(tables.geometry_from_wkt("wkt")))
    got = {r.name: r for r in df.select("name", F.expr(geo.area_spherical("g", 1.0)).alias("a"), F.expr(geo.centroid_spherical("g")).alias("c"), F.expr(geo.area_geodesic("g")).alias("flat")).collect()}
    for name in ("octant", "octant back"):
        assert got[name].a == pytest.approx(math.pi / 2, rel=1e-12)
        assert got[name].c.xmin == pytest.approx(45, abs=1e-9)
        assert got[name].c.ymin == pytest.approx(math.degrees(math.asin(1 / math.sqrt(3))), abs=1e-9)
    assert got["ring"].a == pytest.approx(0.75 * math.radians(2) ** 2, rel=1e-3)
    assert (got["ring"].c.xmin, got["ring"].c.ymin) == (pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))
    assert got["point"].a == 0.0 and got["point"].c.ymin == 6.0
    assert got["parts"].c.xmin == pytest.approx(20 + 2 / 3, abs=0.01)
    assert got["small"].a * geo.SPHERE_RADIUS**2 == pytest.approx(got["small"].flat, rel=5e-3)
    assert got["small"].c.xmin == pytest.approx(-116.9995, abs=1e-7) and got["small"].c.ymin == pytest.approx(34.0005, abs=1e-7)
