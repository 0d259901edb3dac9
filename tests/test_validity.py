"""Shapes whose rings cross, or lie in the wrong place, are told with their reason."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.operators import spatial
from parcelgrid.sources import tables

SHAPES = {
    "square": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", None),
    "with a hole": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", None),
    "hole touches the shell": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 1, 1 2, 0 0))", None),
    "two parts": ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", None),
    "parts touch": ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))", None),
    "island in a lake": ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1)), ((3 3, 4 3, 4 4, 3 4, 3 3)))", None),
    "point": ("POINT (1 1)", None),
    "bow tie": ("POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "no area"),
    "uneven bow tie": ("POLYGON ((0 0, 4 4, 4 0, 0 3, 0 0))", "crossing rings"),
    "spike": ("POLYGON ((0 0, 4 0, 4 4, 4 9, 4 4, 0 4, 0 0))", "crossing rings"),
    "hole crosses the shell": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (3 1, 6 1, 6 2, 3 2, 3 1))", "crossing rings"),
    "hole outside": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (6 1, 7 1, 7 2, 6 2, 6 1))", "hole outside its shell"),
    "part in a part": ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)), ((3 3, 4 3, 4 4, 3 4, 3 3)))", "overlapping parts"),
    "parts cross": ("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((3 3, 7 3, 7 7, 3 7, 3 3)))", "crossing rings"),
    "parts share a side": ("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((4 0, 7 0, 7 4, 4 4, 4 0)))", "crossing rings"),
    "missing": (None, "missing"),
}


def layer(spark, rows):
    table = spark.createDataFrame(rows, "name string, wkt string")
    return table.select("name", F.expr(tables.geometry_from_wkt("wkt")).alias("geometry"))


@pytest.mark.parametrize("few", [64, 0])
def test_reasons(spark, monkeypatch, few):
    """In the row, and by the grid of segments that large shapes take."""
    monkeypatch.setattr(spatial, "FEW_SEGMENTS", few)
    shapes = layer(spark, [(n, w) for n, (w, _) in SHAPES.items()])
    good, bad = spatial.split_valid(shapes)
    assert good.columns == ["name", "geometry"] and bad.columns == ["name", "geometry", "reason"]
    got = {r.name: None for r in good.collect()} | {r.name: r.reason for r in bad.collect()}
    assert got == {n: reason for n, (_, reason) in SHAPES.items()}


def _ring(points):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*points, points[0]]) + "))"


def test_large_rings(spark):
    """Rings of thousands of vertices, one of them with two neighbouring vertices exchanged."""
    round_ = [(math.cos(2 * math.pi * i / 3000) * (1 + 0.1 * (i % 2)), math.sin(2 * math.pi * i / 3000) * (1 + 0.1 * (i % 2))) for i in range(3000)]
    crossed = list(round_)
    crossed[700], crossed[703] = crossed[703], crossed[700]
    _, bad = spatial.split_valid(layer(spark, [("good", _ring(round_)), ("bad", _ring(crossed)), ("small", _ring([(0, 0), (1, 0), (0, 1)]))]))
    assert [(r.name, r.reason) for r in bad.collect()] == [("bad", "crossing rings")]


def test_grid_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{i}", _ring([(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(4, 9))])) for i in range(60)]
    reasons = []
    for few in (64, 0):
        monkeypatch.setattr(spatial, "FEW_SEGMENTS", few)
        reasons.append({r.name: r.reason for r in spatial.invalid_shapes(layer(spark, rows)).collect()})
    assert reasons[0] == reasons[1] and set(reasons[0].values()) >= {None, "crossing rings"}
