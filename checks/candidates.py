"""Candidate and exact pairs of the main grid joins: python -m checks.candidates SF_DIR"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.operators import spatial as sp

from . import standins as fx
from .compare import session


def pairs(driver: DataFrame, index: DataFrame, cell: float, points: bool = False) -> tuple[int, int, int, int]:
    """Driving rows, pairs that share a cell, pairs whose boxes meet, pairs that intersect."""
    left = sp._keyed_driver(driver.select("geometry"), "geometry", cell, points)
    levels = left.select(F.collect_set("_d_k").alias("_i_levels"))
    right = sp._boxed(index.select("geometry").withColumn("_i_pad", F.lit(0.0)), "geometry", "_i_").crossJoin(F.broadcast(levels))
    right = right.withColumn("_i_k", F.explode("_i_levels")).withColumn(
        "_i_cell", F.explode(F.expr(sp._cells_sql(cell, 0 if points else 1)))
    )
    same = left.join(right.drop("geometry"), F.expr("_d_k = _i_cell.k AND _d_cx = _i_cell.cx AND _d_cy = _i_cell.cy"))
    meet = "_d_xmin <= _i_xmax AND _d_xmax >= _i_xmin AND _d_ymin <= _i_ymax AND _d_ymax >= _i_ymin"
    found = same.agg(F.count(F.lit(1)), F.sum(F.expr(f"int({meet})"))).first()
    exact = sp.spatial_join(driver, index.select("geometry"), "intersects", "inner", cell=cell, left_points=points).count()
    return driver.count(), found[0], found[1] or 0, exact


def main(d: str) -> None:
    spark = session("3")
    parcels, projects = fx.parcels(spark, d), fx.projects(spark, d)
    centres = parcels.withColumn("geometry", F.expr(geo.centroid("geometry")))
    for name, *args in (
        ("parcels x projects (built_projects), cell 0.004", parcels, projects, 0.004),
        ("the same, cell 0.01", parcels, projects, 0.01),
        ("projects x parcels (merge_sources), cell 0.004", projects, parcels, 0.004),
        ("parcels x places (spatial_poly_poly), cell 0.1", parcels, fx.places(spark, d), 0.1),
        ("centroids x places (serving), cell 0.1", centres, fx.places(spark, d), 0.1, True),
    ):
        print("| " + " | ".join(map(str, (name, *pairs(*args)))) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
