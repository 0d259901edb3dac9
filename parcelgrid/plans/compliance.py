"""Rule phases by size, and facilities near violation notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.semantics import first_match, mean_strict, sum_strict
from ..operators.relational import bind_rows, exact_quantiles, natural_join
from ..operators.spatial import within_distance

_ADDRESS = ("company", "address", "city", "zip")


def isr_summary(serving: DataFrame) -> DataFrame:
    """Existing sites above 100,000 sq ft of estimated floor space, by rule phase.

    Three groups hold all rows, so the exact medians come from ranked bins, never from one
    group's collected values.
    """
    size = F.col("est_sq_ft")
    sites = serving.select("category", (F.col("shape_area") * 0.5).alias("est_sq_ft")).where(
        (size > 100000) & (F.col("category") == "Existing")
    )
    phase = first_match([(size >= 250000, "PhaseI"), (size >= 150000, "PhaseII"), (size >= 100000, "PhaseIII")])
    sites = sites.select(phase.alias("isr_category"), "est_sq_ft")
    totals = sites.groupBy("isr_category").agg(
        F.count(F.lit(1)).alias("count"),
        mean_strict(size).alias("avg_sq_ft"),
        sum_strict(size).alias("total_area_sq_ft"),
    )
    middle = exact_quantiles(sites, ["isr_category"], "est_sq_ft", [0.5])
    return natural_join(totals, middle, "inner", on=["isr_category"]).select(
        "isr_category",
        "count",
        "avg_sq_ft",
        F.col("quantiles").getItem(0).alias("median_sq_ft"),
        "total_area_sq_ft",
    )


def notice_points(notices: DataFrame, geocodes: DataFrame, *, min_accuracy: float = 0.8) -> DataFrame:
    """Located notices: address columns, ``notice_count`` and a point.

    ``notices`` (company, address, city, zip, lat, lng) has positions for the curated rows only.
    A curated position beats the geocoder's (company, address, city, zip, lat, long, accuracy).
    """
    listed = notices.where(F.col("zip") > 0)
    counts = listed.groupBy(*_ADDRESS).agg(F.count(F.lit(1)).alias("notice_count"))
    curated = listed.where(F.col("lat") > 0)
    open_ones = natural_join(counts, curated, "left_anti", on=_ADDRESS)
    found = natural_join(open_ones, geocodes, "inner", on=_ADDRESS).where(F.col("accuracy") > min_accuracy)
    points = bind_rows(
        found.select(*_ADDRESS, F.expr(geo.point("`long`", "lat")).alias("geometry")),
        curated.select(*_ADDRESS, F.expr(geo.point("lng", "lat")).alias("geometry")),
    )
    return natural_join(points, counts, "left", on=_ADDRESS)


def flag_notices(
    serving: DataFrame,
    points: DataFrame,
    *,
    radius: float = 70.0,
    unit: str = "us_ft",
    min_area: float = 80000.0,
) -> DataFrame:
    """Existing sites above ``min_area`` near a notice.

    The default radius is in the projection's feet, as the source computes it; pass ``unit="m"``
    for metres.
    """
    large = serving.where((F.col("category") == "Existing") & (F.col("shape_area") > min_area))
    return within_distance(large, points, radius, unit, "left_semi")
