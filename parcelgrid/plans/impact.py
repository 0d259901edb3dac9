"""Dashboard questions: selections, parcel lists, cumulative impact, trends, exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import first_match, half_even, sum_strict
from ..functions.units import METRIC_TON_PER_LB, SQ_FT_PER_ACRE
from ..operators.spatial import in_circle, spatial_semi
from ..sources.geojson import write_geojson

# Allowed range of each numeric parameter.
_RANGES = {
    "radius_km": (1, 20),
    "far": (0.05, 1.0),
    "trips_per_1000_sq_ft": (0.1, 1.5),
    "miles_per_trip": (5, 60),
    "dpm_lb_per_mile": (0.00001, 0.0001),
    "nox_lb_per_mile": (0.0004, 0.04),
    "co2_lb_per_mile": (1, 5),
    "jobs_per_acre": (4, 20),
    "vacancy_percent": (0, 15),
}


@dataclass(frozen=True)
class Params:
    """One question. Defaults are the published ones (2022 fleet rates)."""

    places: Sequence[str] = ()
    districts: Sequence[str] = ()
    year: int = 2030
    include_unknown: bool = True
    circle: tuple[float, float] | None = None
    circle_mode: str = "mercator"
    radius_km: float = 5.0
    far: float = 0.55
    trips_per_1000_sq_ft: float = 0.67
    miles_per_trip: float = 38.0
    dpm_lb_per_mile: float = 0.0000364
    nox_lb_per_mile: float = 0.00410
    co2_lb_per_mile: float = 2.44
    jobs_per_acre: float = 8.0
    vacancy_percent: float = 5.7

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")


def filter_parcels(
    serving: DataFrame, params: Params, districts: DataFrame | None = None, *, cell: float = 0.25
) -> DataFrame:
    """Sites built by a year, in the chosen places or counties, or touching the chosen districts.

    Year, unknown-year and place conditions are on stored columns and reach the scan.
    """
    rows = serving.where(F.col("year_built") <= params.year)
    if not params.include_unknown:
        rows = rows.where(~F.col("unknown"))
    if params.places:
        rows = rows.where(F.col("place_name").isin(*params.places) | F.col("county").isin(*params.places))
    if params.districts:
        if districts is None:
            raise ValueError("choosing districts needs the district table")
        chosen = districts.where(F.col("district_label").isin(*params.districts))
        rows = spatial_semi(rows, chosen, cell=cell, boundary=True)
    if params.circle is not None:
        rows = in_circle(rows, *params.circle, params.radius_km, params.circle_mode)
    return rows.withColumn("shape_area", half_even(F.col("shape_area"), 0))


def parcel_list(rows: DataFrame, far: float = 0.55) -> DataFrame:
    """The table view: acreage and floor space, rounded, unsorted."""
    return rows.select(
        "category",
        F.col("apn").alias("parcel_number"),
        "class",
        "year_built",
        half_even(F.col("shape_area") / SQ_FT_PER_ACRE, 0).alias("acreage"),
        half_even(F.col("shape_area") * far, -3).alias("sq_ft"),
    )


def largest_first(parcels: DataFrame) -> DataFrame:
    """Sorted by floor space, missing last; the parcel number breaks ties."""
    return parcels.orderBy(F.col("sq_ft").desc_nulls_last(), "parcel_number", "category", "class", "year_built")


def first_page(parcels: DataFrame, rows: int = 10) -> DataFrame:
    """The first page of the sorted list; each task keeps only that many rows."""
    return largest_first(parcels).limit(rows)


def choice_list(table: DataFrame, column: str) -> DataFrame:
    """Sorted distinct choices, missing ones dropped."""
    return table.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def place_choices(table: DataFrame, column: str = "place_name", last: str = "unincorporated") -> DataFrame:
    """Sorted distinct places, with the areas outside all of them at the end."""
    rows = table.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.orderBy(F.col(column) == last, column)


def impact_summary(parcels: DataFrame, params: Params = Params()) -> DataFrame:
    """Cumulative impact per category of a :func:`parcel_list`, a handful of rows.

    Parcels without a category are left out. One aggregation; the vacant share is split off the existing row afterwards. Every rounded
    number feeds the next one, so the order of rounding is part of the result.
    """
    acreage = F.col("acreage")
    totals = parcels.groupBy("category").agg(
        F.count(F.lit(1)).cast("double").alias("warehouses"),
        half_even(sum_strict(acreage), 0).alias("acreage"),
        half_even(sum_strict(acreage * params.far * SQ_FT_PER_ACRE), -5).alias("floor_sq_ft"),
    )
    measures = ("warehouses", "acreage", "floor_sq_ft")

    def split(category: str, share: float) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            *[half_even(F.lit(share) * F.col(m) / 100.0, 0).alias(m) for m in measures],
        )

    existing = F.array(
        split("Existing", 100.0 - params.vacancy_percent), split("Vacant", params.vacancy_percent)
    )
    rows = totals.where(F.col("category").isNotNull()).select(
        F.explode(
            F.when(F.col("category") == "Existing", existing).otherwise(
                F.array(F.struct("category", *measures))
            )
        ).alias("_r")
    ).select("_r.*")

    used = F.col("category") != "Vacant"
    trips = half_even(
        F.lit(params.trips_per_1000_sq_ft) * F.lit(0.001) * F.col("floor_sq_ft"), -3
    )
    miles = F.lit(params.miles_per_trip) * F.col("truck_trips")
    rows = (
        rows.withColumn("truck_trips", F.when(used, trips))
        .withColumn("dpm_lb", half_even(miles * params.dpm_lb_per_mile, 1))
        .withColumn("nox_lb", half_even(miles * params.nox_lb_per_mile, 0))
        .withColumn("co2_t", half_even(miles * params.co2_lb_per_mile * METRIC_TON_PER_LB, 1))
        .withColumn("jobs", F.when(used, half_even(F.lit(params.jobs_per_acre) * F.col("acreage"), 0)))
    )
    rank = first_match([(F.col("category") == "Existing", 1), (F.col("category") == "Vacant", 2)], default=0)
    return rows.orderBy(rank, "category")


def answer(serving: DataFrame, params: Params, districts: DataFrame | None = None) -> DataFrame:
    """A question end to end: filter, list, summarise."""
    return impact_summary(parcel_list(filter_parcels(serving, params, districts), params.far), params)


def decade(year: Column) -> Column:
    return first_match(
        [
            (year == 1980, "1980"),
            (year.between(1981, 1990), "1990"),
            (year.between(1991, 2000), "2000"),
            (year.between(2001, 2010), "2010"),
            (year.between(2011, 2020), "2020"),
            (year >= 2021, "2030 - Planned"),
        ]
    )


def trends(serving: DataFrame, by: str = "county", places: Sequence[str] = ()) -> DataFrame:
    """Footprint and count per decade, by county or for chosen places."""
    rows = serving
    if by == "place_name":
        rows = rows.where(F.col("place_name").isin(*places))
    return rows.groupBy(decade(F.col("year_built")).alias("decade"), by).agg(
        sum_strict(F.col("shape_area")).alias("sum_footprint"), F.count(F.lit(1)).alias("count")
    )


def other_parcels(parcels: DataFrame) -> DataFrame:
    """The layer of parcels that are not warehouses by type."""
    return parcels.where(F.col("type") == "other")


def export_selection(rows: DataFrame, path: str) -> None:
    """The current selection as GeoJSON feature lines."""
    write_geojson(rows, path)
