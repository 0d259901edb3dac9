"""Planned projects, which of them are built, and the serving table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.semantics import half_even, if_else, with_cols
from ..operators.relational import bind_rows, natural_join
from ..operators.spatial import spatial_join
from .parcels import FLOOR_AREA_RATIO

COUNTIES = ("Los Angeles", "Orange", "Riverside", "San Bernardino")

# Projects matched by centroid that are less than half built, and one matched
# only by its outline that is built.
LESS_THAN_HALF_BUILT = ("2020059028", "2022020461")
BUILT_OFF_CENTRE = ("2020079023",)

RECEIVED_BY = date(2023, 1, 1)
RECENT_YEAR = 2016
_PROJECT_KEY = ("project", "sch_number", "ceqa_url")


def planned_projects(projects: DataFrame, counties: Sequence[str] = COUNTIES) -> DataFrame:
    """Live projects of the region with their category; a missing stage has no category."""
    return projects.where(F.col("county").isin(*counties) & F.col("status").isNull()).withColumn(
        "category", if_else(F.col("stage_pending_approved") != "Approved", "CEQA Review", "Approved")
    )


def built_pairs(
    parcels: DataFrame, planned: DataFrame, by: str = "centroid", *, cell: float = 0.004
) -> DataFrame:
    """Recently built parcels and the early projects they touch, by centroid or by outline."""
    recent = parcels.where(F.col("year_built") > RECENT_YEAR).select("apn", "geometry")
    early = planned.where(F.col("recvd_date") <= F.lit(RECEIVED_BY)).select(*_PROJECT_KEY, "geometry")
    if by == "centroid":
        early = early.withColumn("geometry", F.expr(geo.centroid("geometry")))
    return spatial_join(
        recent, early, "intersects", "inner", cell=cell, right_points=by == "centroid"
    ).select("project", "apn", "sch_number", "ceqa_url")


def built_projects(
    parcels: DataFrame,
    planned: DataFrame,
    *,
    less_than_half: Sequence[str] = LESS_THAN_HALF_BUILT,
    off_centre: Sequence[str] = BUILT_OFF_CENTRE,
    cell: float = 0.004,
) -> DataFrame:
    """(project, apn, sch_number, ceqa_url) of projects that stand, exceptions by number."""
    number = F.col("sch_number")
    centred = built_pairs(parcels, planned, "centroid", cell=cell).where(
        number.isNull() | ~number.isin(*less_than_half)
    )
    listed = planned.where(number.isin(*off_centre))
    return bind_rows(centred, built_pairs(parcels, listed, "outline", cell=cell))


def polygon_only_pairs(parcels: DataFrame, planned: DataFrame, *, cell: float = 0.004) -> DataFrame:
    """Outline pairs whose project number has no centroid pair: the review list, each pair once."""
    outline = built_pairs(parcels, planned, "outline", cell=cell)
    centred = built_pairs(parcels, planned, "centroid", cell=cell)
    return natural_join(outline, centred, "left_anti", on=["sch_number"]).distinct()


def planned_not_built(parcels: DataFrame, planned: DataFrame, **options) -> DataFrame:
    """Planned projects that match no built one on name, number and link.

    Both pair searches are behind it: write it once where it is read more than once.
    """
    return natural_join(planned, built_projects(parcels, planned, **options), "left_anti", on=_PROJECT_KEY)


def finish_planned(projects: DataFrame, far: float = FLOOR_AREA_RATIO) -> DataFrame:
    """Area to 1,000 sq ft, floor space, expected year, and the county's long name."""
    return with_cols(
        projects,
        [
            ("shape_area", half_even(F.col("parcel_area"), -3)),
            ("class", F.col("stage_pending_approved")),
            ("year_chr", F.lit("future")),
            ("type", F.lit("warehouse")),
            ("county", F.concat("county", F.lit(" County"))),
            ("floor_sq_ft", F.col("shape_area") * far),
            ("year_built", if_else(F.col("document_type_bins") == "Approved", F.lit(2027.0), F.lit(2030.0))),
        ],
    ).drop("parcel_area", "stage_pending_approved").withColumnRenamed("project", "name")


def combine_existing_and_planned(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """(apn, shape_area, category, year_built, class, county, unknown, geometry) of both."""
    built = existing.select(
        "apn",
        F.col("shape_area2").alias("shape_area"),
        F.lit("Existing").alias("category"),
        "year_built",
        "class",
        "county",
        if_else(F.col("year_chr") == "unknown", True, False).alias("unknown"),
        "geometry",
    )
    future = planned.select(
        F.col("name").alias("apn"),
        "shape_area",
        "category",
        "year_built",
        F.col("ceqa_url").alias("class"),
        "county",
        F.lit(True).alias("unknown"),
        "geometry",
    )
    return bind_rows(built, future)


def locate(
    combined: DataFrame,
    counties: DataFrame,
    places: DataFrame,
    *,
    county_cell: float = 0.25,
    place_cell: float = 0.1,
) -> DataFrame:
    """Attributes with the county and place of the centroid; no place is 'unincorporated'.

    Centroids drive both joins with one key each, so overlapping places give several rows, and
    small boundary tables are broadcast without moving a parcel.
    """
    centre = combined.withColumn("_at", F.expr(geo.centroid("geometry"))).drop("geometry", "county")
    in_county = spatial_join(
        centre, counties.select("county", "geometry"), "intersects", "left",
        cell=county_cell, left_points=True, left_geometry="_at", boundary=True,
    )
    in_place = spatial_join(
        in_county, places.select(F.col("name").alias("place_name"), "geometry"), "intersects", "left",
        cell=place_cell, left_points=True, left_geometry="_at", boundary=True,
    )
    return in_place.drop("_at").withColumn(
        "place_name", F.coalesce(F.col("place_name"), F.lit("unincorporated"))
    )


def build_serving(
    existing: DataFrame,
    planned: DataFrame,
    counties: DataFrame,
    jurisdictions: DataFrame,
    **options,
) -> DataFrame:
    """The dashboard's table: every parcel and project with its place.

    The place comes back by a natural join on all attributes, the located county among them, so
    a row whose declared county disagrees has no place. Both sides are made distinct before the
    join: N copies meet one row instead of each other, and the result is distinct without a
    last pass over the geometry.
    """
    combined = combine_existing_and_planned(existing, planned)
    county_names = counties.select(F.col("county").alias("name"))
    places = natural_join(jurisdictions, county_names, "left_anti", on=["name"])
    located = locate(combined, counties, places, **options).distinct()
    return natural_join(combined.distinct(), located, "left")
