"""Boundary tables: jurisdictions, districts, place lists, and the tract score layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.semantics import half_even, paste
from ..functions.units import SQ_FT_PER_M2_BOUNDARY
from ..operators.relational import bind_rows, exact_quantiles
from ..operators.spatial import region_difference, spatial_join, spatial_semi
from .parcels import keep_first_geometry

COUNTIES = ("Los Angeles", "Orange", "Riverside", "San Bernardino")

# Coastal cities whose centroid may fall outside a county polygon; spelled as in
# the layer the list is used with.
COASTAL_CITIES = (
    "Malibu",
    "Santa Monica",
    "Manhattan Beach",
    "Hermosa Beach",
    "Redondo Beach",
    "Palos Verde Estates",
    "Rancho Palos Verde",
    "Newport Beach",
    "El Segundo",
)
COASTAL_COUNTIES = ("Los Angeles", "Orange")
CITY_CODE = "25"
OUTSIDE_COUNTIES = ("Imperial", "Ventura")


def select_counties(layer: DataFrame, names: Sequence[str] = COUNTIES) -> DataFrame:
    """Boundary layer (name, geometry) to (county, geometry) with the long names."""
    return layer.where(F.col("name").isin(*names)).select(
        F.concat("name", F.lit(" County")).alias("county"), "geometry"
    )


def build_jurisdictions(places: DataFrame, counties: DataFrame, *, cell: float = 0.25) -> DataFrame:
    """Places that touch a county, then the counties: (name, geometry)."""
    touching = spatial_semi(places.select("name", "geometry"), counties, cell=cell, boundary=True)
    return bind_rows(touching, counties.select(F.col("county").alias("name"), "geometry"))


def build_districts(
    lower: DataFrame, upper: DataFrame, counties: DataFrame, *, cell: float = 0.25
) -> DataFrame:
    """Districts of both houses that touch a county: (district_label, geometry)."""
    def labelled(layer: DataFrame, prefix: str) -> DataFrame:
        return spatial_semi(layer, counties, cell=cell, boundary=True).select(
            F.concat(F.lit(f"{prefix} "), "name").alias("district_label"), "geometry"
        )

    return bind_rows(labelled(lower, "AD"), labelled(upper, "SD"))


def build_places(
    counties: DataFrame,
    cities: DataFrame,
    unincorporated: DataFrame,
    authority: DataFrame,
    *,
    city_code: str = CITY_CODE,
    outside: Sequence[str] = OUTSIDE_COUNTIES,
    authority_name: str = "March JPA",
    carved: str = "Unincorporated Riverside",
    cell: float = 0.25,
) -> DataFrame:
    """Place rows (name, lsad, carved, geometry) by county and city outline.

    Cities (name, lsad, geometry) that touch a county, one per equal polygon; the authority's
    pieces under one name; unincorporated areas (city, county, geometry) named by county. A
    place of several pieces is several rows with one name. ``carved`` marks rows whose
    membership leaves out the authority and a margin, see :func:`members_of_carved`.
    """
    chosen = spatial_semi(cities, counties, cell=cell, boundary=True).where(F.col("lsad") == city_code)
    chosen = keep_first_geometry(chosen.select("name", "lsad", "geometry"), ["name", "lsad"])
    pieces = authority.select(F.lit(authority_name).alias("name"), F.lit("JPA").alias("lsad"), "geometry")
    rest = unincorporated.where(
        (F.col("city") == "Unincorporated") & (F.col("county").isNull() | ~F.col("county").isin(*outside))
    ).select(F.concat("city", F.lit(" "), "county").alias("name"), F.lit("26").alias("lsad"), "geometry")
    return bind_rows(chosen, pieces, rest).select(
        "name", "lsad", (F.coalesce(F.col("name") == carved, F.lit(False))).alias("carved"), "geometry"
    )


def members_of_carved(
    points: DataFrame, places: DataFrame, *, authority_name: str = "March JPA", margin_m: float = 100.0,
    cell: float = 0.25,
) -> DataFrame:
    """Points of the carved area: inside it and farther than the margin from the authority."""
    return region_difference(
        points,
        places.where(F.col("carved")),
        places.where(F.col("name") == authority_name),
        margin_m,
        "m",
        cell=cell,
    )


def build_places_centroid(
    counties: DataFrame,
    places: DataFrame,
    *,
    coastal: Sequence[str] = COASTAL_CITIES,
    coastal_counties: Sequence[str] = COASTAL_COUNTIES,
    cell: float = 0.25,
    sphere: bool = False,
) -> DataFrame:
    """Rows (county_name, name, namelsad, aland, aland_unit, geometry).

    Places whose centroid lies in a county, the listed coastal cities that touch a coastal
    county, and the counties with their area. Place areas are as the layer gives them (m2) and
    county areas in sq ft; the unit says which. ``sphere`` takes centroids and areas on the
    sphere, with edges as great circles, in place of the plane and the ellipsoid.
    """
    middle, area = (geo.centroid_spherical, geo.area_spherical) if sphere else (geo.centroid, geo.area_geodesic)
    island = counties.where(F.col("island").isNull())
    named = island.select("county_name", "geometry")
    centred = places.withColumn("_at", F.expr(middle("geometry")))
    by_centre = spatial_join(
        centred, named, "within", "inner", cell=cell, left_points=True, left_geometry="_at", boundary=True
    ).drop("_at")
    beach = spatial_join(
        places.where(F.col("name").isin(*coastal)),
        named.where(F.col("county_name").isin(*coastal_counties)),
        "intersects", "inner", cell=cell, boundary=True,
    )
    columns = ["county_name", "name", "namelsad", "aland", "aland_unit", "geometry"]
    rows = bind_rows(by_centre, beach).withColumn("aland_unit", F.lit("m2")).select(*columns)
    long_name = paste(F.col("county_name"), F.lit("County"))
    whole = island.select(
        "county_name",
        long_name.alias("name"),
        long_name.alias("namelsad"),
        (F.expr(area("geometry")) * SQ_FT_PER_M2_BOUNDARY).alias("aland"),
        F.lit("sq_ft").alias("aland_unit"),
        "geometry",
    )
    return rows.unionByName(whole)


def tract_layer(
    tracts: DataFrame, *, counties: Sequence[str] = COUNTIES, classes: int = 5
) -> DataFrame:
    """Tracts of the region with a score of 0 or more, their map label and quantile class.

    Class 1 holds the highest scores (the scale is reversed), edges are exact quantiles.
    """
    scored = tracts.where(F.col("county").isin(*counties) & (F.col("ciscorep") >= 0.0))
    steps = [i / classes for i in range(1, classes)]
    edges = exact_quantiles(scored, [], "ciscorep", steps).scalar()
    # the class is the number of edges at or below the score, counted from the top
    above = F.size(F.filter(F.col("_edges"), lambda e: F.col("ciscorep") >= e))
    label = paste(
        F.lit("Tract"), F.col("tract"), F.lit(";"), F.lit(" Score"),
        half_even(F.col("ciscorep"), 0).cast("int"), F.lit("; population "), F.col("tot_pop19"),
    )
    return (
        scored.withColumn("_edges", edges)
        .withColumn("quantile_class", F.lit(classes) - above)
        .withColumn("label", label)
        .drop("_edges")
    )
