"""County parcels: which parcels are warehouses, when built, and which are copies.

All id lists (add, deny, partial) are input tables, not code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.semantics import (
    first_match,
    half_even,
    if_else,
    min_strict,
    slice_text,
    to_number,
    with_cols,
)
from ..functions.units import SQ_FT_PER_M2
from ..operators.relational import bind_rows, is_in, keep_first, not_in
from ..operators.spatial import container_join, explode_parts, one_row, spatial_anti, spatial_join, split_valid
from ..sources.tables import materialise

MAYBE_WAREHOUSE_SQ_FT = 150_000   # minimum size of parcels not called a warehouse
WAREHOUSE_FLOOR_SQ_FT = 28_000    # minimum floor space of a parcel that is kept
FLOOR_AREA_RATIO = 0.55
FIRST_KNOWN_YEAR = 1911
UNKNOWN_YEAR = 1910
FIRST_SHOWN_YEAR = 1980
MISSING_YEAR = 1776

# Fixed value: an address whose parcel is not its own.
EXCLUDED_ADDRESSES = ("1051S East St Anaheim, CA 92805",)

# Words that select a use-code description, first match wins.
DESCRIPTION_TYPES = (
    ("warehouse", "warehouse"),
    ("light industrial", "other"),
    ("flex", "other"),
    ("storage", "other"),
    ("associated", "other"),
)

# Use-code descriptions that name a selected word but are not logistics.
DROPPED_DESCRIPTIONS = (
    "retail warehouse",
    "lumber storage",
    "mini storage (public)",
    "storage yard",
    "auto storage yard",
    "boat storage yard",
    "grain storage",
    "potato storage",
    "bulk fertilizer storage",
    "mini-storage warehouse",
)

# Land-use code -> (class, type).
LAND_USE_CODES = (
    ("1231", "commercial storage", "other"),
    ("1323", "open storage", "other"),
    ("1340", "wholesaling and warehousing", "warehouse"),
    ("1310", "light industrial", "other"),
)

# Assessor description and the code prefixes left out.
PREFIX_DESCRIPTION = "Warehousing, Distribution, Storage"
PREFIX_DROPPED = ("334", "335", "33T")


# ------------------------------------------------------------ text classification

def reconcile_years(properties: DataFrame) -> DataFrame:
    """One build year per PIN: (pin, year_built).

    A single distinct value is kept as it is, even if missing or implausible. Of several, the
    least year from 1911 on counts, or none. One pass with map-side partial aggregates.
    """
    year = F.col("year_built")
    rows, known = F.count(F.lit(1)), F.count(year)
    single = (known == 0) | ((known == rows) & (F.min(year) == F.max(year)))
    plausible = F.min(F.when(year >= FIRST_KNOWN_YEAR, year))
    return properties.groupBy("pin").agg(
        F.when(single, F.min(year)).otherwise(plausible).alias("year_built")
    )


def classify_by_text(
    parcels: DataFrame,
    years: DataFrame,
    add_ids: DataFrame,
    deny_ids: DataFrame | None = None,
    *,
    county: str = "Riverside",
    min_area: float = MAYBE_WAREHOUSE_SQ_FT,
) -> DataFrame:
    """Parcels (apn, class_code, shape_area, geometry) whose class text says warehouse, or light
    industry of some size, or that are on the add list; with year, type and one row per part.

    The three branches' union without repeats is one filter over one scan: the add list is
    joined as a flag instead of read again.
    """
    listed = add_ids.select(F.col(add_ids.columns[0]).alias("_listed")).distinct()
    p = parcels.withColumn("class", F.lower(F.col("class_code")))
    flagged = p.join(listed, p["apn"] == listed["_listed"], "left")
    text = F.col("class")
    chosen = flagged.where(
        text.contains("warehouse")
        | (text.contains("light industrial") & (F.col("shape_area") > min_area))
        | F.col("_listed").isNotNull()
    ).drop("_listed")
    years = years.select(F.col("pin").alias("_pin"), F.col("year_built").alias("_year"))
    dated = chosen.join(years, chosen["apn"] == years["_pin"], "left").distinct()
    out = dated.select(
        "apn",
        "shape_area",
        "class",
        if_else(text.contains("warehouse"), "warehouse", "other").alias("type"),
        F.coalesce(F.col("_year"), F.lit(MISSING_YEAR)).alias("year_built"),
        F.lit(county).alias("county"),
        "geometry",
    )
    out = explode_parts(out)
    return out if deny_ids is None else not_in(out, "apn", deny_ids)


# ------------------------------------------------------------ code classification

def code_table(codes: DataFrame, dropped: Sequence[str] = DROPPED_DESCRIPTIONS) -> DataFrame:
    """Use codes (use_code, description) to (use_code, class, type), unselected ones left out."""
    text = F.lower(F.col("description"))
    kind = first_match([(text.contains(word), kind) for word, kind in DESCRIPTION_TYPES])
    return codes.select(
        to_number(F.col("use_code")).alias("use_code"), text.alias("class"), kind.alias("type")
    ).where(F.col("type").isNotNull() & ~F.col("class").isin(*dropped))


def land_use_table(spark) -> DataFrame:
    """The land-use codes as a table like :func:`code_table`."""
    return spark.createDataFrame(list(LAND_USE_CODES), "use_code string, class string, type string")


def _excluded(area: Column, kind: Column, min_area: float) -> Column:
    """1 if a parcel that is not a warehouse is too small; missing if its type is."""
    large = if_else(area > min_area, 1, 0)
    return if_else(kind == "warehouse", 0, if_else(large == 1, 0, 1))


def classify_by_code(
    parcels: DataFrame,
    codes: DataFrame,
    *,
    code: str = "use_code",
    min_area: float = MAYBE_WAREHOUSE_SQ_FT,
) -> DataFrame:
    """Parcels joined to their code's class and type; small ones count only as warehouses.

    The code table is left to the optimizer to broadcast by its size; a code held by a third of
    all parcels is otherwise a skewed key of the large side, which adaptive execution splits.
    """
    codes = codes.withColumnRenamed("use_code", "_code")
    joined = parcels.join(codes, parcels[code] == codes["_code"], "inner").drop("_code")
    return joined.where(_excluded(F.col("shape_area"), F.col("type"), min_area) == 0)


def partial_parcels(parcels: DataFrame, codes: DataFrame, ids: DataFrame, *, code: str = "use_code") -> DataFrame:
    """Listed parcels regardless of code and size; class and type may be missing."""
    codes = codes.withColumnRenamed("use_code", "_code")
    listed = is_in(parcels, "apn", ids)
    return listed.join(codes, listed[code] == codes["_code"], "left").drop("_code")


def add_partials(classified: DataFrame, partials: DataFrame) -> DataFrame:
    """Both branches; a parcel chosen twice stays twice until the final distinct."""
    return bind_rows(classified, partials)


def year_fallback(df: DataFrame) -> DataFrame:
    """year_built from the construction, base or effective year, the first after 1900; else 1980."""
    construction, effective = to_number(F.col("const_year")), to_number(F.col("eff_year"))
    base = F.col("base_year").cast("double")
    year = first_match(
        [(construction > 1900, construction), (base > 1900, base), (effective > 1900, effective)],
        default=F.lit(float(FIRST_SHOWN_YEAR)),
    )
    return df.withColumn("year_built", year)


def formatted_apn(apn: Column) -> Column:
    """'nnnnnnnnn' to 'nnnn-nnn-nn-0000'."""
    return F.concat(
        slice_text(apn, 1, 4), F.lit("-"), slice_text(apn, 5, 7), F.lit("-"), slice_text(apn, 8, 9), F.lit("-0000")
    )


def override_years(base: DataFrame, external: DataFrame) -> DataFrame:
    """External years after 1850 replace the base year; several distinct ones fan out.

    Adds ``diff_yr``, the external minus the base year, missing without an external one.
    """
    known = external.where(F.col("year_built") > 1850).distinct().select(
        F.col("apn_formatted").alias("_apn"), F.col("year_built").alias("_year")
    )
    keyed = base.withColumn("_key", formatted_apn(F.col("apn")))
    joined = keyed.join(known, keyed["_key"] == known["_apn"], "left")
    return joined.select(
        *[c for c in base.columns if c != "year_built"],
        F.coalesce(F.col("_year").cast("double"), F.col("year_built").cast("double")).alias("year_built"),
        (F.col("_year") - F.col("year_built")).cast("double").alias("diff_yr"),
    )


def without_year(external: DataFrame) -> DataFrame:
    """External rows to look up by hand: the year is missing or 0."""
    return external.where(F.col("year_built").isNull() | (F.col("year_built") == 0))


def append_site(parcels: DataFrame, site: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """One hand-drawn site (name, geometry) with constant attributes under the parcels."""
    row = site.select(
        F.col("name").alias("apn"), "geometry", *[F.lit(v).alias(k) for k, v in constants.items()]
    )
    return bind_rows(parcels, row)


# ---------------------------------------------------------- prefix classification

def classify_by_prefix(
    parcels: DataFrame,
    *,
    description: str = PREFIX_DESCRIPTION,
    dropped: Sequence[str] = PREFIX_DROPPED,
) -> DataFrame:
    """Parcels (ain, use_code, use_description, year_built1, shape_area, geometry) of one
    description without the dropped code prefixes; unknown years become 1910."""
    prefix = slice_text(F.col("use_code"), 1, 3)
    year = F.col("year_built1").cast("double")
    return parcels.where(
        (F.col("use_description") == description) & (prefix.isNull() | ~prefix.isin(*dropped))
    ).select(
        F.col("ain").alias("apn"),
        if_else(year.isNull(), F.lit(float(UNKNOWN_YEAR)), if_else(year < FIRST_KNOWN_YEAR, F.lit(float(UNKNOWN_YEAR)), year)).alias("year_built"),
        "use_code",
        F.col("use_description").alias("class"),
        "shape_area",
        F.lit("warehouse").alias("type"),
        "geometry",
    )


def dedupe_by_geometry(parcels: DataFrame) -> DataFrame:
    """One row per polygon, area, class and type: least apn, least year.

    The canonical geometry is the grouping key and the output at once. A polygon with one
    record is its own group, so no second pass is needed; partial aggregation collapses a
    polygon shared by any number of parcels before the shuffle. The least apn stands for
    "the first one", which would depend on input order.
    """
    shape = parcels.withColumn("geometry", F.expr(geo.canonical("geometry")))
    # a leading hash lets the sort inside the aggregate compare numbers before vertex arrays
    keyed = shape.withColumn("_hash", F.xxhash64("geometry", "shape_area", "class", "type"))
    return keyed.groupBy("_hash", "geometry", "shape_area", "class", "type").agg(
        F.min("apn").alias("apn"), min_strict(F.col("year_built")).alias("year_built")
    ).select("apn", "shape_area", "class", "type", "year_built", "geometry")


def keep_first_geometry(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The least row (by ``order``) of every set of equal polygons."""
    shape = df.withColumn("_shape", F.expr(geo.canonical("geometry"))["rings"])
    shape = shape.withColumn("_hash", F.xxhash64("_shape"))
    return keep_first(shape, [F.col("_hash"), F.col("_shape")], order).drop("_hash", "_shape")


def orphan_geometries(shapes: DataFrame, parcels: DataFrame, *, cell: float = 0.004) -> DataFrame:
    """Polygons (shape_id, geometry) that equal no parcel's polygon, with the parcels inside them."""
    rings = F.expr(geo.canonical("geometry"))["rings"]
    # each ring is spelled once per row: filters and keys of the join would spell it again for every use
    have = one_row(one_row(parcels.select("geometry"), [rings.alias("_have")]), [F.xxhash64("_have").alias("_have_hash")])
    have = have.drop("geometry")
    keyed = one_row(one_row(shapes, [rings.alias("_shape")]), [F.xxhash64("_shape").alias("_hash")])
    same = (keyed["_hash"] == have["_have_hash"]) & (keyed["_shape"] == have["_have"])
    orphans = materialise(keyed.join(have, same, "left_anti").drop("_shape", "_hash"))
    return container_join(orphans, parcels, "contains", key="shape_id", cell=cell)


# ------------------------------------------------------------- two-source counties

def attach_points(
    parcels_plane: DataFrame,
    points: DataFrame,
    to_lonlat,
    *,
    excluded: Sequence[str] = EXCLUDED_ADDRESSES,
    min_area: float = 100_000,
    cell: float = 0.02,
) -> DataFrame:
    """Geocoded rooftop addresses with the large parcel around them (size, geometry).

    ``parcels_plane`` is stored in zone 6 feet: the area is planar, then ``to_lonlat`` maps the
    kept polygons. Addresses in no large parcel come back with missing size and geometry; those
    in ``excluded`` do not come back.
    """
    large = parcels_plane.withColumn("size", F.expr(geo.area_planar("geometry"))).where(
        F.col("size") > min_area
    ).withColumn("geometry", F.expr(geo.map_coordinates("geometry", to_lonlat)))
    rooftop = points.where(
        (F.col("accuracy_type") == "rooftop") & ~F.col("address").isin(*excluded)
    ).withColumn(
        "_at", F.expr(geo.point("`long`", "lat"))
    ).drop("lat", "long", "accuracy_type")
    return spatial_join(
        rooftop, large, "intersects", "left", cell=cell, left_points=True,
        left_geometry="_at", keep_right_geometry=True,
    ).drop("_at")


def merge_sources(
    first: DataFrame,
    second: DataFrame,
    *,
    county: str = "Orange",
    min_area: float = MAYBE_WAREHOUSE_SQ_FT,
    cell: float = 0.004,
) -> DataFrame:
    """All of ``first`` plus what of ``second`` touches none of it, with constant attributes.

    Both hold (apn, shape_area, geometry). Of ``first`` only the rows that touch ``second``
    are made distinct. Pairs that touch may be far more than rows, so only the numbers of the rows
    they name are kept. Both sides are type 'warehouse', so the size rule drops no row.
    """
    numbered = materialise(first.withColumn("_row", F.monotonically_increasing_id()))
    pairs = spatial_join(second.select("geometry"), numbered.select("_row", "geometry"), "intersects", "inner", cell=cell)
    found = materialise(pairs.select("_row").distinct())
    touching = numbered.join(found, "_row", "left_semi").drop("_row").distinct()
    alone = numbered.join(found, "_row", "left_anti").drop("_row")
    rest = spatial_anti(second, numbered, cell=cell)
    merged = bind_rows(touching, alone, rest).select("apn", "shape_area", "geometry")
    merged = with_cols(
        merged,
        [
            ("county", F.lit(county)),
            ("class", F.lit("warehouse")),
            ("type", F.lit("warehouse")),
            ("year_built", F.lit(float(UNKNOWN_YEAR))),
        ],
    )
    return merged.where(_excluded(F.col("shape_area"), F.col("type"), min_area) == 0)


# ------------------------------------------------------------------- all counties

def refuse_invalid(tables: Sequence[DataFrame], columns: Sequence[str] = ("apn",)) -> tuple[list[DataFrame], DataFrame]:
    """Ahead of :func:`combine_parcels`: the tables without shapes that are not valid, and those rows.

    The refused come back with their ``columns``, the reason, and the number of their table.
    """
    split = [split_valid(t) for t in tables]
    refused = [bad.select(*columns, "reason", F.lit(i).alias("table_no")) for i, (_, bad) in enumerate(split)]
    return [good for good, _ in split], bind_rows(*refused)


def combine_parcels(
    tables: Sequence[DataFrame],
    deny_ids: DataFrame,
    *,
    far: float = FLOOR_AREA_RATIO,
    min_floor: float = WAREHOUSE_FLOOR_SQ_FT,
) -> tuple[DataFrame, DataFrame]:
    """The counties' parcels as (kept, small) by floor space.

    ``year_chr`` is taken from the raw year before it is clamped to 1980; the size rule uses
    the assessor's area while ``shape_area2`` is measured on the ellipsoid, to 100 sq ft.
    """
    year, floor = F.col("year_built"), F.col("floor_sq_ft")
    joined = with_cols(
        bind_rows(*tables).withColumn("year_built", F.col("year_built").cast("double")),
        [
            ("year_chr", if_else(year <= UNKNOWN_YEAR, F.lit("unknown"), year.cast("int").cast("string"))),
            ("year_built", if_else(year <= FIRST_SHOWN_YEAR, F.lit(float(FIRST_SHOWN_YEAR)), year)),
            ("floor_sq_ft", half_even(F.col("shape_area") * far, 0)),
            ("exclude", if_else(floor > min_floor, 0, 1)),
        ],
    )
    allowed = not_in(joined, "apn", deny_ids).withColumn(
        "shape_area2", half_even(F.expr(geo.area_geodesic("geometry")) * SQ_FT_PER_M2, -2)
    ).drop("shape_area")
    kept = allowed.where(F.col("exclude") == 0).withColumn("county", F.concat("county", F.lit(" County")))
    small = allowed.where(F.col("exclude") == 1)
    return kept, small
