"""Stand-in inputs derived from the driver's tables by plain arithmetic.

Every table keeps all rows of the table it comes from. Polygons are given as general vertex
rings, half of them in another spelling, so the general code runs; the check SQL works on the
bounds alone.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """A small input in one file split over the cores; a large one already has its splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _rect(other_spelling: str = "false") -> Column:
    """Rectangle from the bounds; the other spelling runs clockwise from the upper right, with one
    collinear vertex."""
    def ring(*corners: tuple[str, str]) -> str:
        return f"array({', '.join(geo.vertex(x, y) for x, y in corners)})"

    usual = ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))
    turned = ring(
        ("xmax", "ymax"), ("xmax", "ymin"), ("(xmin + xmax) / 2", "ymin"),
        ("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"),
    )
    return F.expr(geo.ring_polygon(f"CASE WHEN {other_spelling} THEN {turned} ELSE {usual} END"))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = _spread(table(spark, d, "orders"), "o_orderkey"), table(spark, d, "customer")
    keyed = orders.selectExpr(
        "*", "CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS gk"
    )
    placed = keyed.join(customer, keyed.o_custkey == customer.c_custkey).selectExpr(
        "*",
        "(gk * 7919) % 100000 AS kx",
        "-119e0 + ((gk * 7919) % 100000) / 1e5 * 4e0 AS lon",
        "33.4e0 + ((gk * 104729) % 100000) / 1e5 * 1.6e0 AS lat",
        "100 + gk % 900 AS side",
    )
    rows = placed.selectExpr(
        "o_orderkey AS id",
        "lpad(CAST(o_orderkey AS STRING), 9, '0') AS apn",
        "CAST(side * side AS DOUBLE) AS shape_area",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'warehouse' WHEN '2-HIGH' THEN 'light industrial'"
        " WHEN '3-MEDIUM' THEN 'flex' WHEN '4-NOT SPECIFIED' THEN 'mini-storage warehouse' END AS class",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 1776"
        " ELSE CAST(1900 + (o_orderkey * 31) % 128 AS INT) END AS year_built",
        "CASE (CASE WHEN o_orderkey % 40 = 0 THEN c_nationkey % 4 ELSE CAST(floor(kx / 25000e0) AS INT) END)"
        " WHEN 0 THEN 'Los Angeles' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Riverside' ELSE 'San Bernardino' END AS county",
        "lon - side / 604000e0 AS xmin",
        "lat - side / 728000e0 AS ymin",
        "lon + side / 604000e0 AS xmax",
        "lat + side / 728000e0 AS ymax",
    )
    return rows.withColumn("geometry", _rect("id % 2 = 1"))


def typed_parcels(spark: SparkSession, d: str) -> DataFrame:
    """Parcels with the type a county job would give them."""
    kind = F.when(F.col("class").contains("warehouse"), "warehouse").when(F.col("class").isNotNull(), "other")
    return parcels(spark, d).withColumn("type", kind)


def serving(spark: SparkSession, d: str) -> DataFrame:
    """A serving table whose categories and places come from attributes."""
    return parcels(spark, d).selectExpr(
        "apn",
        "shape_area",
        "CASE WHEN class IN ('warehouse', 'light industrial') THEN 'Existing'"
        " WHEN class IS NULL THEN 'Approved' ELSE 'CEQA Review' END AS category",
        "CAST(CASE WHEN year_built <= 1980 THEN 1980 ELSE year_built END AS DOUBLE) AS year_built",
        "class",
        "concat(county, ' County') AS county",
        "coalesce(year_built <= 1910, true) AS unknown",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('PLACE_', CAST(id % 7 AS STRING)) END AS place_name",
        "geometry",
    )


_COUNTIES = ("Los Angeles", "Orange", "Riverside", "San Bernardino")


def counties(spark: SparkSession) -> DataFrame:
    """Four strips, one degree wide."""
    rows = [(n, -118.9999929 + i, 33.3000017, -117.9999929 + i, 35.1000017) for i, n in enumerate(_COUNTIES)]
    strips = spark.createDataFrame(rows, "name string, xmin double, ymin double, xmax double, ymax double")
    return strips.select("name", _rect().alias("geometry"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles and L-shapes with gaps; one overlaps its neighbour."""
    rows = table(spark, d, "nation").selectExpr(
        "n_name AS name",
        "n_nationkey % 2 = 0 AS l_shape",
        "-118.9999929e0 + (n_nationkey % 5) * 0.8e0 AS xmin",
        "33.4000031e0 + floor(n_nationkey / 5e0) * 0.32e0 AS ymin",
        "-118.9999929e0 + (n_nationkey % 5) * 0.8e0 + CASE WHEN n_nationkey = 7 THEN 0.85e0 ELSE 0.7e0 END AS xmax",
        "33.4000031e0 + floor(n_nationkey / 5e0) * 0.32e0 + 0.28e0 AS ymax",
    )
    xm, ym = "(xmin + xmax) / 2", "(ymin + ymax) / 2"
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", ym), (xm, ym), (xm, "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ell = F.expr(geo.ring_polygon(f"array({', '.join(geo.vertex(x, y) for x, y in corners)})"))
    return rows.select("name", F.when(F.col("l_shape"), ell).otherwise(_rect()).alias("geometry"))


def towns(spark: SparkSession, d: str) -> DataFrame:
    """Small place polygons from all customers, some outside the counties; every tenth shares its
    predecessor's polygon."""
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS gk",
        "c_name AS name",
        "CASE c_custkey % 3 WHEN 0 THEN '25' WHEN 1 THEN 'JPA' ELSE '57' END AS lsad",
    ).selectExpr(
        "id", "name", "CASE WHEN id % 10 = 1 THEN '25' ELSE lsad END AS lsad",
        "-120.2000011e0 + ((gk * 6007) % 10000) / 1e4 * 6e0 AS xmin",
        "32.9000013e0 + ((gk * 3001) % 10000) / 1e4 * 2.4e0 AS ymin",
        "-120.2000011e0 + ((gk * 6007) % 10000) / 1e4 * 6e0 + 0.03e0 + (gk % 7) * 0.01e0 AS xmax",
        "32.9000013e0 + ((gk * 3001) % 10000) / 1e4 * 2.4e0 + 0.02e0 + (gk % 5) * 0.01e0 AS ymax",
    )
    return rows.withColumn("geometry", _rect("id % 2 = 1"))


def district_layer(spark: SparkSession, d: str, house: str) -> DataFrame:
    """Overlapping rectangles from all suppliers; the upper house's are larger."""
    width, height = ("0.6e0", "0.4e0") if house == "lower" else ("1e0", "0.7e0")
    x = "-120.7000019e0 + (s_suppkey * 37 % 100) / 1e2 * 6.5e0"
    y = "32.7000023e0 + (s_suppkey * 61 % 100) / 1e2 * 2.6e0"
    rows = table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS name",
        f"{x} AS xmin", f"{y} AS ymin", f"{x} + {width} AS xmax", f"{y} + {height} AS ymax",
    )
    return rows.select("name", _rect().alias("geometry"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    rows = _spread(table(spark, d, "part"), "p_partkey").selectExpr(
        "*",
        "p_partkey * 5 AS gk",
        "-119e0 + ((p_partkey * 5 * 7919) % 100000) / 1e5 * 4e0 AS lon",
        "33.4e0 + ((p_partkey * 5 * 104729) % 100000) / 1e5 * 1.6e0 AS lat",
    ).selectExpr(
        "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS project",
        "CAST(2020000000 + p_partkey AS STRING) AS sch_number",
        "concat('https://example.org/', CAST(2020000000 + p_partkey AS STRING)) AS ceqa_url",
        "CASE p_type WHEN 'PROMO' THEN 'Approved' WHEN 'STANDARD' THEN NULL ELSE 'EIR' END AS stage_pending_approved",
        "CASE WHEN p_size = 50 THEN NULL WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'Approved' ELSE 'EIR' END"
        " AS document_type_bins",
        "CASE WHEN p_size % 10 = 0 THEN 'withdrawn' END AS status",
        "date_add(DATE '2021-01-01', CAST(p_partkey % 1000 AS INT)) AS recvd_date",
        "CAST((100 + gk % 900) * (100 + gk % 900) AS DOUBLE) AS parcel_area",
        "CASE WHEN p_partkey % 29 = 0 THEN 'Kern' ELSE CASE CAST(floor((lon + 119e0)) AS INT) WHEN 0 THEN 'Los Angeles'"
        " WHEN 1 THEN 'Orange' WHEN 2 THEN 'Riverside' ELSE 'San Bernardino' END END AS county",
        "lon + (p_partkey % 3) * 4e-4 - 1e-3 AS xmin",
        "lat - 1e-3 AS ymin",
        "lon + (p_partkey % 3) * 4e-4 + 1e-3 AS xmax",
        "lat + 1e-3 AS ymax",
    )
    return rows.withColumn("geometry", _rect())


#: Beside the right edge of a parcel, from 12 feet inside to 400 feet outside; every fifth also
#: above the upper edge, so that the corner is nearest.
_NOTICE_LNG = (
    "-119e0 + ((c_custkey * 10 * 7919) % 100000) / 1e5 * 4e0"
    " + (100 + c_custkey * 10 % 900) / 604000e0 + ((c_custkey % 18) * 25 - 12) / 302000e0"
)
_NOTICE_LAT = (
    "33.4e0 + ((c_custkey * 10 * 104729) % 100000) / 1e5 * 1.6e0"
    " + CASE WHEN c_custkey % 5 = 0 THEN (100 + c_custkey * 10 % 900) / 728000e0 + ((c_custkey % 10) * 30 + 7) / 364000e0 ELSE 0e0 END"
)


def geocoded(spark: SparkSession, d: str) -> DataFrame:
    """Every notice address with the geocoder's answer."""
    return table(spark, d, "customer").selectExpr(
        "c_name AS company",
        "concat(CAST(c_custkey AS STRING), ' Main St') AS address",
        "c_mktsegment AS city",
        "90000 + c_custkey % 700 AS zip",
        f"{_NOTICE_LAT} AS lat",
        f"{_NOTICE_LNG} AS long",
        "(c_custkey % 100) / 1e2 AS accuracy",
        "CASE WHEN c_custkey % 3 = 0 THEN 'rooftop' ELSE 'range' END AS accuracy_type",
    )


def notices(spark: SparkSession, d: str) -> DataFrame:
    """The curated sheet: positions on every seventh row, some rows twice, some without a ZIP."""
    rows = table(spark, d, "customer").selectExpr(
        "c_name AS company",
        "concat(CAST(c_custkey AS STRING), ' Main St') AS address",
        "c_mktsegment AS city",
        "CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE 90000 + c_custkey % 700 END AS zip",
        f"CASE WHEN c_custkey % 7 = 0 THEN {_NOTICE_LAT} END AS lat",
        f"CASE WHEN c_custkey % 7 = 0 THEN {_NOTICE_LNG} END AS lng",
        "explode(CASE WHEN c_custkey % 5 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    )
    return rows.drop("copy")


def properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "lpad(CAST(l_orderkey AS STRING), 9, '0') AS pin",
        "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 11 = 0 THEN 0"
        " ELSE CAST(1880 + l_partkey % 150 AS INT) END AS year_built",
    )


def year_texts(spark: SparkSession, d: str) -> DataFrame:
    """Parcels with three year columns, two of them text with junk."""
    return parcels(spark, d).selectExpr(
        "apn",
        "CASE WHEN id % 4 = 0 THEN 'n/a' WHEN id % 4 = 1 THEN '0' ELSE CAST(year_built AS STRING) END AS const_year",
        "CASE WHEN id % 3 = 0 THEN year_built + 5 WHEN id % 3 = 1 THEN 0 END AS base_year",
        "CASE WHEN id % 5 = 0 THEN '' ELSE concat(' ', CAST(year_built + 9 AS STRING)) END AS eff_year",
    )


def external_years(spark: SparkSession, d: str) -> DataFrame:
    """External build years by formatted APN; repeats, zeros and missing values included."""
    return table(spark, d, "lineitem").selectExpr(
        "concat(substring(lpad(CAST(l_orderkey AS STRING), 9, '0'), 1, 4), '-',"
        " substring(lpad(CAST(l_orderkey AS STRING), 9, '0'), 5, 3), '-',"
        " substring(lpad(CAST(l_orderkey AS STRING), 9, '0'), 8, 2), '-0000') AS apn_formatted",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 0"
        " ELSE CAST(1840 + l_suppkey % 180 AS INT) END AS year_built",
    )


def ids(spark: SparkSession, d: str, factor: int) -> DataFrame:
    """An id list that grows with the data."""
    return table(spark, d, "supplier").selectExpr(f"lpad(CAST(s_suppkey * {factor} AS STRING), 9, '0') AS apn")


def use_codes(spark: SparkSession, d: str) -> DataFrame:
    """Use codes 0..49 from the parts' sizes, descriptions in mixed case."""
    return table(spark, d, "part").selectExpr(
        "CAST(p_size AS STRING) AS use_code",
        "CASE p_size % 9 WHEN 0 THEN 'Warehouse' WHEN 1 THEN 'Retail Warehouse' WHEN 2 THEN 'Light Industrial'"
        " WHEN 3 THEN 'Flex Space' WHEN 4 THEN 'Cold Storage' WHEN 5 THEN 'Grain Storage'"
        " WHEN 6 THEN 'Associated Yard' WHEN 7 THEN 'Office' ELSE 'Storage, Warehouse' END AS description",
    ).distinct()


def coded_parcels(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).selectExpr("apn", "CAST(id % 60 AS DOUBLE) AS use_code", "shape_area", "geometry")


def land_use_parcels(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).selectExpr(
        "apn",
        "CASE id % 6 WHEN 0 THEN '1231' WHEN 1 THEN '1323' WHEN 2 THEN '1340' WHEN 3 THEN '1310' WHEN 4 THEN '1100' END AS lu16",
        "shape_area",
    )


def prefix_parcels(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).selectExpr(
        "apn AS ain",
        "CASE id % 7 WHEN 0 THEN '3340' WHEN 1 THEN '3351' WHEN 2 THEN '33T0' WHEN 3 THEN NULL ELSE '3310' END AS use_code",
        "CASE WHEN id % 13 = 0 THEN 'Open Storage' ELSE 'Warehousing, Distribution, Storage' END AS use_description",
        "year_built AS year_built1",
        "shape_area",
        "geometry",
    )


def emissions(spark: SparkSession, d: str) -> DataFrame:
    lineitem, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).selectExpr(
        "CASE WHEN p_type = 'SMALL' THEN 'MDV' WHEN p_size % 9 = 0 THEN concat(p_type, ' SWCV') ELSE p_type END"
        " AS vehicle_category",
        "2022 AS calendar_year",
        "l_returnflag AS fuel",
        "l_quantity AS trips",
        "l_quantity * 1e3 AS total_vmt",
        "l_extendedprice / 1e5 AS n_ox_totex",
        "l_discount AS pm2_5_totex",
        "l_tax AS pm2_5_total",
        "l_extendedprice / 1e3 AS co2_totex",
    )


def address_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS page",
        "1 AS line_no",
        "CASE WHEN c_custkey % 17 = 0 THEN 'Page header' ELSE concat('~ ', CAST(c_custkey AS STRING),"
        " '  Main St Anaheim CA ', CAST(92800 + c_custkey % 50 AS STRING), ' = ', CAST(c_custkey + 1 AS STRING),"
        " ' Oak St  Fontana CA ', CAST(92330 + c_custkey % 10 AS STRING)) END AS line",
    )


def zip_rows(spark: SparkSession, d: str) -> DataFrame:
    """ZIP codes with county and state from the customers' own ZIPs."""
    return table(spark, d, "customer").selectExpr(
        "explode(array(92800 + c_custkey % 50, 92330 + c_custkey % 10)) AS zip"
    ).distinct().selectExpr(
        "zip", "CASE WHEN zip >= 92800 THEN 'Orange County' ELSE 'San Bernardino County' END AS county", "'CA' AS state"
    )


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """Numbered rows of many pages; page 0 holds a third of them."""
    return table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS page",
        "l_orderkey * 10 + l_linenumber AS line_no",
        "concat(CAST(l_partkey AS STRING), ' ', l_returnflag) AS line",
    )


def tracts(spark: SparkSession, d: str) -> DataFrame:
    """One tract per customer, with missing and negative scores."""
    return table(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS tract",
        "CASE c_nationkey % 5 WHEN 0 THEN 'Los Angeles' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Riverside'"
        " WHEN 3 THEN 'San Bernardino' ELSE 'Kern' END AS county",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal / 100e0 END AS ciscorep",
        "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey * 3 END AS tot_pop19",
    )


def county_layer(spark: SparkSession, d: str) -> DataFrame:
    """Counties with the boundary file's columns, one island part included."""
    return counties(spark).selectExpr(
        "name AS county_name", "CAST(CASE WHEN name = 'Orange' THEN 'Isle' END AS STRING) AS island", "geometry"
    )


def place_layer(spark: SparkSession, d: str) -> DataFrame:
    """Places with the place file's columns; a few carry names of coastal cities."""
    return towns(spark, d).selectExpr(
        "CASE id % 100 WHEN 3 THEN 'Malibu' WHEN 53 THEN 'Newport Beach' ELSE name END AS name",
        "concat(name, ' city') AS namelsad",
        "CAST(id * 1000 AS DOUBLE) AS aland",
        "geometry",
    )


def unincorporated(spark: SparkSession, d: str) -> DataFrame:
    return district_layer(spark, d, "lower").selectExpr(
        "CASE WHEN CAST(name AS INT) % 2 = 0 THEN 'Unincorporated' ELSE concat('City ', name) END AS city",
        "CASE CAST(name AS INT) % 10 WHEN 0 THEN 'Riverside' WHEN 2 THEN 'Imperial' WHEN 4 THEN 'Ventura'"
        " WHEN 6 THEN 'Orange' ELSE 'Los Angeles' END AS county",
        "geometry",
    )


def _wkb(polygons: list, order: str, height: bool) -> bytes:
    def polygon(rings: list) -> bytes:
        out = struct.pack(f"{order}BII", order == "<", 3 + 1000 * height, len(rings))
        for ring in rings:
            values = [x for v in ring for x in (v["x"], v["y"], *[7.0] * height)]
            out += struct.pack(f"{order}I{len(values)}d", len(ring), *values)
        return out

    if len(polygons) == 1 and order == "<":
        return polygon(polygons[0])
    return struct.pack(f"{order}BII", order == "<", 6 + 1000 * height, len(polygons)) + b"".join(map(polygon, polygons))


def as_wkb(shapes: DataFrame, column: str) -> DataFrame:
    """(name, column): the polygons (name, geometry) in binary, in spellings that change from row to row."""

    def run(batches):
        for batch in batches:
            held = batch.column("geometry").to_pylist()
            data = [_wkb(g["rings"], "<>"[i % 2], i % 3 == 0) for i, g in enumerate(held)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(data, pa.binary())], ["name", column])

    return shapes.mapInArrow(run, f"name string, {column} binary")
