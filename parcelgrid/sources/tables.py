"""Tabular sources and sinks: WKT layers, CSV with a preamble, serving tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.semantics import clean_names, snake_case
from . import wkb
from .geojson import geometry_from_json, readable
from .stages import materialise, scratch_folder  # noqa: F401  (also found here)


# ------------------------------------------------------------------------ WKT

def geometry_from_wkt(text: str) -> str:
    """SQL: WKT text (POINT, POLYGON, MULTIPOLYGON, with or without Z) to the geometry struct.

    The nested '(x y, x y)' lists are rewritten as JSON arrays of 'x y' texts and parsed once.
    """
    body = f"regexp_replace(trim({text}), r'^[A-Za-z]+\\s*(?:[Zz]?[Mm]?)\\s*(?=\\()', '')"
    body = f"regexp_replace({body}, r'\\s*([(),])\\s*', '$1')"
    body = f"regexp_replace({body}, r'([-+0-9.eE]+(?:\\s+[-+0-9.eE]+)+)', '\"$1\"')"
    body = f"translate({body}, '()', '[]')"

    def vertex(pair: str) -> str:
        return geo.let(
            f"split({pair}, '\\\\s+')",
            lambda xy: geo.vertex(f"try_cast({xy}[0] AS DOUBLE)", f"try_cast({xy}[1] AS DOUBLE)"),
        )

    def rings(part: str) -> str:
        return geo.each(part, lambda ring: geo.each(ring, vertex))

    def parsed(depth: int) -> str:
        return f"from_json({body}, '{'array<' * depth}string{'>' * depth}')"

    at = geo.let(vertex(f"{parsed(1)}[0]"), lambda v: geo.point(f"{v}.x", f"{v}.y"))
    return (
        f"CASE upper(regexp_extract({text}, '([A-Za-z]+)', 1)) WHEN 'POINT' THEN {at}"
        f" WHEN 'POLYGON' THEN {geo.polygon(f'array({rings(parsed(2))})')}"
        f" WHEN 'MULTIPOLYGON' THEN {geo.polygon(geo.each(parsed(3), rings))} END"
    )


def read_layer(
    spark: SparkSession, path: str, column: str = "wkt", encoding: str = "wkt", unreadable: str = "error"
) -> DataFrame:
    """A vector layer exported to Parquet with a column of shapes, which becomes ``geometry``.

    ``encoding`` is wkt, geojson or wkb (binary). A shape of another kind than point, polygon and
    multipolygon, or with a position that is no number, is an error, or NULL with ``unreadable="null"``.
    """
    layer = spark.read.parquet(path)
    if encoding == "wkb":
        return wkb.decoded(layer, column, unreadable)
    parse = {"wkt": geometry_from_wkt, "geojson": geometry_from_json}[encoding]
    shape = readable(F.expr(parse(f"`{column}`")), F.col(column), unreadable)
    return layer.withColumn("geometry", shape).drop(column)


# ------------------------------------------------------------------------ CSV

#: Column that holds the line of a row that does not fit its header.
CORRUPT = "_corrupt_record"


def parse_csv_lines(
    lines: DataFrame, header: str, types: Mapping[str, str] | None = None, unreadable: str = "error"
) -> DataFrame:
    """Text lines of CSV to the snake-cased columns that ``header`` names; blank lines are skipped.

    Columns are double unless ``types`` says otherwise. A row with a cell of another type, or with
    more or fewer cells than the header, is an error; with ``unreadable="keep"`` a further column
    ``_corrupt_record`` holds its line, NULL for sound rows, so that a job can set it aside.
    """
    types = dict(types or {})
    names = [snake_case(h.strip()) for h in next(csv.reader([header]))]
    schema = ", ".join([*(f"`{n}` {types.get(n, 'double')}" for n in names), f"{CORRUPT} string"])
    body = lines.where(F.length(F.trim("value")) > 0)
    rows = body.select(F.from_csv("value", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("_r"))
    if unreadable == "keep":
        return rows.select("_r.*")
    lost = F.raise_error(F.concat(F.lit("a CSV row does not fit its header: "), F.col(f"_r.{CORRUPT}")))
    sound = F.when(F.col(f"_r.{CORRUPT}").isNull(), F.col("_r")).otherwise(lost.cast(rows.schema["_r"].dataType))
    return rows.select(sound.alias("_r")).select(*[f"_r.`{n}`" for n in names])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): line counts from 0 in the first block of each file and is NULL in later ones.

    Lines of a block are read in order by one task, so a running id minus that of the file's first
    line is the line's number, and the files still split.
    """
    held = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    first = held.where("start = 0").groupBy("file").agg(F.min("id").alias("first"))
    return held.join(first, "file").select("file", F.expr("CASE WHEN start = 0 THEN id - first END").alias("line"), "value")


def read_csv_skip(
    spark: SparkSession, path: str, skip: int, types: Mapping[str, str] | None = None, unreadable: str = "error"
) -> DataFrame:
    """CSV files that each begin with ``skip`` lines of preamble and one header line.

    Lines are dropped by their position in their own file, never by what they say. Files with
    different headers are an error; only distinct headers come to the driver.
    """
    lines = numbered_lines(spark, path)
    headers = [r.value for r in lines.where(F.col("line") == skip).select("value").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"the files under {path} do not share one header: {headers}")
    body = lines.where(F.col("line").isNull() | (F.col("line") > skip))
    return parse_csv_lines(body, headers[0], types, unreadable)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Code tables, ZIP tables, curated lists: Parquet, or CSV with a header; names cleaned."""
    if path.rstrip("/").endswith(".csv"):
        return clean_names(spark.read.option("header", True).csv(path))
    return clean_names(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# -------------------------------------------------------------------- serving

def write_parcels(df: DataFrame, path: str) -> None:
    """Parquet by county, so a county or place question prunes files."""
    df.write.mode("overwrite").partitionBy("county").parquet(path)


def cluster_by_cell(df: DataFrame, cell: float = 0.1) -> DataFrame:
    """Rows near each other into the same files, so that a box filter skips most row groups.

    The range key ends in a hash of the row: a cell with a third of all rows is spread over
    many tasks instead of filling one.
    """
    g = F.col("geometry")
    keys = {
        "_cy": F.floor(g["ymin"] / cell),
        "_cx": F.floor(g["xmin"] / cell),
        "_spread": F.xxhash64(*df.columns),
    }
    return df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions("_cy", "_cx").drop(*keys)


def save_serving(tables: Mapping[str, DataFrame], path: str, cell: float = 0.1) -> None:
    """The dashboard's tables as Parquet folders under one path, clustered by grid cell."""
    for name, table in tables.items():
        if "geometry" in table.columns:
            table = cluster_by_cell(table, cell)
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_serving(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
