"""GeoJSON as tables, read and written in parallel, with every feature or an error.

The usual writers put each feature of a collection on its own line, so a file of any size
splits by lines like plain text; newline-delimited features read the same way, and so do
several features on a line, a whole collection on a line, and features that share a line with
the collection's head or tail. A file whose features spread over lines is cut at its braces by as
many tasks as it has blocks (``json_blocks``); ``layout="auto"`` finds out which files those are, by
the braces that their lines leave open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from . import json_blocks


def _rings(coordinates: str) -> str:
    """Positions to vertices; a third number of a position (height) is dropped."""
    return geo.each(
        coordinates, lambda ring: geo.each(ring, lambda p: geo.vertex(f"{p}[0]", f"{p}[1]"))
    )


def geometry_from_json(text: str) -> str:
    """SQL: GeoJSON geometry text (Point, Polygon, MultiPolygon) to the geometry struct."""
    coordinates = f"get_json_object({text}, '$.coordinates')"

    def parsed(depth: int) -> str:
        return f"from_json({coordinates}, '{'array<' * depth}double{'>' * depth}')"

    one = geo.polygon(f"array({_rings(parsed(3))})")
    many = geo.polygon(geo.each(parsed(4), _rings))
    at = geo.let(parsed(1), lambda p: geo.point(f"{p}[0]", f"{p}[1]"))
    return (
        f"CASE get_json_object({text}, '$.type') WHEN 'Point' THEN {at}"
        f" WHEN 'Polygon' THEN {one} WHEN 'MultiPolygon' THEN {many} END"
    )


def readable(shape: Column, source: Column, unreadable: str = "error") -> Column:
    """The shape parsed from ``source`` if all its positions are numbers; else an error, or NULL."""
    if unreadable not in ("error", "null"):
        raise ValueError("unreadable is 'error' or 'null'")

    def missing(v: Column) -> Column:
        return v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"])

    def whole(parsed: Column) -> Column:
        odd = F.coalesce(F.exists(F.flatten(F.flatten(parsed["rings"])), missing), F.lit(False))
        good = parsed["xmin"].isNotNull() & ~odd
        if unreadable == "null":
            return F.when(good, parsed)
        lost = F.raise_error(F.concat(F.lit("a shape could not be read: "), F.substring(source.cast("string"), 1, 60)))
        return F.when(source.isNull() | good, parsed).otherwise(lost.cast(geo.GEOMETRY_DDL))

    return F.transform(F.array(shape), whole)[0]


def geometry_to_json(g: Column) -> Column:
    """Geometry struct to GeoJSON text; one part is a Polygon, several a MultiPolygon."""
    def ring(r: Column) -> Column:
        return F.transform(r, lambda v: F.array(v["x"], v["y"]))

    def parts(p: Column) -> Column:
        return F.transform(p, lambda rings: F.transform(rings, ring))

    def wrap(kind: str, coordinates: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))

    return (
        F.when(g["kind"] == "point", wrap("Point", F.array(g["xmin"], g["ymin"])))
        .when(F.size(g["rings"]) == 1, wrap("Polygon", parts(g["rings"]).getItem(0)))
        .otherwise(wrap("MultiPolygon", parts(g["rings"])))
    )


#: What opens a feature, wherever its line ends.
_OPENED = r'"type"\s*:\s*"Feature"'


def _feature_array(text: str) -> str:
    """SQL: the features of a comma-separated list of them; NULL if it is not wholly one."""
    parsed = f"from_json(concat('[', {text}, ']'), 'array<string>')"
    return geo.let(
        parsed,
        lambda a: f"CASE WHEN size({a}) > 0 AND forall({a}, f -> coalesce(get_json_object(f, '$.type') = 'Feature', false)) THEN {a} END",
    )


def _line_features(line: str) -> str:
    """SQL: the features of one line, NULL if it holds none or only a part of one.

    Tried as it is, as a whole collection, and without the collection's head and tail. Whichever it
    is, the line begins with a brace and closes one; parts of features mostly do not, and are not tried.
    """
    bare = rf"regexp_replace(trim({line}), r',\s*$', '')"
    headless = rf"""regexp_replace({bare}, r'^\s*[{{].*?"features"\s*:\s*\[', '')"""
    tailless = rf"regexp_replace({headless}, r'\]\s*(,[^\[\]]*)?[}}]\s*$', '')"
    whole = f"CASE WHEN get_json_object({bare}, '$.type') = 'FeatureCollection' THEN from_json(get_json_object({bare}, '$.features'), 'array<string>') END"
    tries = ", ".join([whole, *(_feature_array(t) for t in (bare, headless, tailless))])
    return rf"CASE WHEN {line} RLIKE r'(?s)^\s*[{{].*[}}]' THEN coalesce({tries}) END"


def _once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add a computed column that no filter or later use repeats: a generator ends their push-down."""
    return df.select("*", F.explode(F.array(value)).alias(column))


def _parsed(features: DataFrame, schema: str | T.StructType, unreadable: str = "error") -> DataFrame:
    """Attributes and shapes of features (_feature); what cannot be read is an error, or NULL."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    options = {"mode": "FAILFAST" if unreadable == "error" else "PERMISSIVE"}
    held = _once(features, "_source", F.get_json_object("_feature", "$.geometry"))
    shape = F.expr(geometry_from_json("_source"))
    return held.select(
        F.from_json(F.get_json_object("_feature", "$.properties"), fields, options).alias("_p"),
        readable(shape, F.col("_source"), unreadable).alias("geometry"),
    ).select("_p.*", "geometry")


def parse_features(
    lines: DataFrame, schema: str | T.StructType, column: str = "value", unreadable: str = "error"
) -> DataFrame:
    """Feature lines to attribute columns plus ``geometry``.

    Lines that open no feature are skipped; a line that opens one and does not close it is an
    error, since its feature would be lost.
    """
    found = geo.let(
        _line_features(f"`{column}`"),
        lambda a: f"CASE WHEN {a} IS NULL AND `{column}` RLIKE r'{_OPENED}'"
        f" THEN raise_error('a GeoJSON feature spreads over lines: read it with layout auto or document') ELSE {a} END",
    )
    return _parsed(lines.select(F.explode(F.expr(found)).alias("_feature")), schema, unreadable)


def feature_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows to feature lines in one column ``value``."""
    names = [c for c in df.columns if c != geometry]
    properties = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    shape = F.coalesce(geometry_to_json(F.col(geometry)), F.lit("null"))
    return df.select(
        F.concat(
            F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")
        ).alias("value")
    )


_HEAD = r'(?s)^.*?"features"\s*:\s*\[\s*'


def _documents(
    spark: SparkSession, paths: str | list[str], schema: str | T.StructType, unreadable: str = "error"
) -> DataFrame:
    """The features of files in any layout, cut at their braces."""
    found = json_blocks.objects(spark, paths)
    text = F.regexp_replace("found", r"^[\s,\x{1E}\x{FEFF}]+", "")
    rows = _once(found.select("before", "after", F.col("text").alias("found")), "text", text)
    element = F.col("after") == 2
    head = element & ((F.col("before") == 0) | ~F.col("text").startswith("{"))
    foreign = head & ~F.col("text").rlike(r'"features"\s*:\s*\[')
    rest = ~element & ((F.col("before") != 0) | (F.col("after") != 0))
    own = F.when(head, F.regexp_replace("text", _HEAD, "")).otherwise(F.col("text"))
    none = head & own.startswith("]")
    rows = _once(rows, "object", F.when(~(foreign | rest | none | (F.col("text") == "")), own)).where("object IS NOT NULL")
    start = F.substring("object", 1, 60)
    lost = F.raise_error(F.concat(F.lit("a GeoJSON file holds features that could not be read: "), start)).cast("string")
    unread = F.col("object").isNotNull() & F.json_object_keys("object").isNull()
    feature = F.when(unread, lost).when(F.get_json_object("object", "$.type") == "Feature", F.col("object"))
    return _parsed(_once(rows, "_feature", feature).where("_feature IS NOT NULL").select("_feature"), schema, unreadable)


def spread_files(lines: DataFrame) -> list[str]:
    """The files whose lines do not each hold whole features (their names come to the driver).

    Lines that hold none may leave open one brace, that of a collection whose head names its
    features; whatever else is left open belongs to an object that goes on in other lines. A line
    that names a feature and holds no whole one counts as such, too.
    """
    whole = F.expr(_line_features("value")).isNotNull()
    opened = F.regexp_replace(json_blocks.unmatched(json_blocks.plain_text(F.col("value"))), r"[^{]+", "")
    seen = lines.select(
        F.col("_metadata.file_path").alias("name"),
        F.when(whole, 0).when(F.col("value").rlike(_OPENED), 2).otherwise(F.length(opened)).alias("opened"),
        F.col("value").rlike(r'"features"\s*:').cast("int").alias("heads"),
    )
    sums = seen.groupBy("name").agg(F.sum("opened").alias("opened"), F.sum("heads").alias("heads"))
    return [r["name"] for r in sums.where("opened > 1 OR (opened = 1 AND heads = 0)").select("name").collect()]


def read_geojson(
    spark: SparkSession, path: str, schema: str | T.StructType, layout: str = "lines", unreadable: str = "error"
) -> DataFrame:
    """GeoJSON files to a table; ``schema`` names the attributes to keep.

    ``lines`` refuses files whose features spread over lines, ``document`` cuts every file at its
    braces, and ``auto`` looks once through the lines for files that need that. An attribute that
    is not of its type, a shape that is no point, polygon or multipolygon, or a position that is no
    number is an error, or NULL with ``unreadable="null"``.
    """
    if layout == "document":
        return _documents(spark, path, schema, unreadable)
    if layout not in ("lines", "auto"):
        raise ValueError("layout is 'lines', 'document' or 'auto'")
    lines = spark.read.text(path)
    names = spread_files(lines)
    if names and layout == "lines":
        raise ValueError(f"a GeoJSON feature spreads over lines: read it with layout auto or document: {names[:3]}")
    if not names:
        return parse_features(lines, schema, unreadable=unreadable)
    rest = parse_features(lines.where(~F.col("_metadata.file_path").isin(names)).select("value"), schema, unreadable=unreadable)
    return rest.unionByName(_documents(spark, names, schema, unreadable))


def write_collections(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with files that are each one valid FeatureCollection, one per partition.

    The files are written beside the old ones; only a whole set takes their place, so a job that
    fails leaves them as they were. An empty table gives one empty collection.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = '{"type":"FeatureCollection","features":['
        for batch in batches:
            values = batch.column("value").to_pylist()
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([line, *[v + "," for v in values[:-1]]])], ["value"])
                line = values[-1] + ","
        yield pa.RecordBatch.from_arrays([pa.array([line[:-1] if line.endswith(",") else line, "]}"])], ["value"])

    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    if df.isEmpty():
        spark.createDataFrame([('{"type":"FeatureCollection","features":[]}',)], "value string").coalesce(1).write.text(fresh)
    else:
        feature_lines(df).mapInArrow(run, "value string").write.text(fresh)
    target, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), fresh, f"{fresh}.old"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(new, target):
        raise OSError(f"the files written to {fresh} could not be put in place")
    files.delete(old, True)


def write_geojson(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with feature lines, one file per partition."""
    feature_lines(df).write.mode("overwrite").text(path)
