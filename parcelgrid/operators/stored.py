"""Tables stored in buckets by grid cell, put in place version by version.

The rows' grid keys are computed once, when the table is written, and are its bucket columns: a
grid join reads the buckets where they are, and only the other side is dealt out by the same keys.
Cells with over ``crowd`` rows are stored in several parts, so a city's cell fills no single bucket;
which cells are dense is stored with the rows, and a join sends its other side to all parts.

A table is a folder. Each write makes a new version beside the others and then replaces one small
file that names the version in use, by a rename; until then readers see the old version whole, and
a write that fails changes nothing. Older versions stay for readers that have begun with them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .spatial import KEYS, keyed_rows, spatial_join

CURRENT = "current.json"


@dataclass(frozen=True)
class Stored:
    """A stored table: its rows with their grid keys, its dense cells, and what it was stored by."""

    rows: DataFrame
    dense: DataFrame
    cell: float
    points: bool
    geometry: str

    def join(self, right: DataFrame, predicate: str = "intersects", how: str = "left", **options) -> DataFrame:
        """:func:`spatial_join` with the stored rows driving, read by their buckets."""
        return spatial_join(
            self.rows, right, predicate, how, cell=self.cell, left_points=self.points, left_geometry=self.geometry, dense=self.dense, **options
        )


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target, jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)


def _put_in_place(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: written under another name, then renamed over it."""
    jvm = spark._jvm
    fresh = f"{path}.{uuid.uuid4().hex}"
    target, files = _hadoop(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(fresh)
    out = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(source, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(source, target, options)


def _name(version: str) -> str:
    return f"stored_{version.replace('-', '_')}"


def save_bucketed(
    df: DataFrame, path: str, *, cell: float, buckets: int, crowd: int = 1_000_000, geometry: str = "geometry", points: bool = False
) -> None:
    """Write ``df`` as the new version of the table at ``path``.

    ``cell`` is the grid of the joins to come, ``buckets`` their number of tasks. A grid key may
    not be a column's name already.
    """
    taken = {c.lower() for c in df.columns} & set(KEYS)
    if taken:
        raise ValueError(f"columns are named like grid keys: {sorted(taken)}")
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    rows, dense = keyed_rows(df, cell=cell, crowd=crowd, geometry=geometry, points=points)
    dense.write.parquet(f"{path}/{version}/dense")
    dealt = rows.repartition(buckets, *KEYS)
    writer = dealt.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", f"{path}/{version}/rows")
    writer.saveAsTable(_name(version))
    told = {"version": version, "cell": cell, "buckets": buckets, "geometry": geometry, "points": points, "schema": rows.schema.json()}
    _put_in_place(spark, f"{path}/{CURRENT}", json.dumps(told))


def load_bucketed(spark: SparkSession, path: str) -> Stored:
    """The version in use. A session that did not write it learns of its buckets here."""
    path = path.rstrip("/")
    told = json.loads(spark.read.text(f"{path}/{CURRENT}", wholetext=True).first()["value"])
    name, keys = _name(told["version"]), ", ".join(KEYS)
    if not spark.catalog.tableExists(name):
        fields = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(told["schema"]).toDDL()
        place = f"{path}/{told['version']}/rows".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys})"
            f" INTO {int(told['buckets'])} BUCKETS LOCATION '{place}'"
        )
    dense = spark.read.schema("k int, cx bigint, cy bigint, parts int").parquet(f"{path}/{told['version']}/dense")
    return Stored(spark.table(name), dense, told["cell"], told["points"], told["geometry"])
