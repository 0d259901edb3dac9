"""Stages that a job writes and goes on from, and their reuse.

A stage is known by what it computes (its plan) and by what from (the files it reads, their times
and sizes). With ``parcelgrid.stages.reuse`` set to true in the session, a stage that was written
before from the same files is read, not written again; one of the same plan whose files have changed
since is written anew and the outdated one is removed. Stages that read stages work alike, since a
reused one keeps its path and times. Plans that are not a function of their files alone (rows from
the driver, random or numbered rows, Python functions, whose code the plan does not show) are
written every time.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REUSE = "parcelgrid.stages.reuse"
_FIELDS = "spark.sql.debug.maxToStringFields"
#: Leaves whose data the files or the plan's text tell in full.
_KNOWN_LEAVES = {"LogicalRelation", "OneRowRelation", "Range"}
_PYTHON = re.compile(r"Python|Pandas|MapIn|FlatMap|CoGroup")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` as the session has it.

    A local session without the setting gets a temporary folder; a cluster must name one that
    all executors reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return tempfile.mkdtemp(prefix="parcelgrid-")


def _digest(parts: Sequence[object]) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:32]


def _plan_text(df: DataFrame) -> str | None:
    """The plan with its ids and variables numbered by their place; None if files do not determine it."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    names = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if not names <= _KNOWN_LEAVES or not plan.deterministic():
        return None
    old = spark.conf.get(_FIELDS)
    spark.conf.set(_FIELDS, "1000000")
    try:
        text = plan.canonicalized().toString()
    finally:
        spark.conf.set(_FIELDS, old)
    if _PYTHON.search(text):
        return None
    seen: dict[str, str] = {}
    return re.sub(r"#\d+|\bv\d+_", lambda m: seen.setdefault(m[0], f"{m[0][0]}{len(seen)}"), text)


def stage_key(df: DataFrame) -> tuple[str, str] | None:
    """(what a stage computes, from which state of its files); None if it cannot be known.

    The files are listed by Spark; a row for each file comes to the driver.
    """
    text = _plan_text(df)
    files = sorted(df.inputFiles()) if text else []
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", F.col("modificationTime").cast("double"), "length")
    state = sorted(map(tuple, listed.collect()))
    folders = sorted({re.sub(r"(/reused/[0-9a-f]+)/[0-9a-f]+$", r"\1", f.rpartition("/")[0]) for f in files})
    return _digest([text, *folders]), _digest(state)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _reused(df: DataFrame, folder: str, key: tuple[str, str]) -> DataFrame:
    """The stage of that key, written if it is not there whole; outdated ones of its plan go."""
    spark = df.sparkSession
    plan = f"{folder}/reused/{key[0]}"
    path = f"{plan}/{key[1]}"
    done, files = _files(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        df.write.mode("overwrite").parquet(path)
        for status in files.listStatus(_files(spark, plan)[0]):
            if status.getPath().getName() != key[1]:
                files.delete(status.getPath(), True)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a slow stage once and go on from the written table, which also cuts the lineage.

    Without a path the table goes to a new subfolder of :func:`scratch_folder`, or, if the session
    reuses stages and this one's files determine it, to the subfolder of its key. What is read back
    is plain Parquet: its columns prune, its boxes filter, and a lost executor costs only the tasks
    that read.
    """
    spark = df.sparkSession
    if path is None:
        folder = scratch_folder(spark).rstrip("/")
        if spark.conf.get(REUSE, "false") == "true" and (key := stage_key(df)):
            return _reused(df, folder, key)
        path = f"{folder}/stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
