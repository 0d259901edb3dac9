"""Stages are written once for one state of their files."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.sources import stages


@pytest.fixture
def reuse(spark, tmp_path, monkeypatch):
    folder = tmp_path / "scratch"
    monkeypatch.setattr(stages, "scratch_folder", lambda spark: str(folder))
    spark.conf.set(stages.REUSE, "true")
    yield folder
    spark.conf.unset(stages.REUSE)


def written(folder):
    return sorted(str(p.parent) for p in Path(folder).rglob("_SUCCESS"))


def table(spark, path):
    return spark.read.parquet(str(path)).withColumn("g", F.expr(geo.box("x", "y", "x + 1", "y + 1")))


def shape(df):
    """A plan whose lambda variables and expression ids are new on every call."""
    return df.where("n > 1").select("n", F.expr(geo.area_planar("g")).alias("area"))


def test_an_unchanged_stage_is_read(spark, tmp_path, reuse):
    path = tmp_path / "in"
    spark.range(5).selectExpr("id AS n", "id / 2D AS x", "id / 3D AS y").write.parquet(str(path))
    first = stages.materialise(shape(table(spark, path)))
    nested = stages.materialise(first.groupBy("area").agg(F.sum("n").alias("n")))
    seen = written(reuse)
    assert len(seen) == 2
    again = stages.materialise(shape(table(spark, path)))
    stages.materialise(again.groupBy("area").agg(F.sum("n").alias("n")))
    assert written(reuse) == seen and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    stages.materialise(again.groupBy("area").agg(F.max("n").alias("n")))
    stages.materialise(table(spark, path).where("n > 2").select("n"))
    assert len(written(reuse)) == 4 and nested.count() >= 1


def test_an_outdated_stage_is_retired(spark, tmp_path, reuse):
    path, other = tmp_path / "in", tmp_path / "other"
    for target in (path, other):
        spark.range(5).selectExpr("id AS n", "0D AS x", "0D AS y").write.parquet(str(target))
    stages.materialise(stages.materialise(shape(table(spark, path))).where("n > 0"))
    kept = stages.materialise(shape(table(spark, other)))
    seen = set(written(reuse))
    spark.range(9).selectExpr("id AS n", "0D AS x", "0D AS y").write.mode("overwrite").parquet(str(path))
    new = stages.materialise(stages.materialise(shape(table(spark, path))).where("n > 0"))
    now = set(written(reuse))
    assert new.count() == 7 and kept.count() == 3
    assert len(now) == 3 and len(now & seen) == 1


def test_an_unfinished_stage_is_written_again(spark, tmp_path, reuse):
    path = tmp_path / "in"
    spark.range(5).selectExpr("id AS n", "0D AS x", "0D AS y").write.parquet(str(path))
    stages.materialise(shape(table(spark, path)))
    (folder,) = written(reuse)
    Path(folder, "_SUCCESS").unlink()
    shutil.move(str(next(Path(folder).glob("part-*"))), str(tmp_path / "gone"))
    assert stages.materialise(shape(table(spark, path))).count() == 3


def test_what_files_do_not_determine_is_not_reused(spark, tmp_path, reuse):
    path = tmp_path / "in"
    spark.range(5).selectExpr("id AS n", "0D AS x", "0D AS y").write.parquet(str(path))
    held = spark.read.parquet(str(path))
    local = spark.createDataFrame([(1,)], "n long")
    python = held.select("n").mapInArrow(lambda batches: batches, "n long")
    for df in (local, held.withColumn("r", F.rand()), held.withColumn("i", F.monotonically_increasing_id()), python, held.join(local, "n")):
        assert stages.stage_key(df) is None


def test_a_second_serving_call_writes_nothing(spark, sf_dir, tmp_path, monkeypatch, reuse):
    """Parcels, projects, counties and jurisdictions lie in files, as in a job."""
    from checks import registry
    from parcelgrid.plans import planned

    inputs = []
    monkeypatch.setattr(planned, "build_serving", lambda *tables: inputs.extend(tables) or tables[0])
    registry.serving_table(spark, sf_dir)
    monkeypatch.undo()
    monkeypatch.setattr(stages, "scratch_folder", lambda spark: str(reuse))
    paths = [str(tmp_path / f"input-{i}") for i in range(len(inputs))]
    for df, path in zip(inputs, paths, strict=True):
        df.write.parquet(path)

    def serving():
        return sorted(map(str, planned.build_serving(*map(spark.read.parquet, paths)).drop("geometry").collect()))

    before = set(written(reuse))
    first = serving()
    seen = set(written(reuse))
    assert seen > before and first
    assert serving() == first and set(written(reuse)) == seen
