"""Replacing tables: a write that fails half-way leaves what was there."""

import os

import pytest
from pyspark.sql import functions as F

from kestrel.sources import files as FS
from kestrel.sources import snapshots as SN


def failing(df):
    """Rows of which one, late in the job, raises."""
    return df.repartition(4).withColumn("match", F.when(F.col("rank") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("match")))


def candidates(spark, n=60, algorithm="a"):
    return spark.range(n).select(F.lit("x").alias("input"), F.col("id").cast("int").alias("rank"), F.lit("y").alias("match"), F.lit(algorithm).alias("algorithm"))


def test_model_survives_a_lost_write(spark, tmp_path):
    path = str(tmp_path / "model")
    FS.save_model(candidates(spark, 10), path)
    held = FS.load_model(spark, path)
    with pytest.raises(Exception, match="lost"):
        FS.save_model(failing(candidates(spark)), path, check=False)
    assert FS.load_model(spark, path).count() == 10 and len(SN.versions(spark, path)) == 1
    FS.save_model(candidates(spark, 20), path)
    assert FS.load_model(spark, path).count() == 20
    assert held.count() == 10  # a reader that has begun goes on with its version
    FS.save_model(candidates(spark, 30), path)
    FS.save_model(candidates(spark, 40), path)
    assert FS.load_model(spark, path).count() == 40 and len(SN.versions(spark, path)) == 2


def test_version_without_a_pointer_is_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    SN.write_snapshot(spark.range(5), path)
    spark.range(99).write.parquet(f"{path}/versions/99999999-left-behind")
    assert SN.read_snapshot(spark, path).count() == 5
    with pytest.raises(SN.SnapshotMissing):
        SN.read_snapshot(spark, str(tmp_path / "none"))


def test_candidates_of_other_algorithms_stay(spark, tmp_path):
    path = str(tmp_path / "candidates")
    plain = candidates(spark, 8).drop("algorithm")
    FS.save_candidates(plain, path, "A/1 GRAM")
    FS.save_candidates(plain.limit(3), path, "B")
    with pytest.raises(Exception, match="lost"):
        FS.save_candidates(failing(candidates(spark).drop("algorithm")), path, "B")
    FS.save_candidates(plain.limit(5), path, "A/1 GRAM")
    got = {r["algorithm"]: r["count"] for r in FS.load_candidates(spark, path).groupBy("algorithm").count().collect()}
    assert got == {"A/1 GRAM": 5, "B": 3}


def test_export_survives_a_lost_write(spark, tmp_path):
    path = str(tmp_path / "export.csv")
    schema = "input string, rank int, match string, algorithm string"
    FS.write_csv(candidates(spark, 7), path, ";")
    with pytest.raises(Exception, match="lost"):
        FS.write_csv(failing(candidates(spark)), path, ";")
    assert FS.scan_csv(spark, path, schema, ";").count() == 7
    FS.write_csv(candidates(spark, 9), path, ";")
    assert FS.scan_csv(spark, path, schema, ";").count() == 9
    assert not [n for n in os.listdir(tmp_path) if ".old-" in n]
    FS.dump_batches(candidates(spark, 6), str(tmp_path / "batches"), "rank")
    with pytest.raises(Exception, match="lost"):
        FS.dump_batches(failing(candidates(spark)), str(tmp_path / "batches"), "rank")
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 6
