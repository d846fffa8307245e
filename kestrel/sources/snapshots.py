"""Tables that are replaced as a whole: a new version beside the old one, then one pointer.

A version is written into a folder of its own under ``versions``; only when the job has ended is
an empty file of the version's name created under ``current``, which a file system does at once or
not at all. Readers take the newest name. So a lost job leaves the old version as it was and
at worst a folder that nobody points to, and a reader never meets half a version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it does not exist."""
    target, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions, the current one last."""
    return folder_names(spark, f"{path}/current")


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """``write`` a new version into the folder it is given, then point to it.

    Of the versions before, the newest ``keep - 1`` stay for readers that have begun.
    """
    before = versions(spark, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    version = f"{number:08d}-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/versions/{version}")
    pointer, fs = _path(spark, f"{path}/current/{version}")
    fs.create(pointer, False).close()
    for old in before[: len(before) + 1 - keep] if keep else []:
        for part in ("current", "versions"):  # the pointer first
            target, fs = _path(spark, f"{path}/{part}/{old}")
            fs.delete(target, True)
    return version


class SnapshotMissing(Exception):
    """A folder exists but holds no published version."""


def write_snapshot(df: DataFrame, path: str, keep: int = 2) -> str:
    return publish(df.sparkSession, path, lambda folder: df.write.parquet(folder), keep)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current version; a folder without one is an error."""
    known = versions(spark, path)
    if not known:
        raise SnapshotMissing(f"no published version under {path}")
    return spark.read.parquet(f"{path}/versions/{known[-1]}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` beside ``path``, then put the new folder in its place: for files that others read by path.

    The old folder is moved aside and goes only when the new one is in place.
    """
    mark = uuid.uuid4().hex[:12]
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write(new)
    (target, fs), (fresh, _), (aside, _) = _path(spark, path), _path(spark, new), _path(spark, old)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"cannot move the new files to {path}")
    if had:
        fs.delete(aside, True)
