"""Delimited files, named datasets, batch folders and result tables.

Paths are plain strings understood by the cluster's file system (HDFS, object
store, or a local folder in tests). Scratch output goes under the session's
shared ``spark.checkpoint.dir``; only a local session without one uses a
temporary folder of its machine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.snapshots import SnapshotMissing, folder_names, read_snapshot, replace_folder, versions, write_snapshot


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kestrel-{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", encoding: str = "UTF-8",
             header: bool = True) -> DataFrame:
    """Delimited read with a declared schema (no inference pass); with ``header`` the
    file's own header line is skipped and the declared names are used. Code pages
    outside Spark's default charset list (e.g. cp1250) need the Java charset switch."""
    _allow_charset(spark, encoding)
    return spark.read.schema(schema).option("header", header).option("sep", sep) \
        .option("encoding", encoding).option("mode", "FAILFAST").csv(path)


_STD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    """The switch is read when the file is, so it stays on for the session once needed."""
    if encoding.lower() not in _STD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Flat export; an export that is there already is replaced once the new one is whole."""
    _allow_charset(df.sparkSession, encoding)
    replace_folder(df.sparkSession, path, lambda folder: df.write.option("header", True).option("sep", sep)
                   .option("encoding", encoding).csv(folder))


class DatasetMissing(Exception):
    """A mandatory named dataset file does not exist."""


def load_dataset(spark: SparkSession, root: str, name: str, schema: str, mandatory: bool = True, sep: str = ";",
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Load ``root/name.csv``; a missing optional file gives None, a missing mandatory
    file raises. ``transform`` is applied to the loaded frame."""
    path = f"{root.rstrip('/')}/{name}.csv"
    if not path_exists(spark, path):
        if mandatory:
            raise DatasetMissing(path)
        return None
    df = scan_csv(spark, path, schema, sep)
    return transform(df) if transform else df


def melt_mappings(df: DataFrame) -> DataFrame:
    """(entity, attribute, mapping 'a,b,...') -> (data_field, business_term) rows."""
    term = F.concat_ws(".", "entity", "attribute")
    return df.select(F.explode(F.split("mapping", ",")).alias("data_field"), term.alias("business_term")) \
        .select(F.trim("data_field").alias("data_field"), "business_term").where(F.col("data_field") != "")


def dump_batches(df: DataFrame, path: str, batch_col: str) -> None:
    """Write a frame as one folder per batch value (partition discovery on read)."""
    replace_folder(df.sparkSession, path, lambda folder: df.write.partitionBy(batch_col).parquet(folder))


def load_batches(spark: SparkSession, paths: list[str], key: list[str] | None = None,
                 order_by: list[str] | None = None, base_path: str | None = None) -> DataFrame:
    """Read several batch folders as one frame; optionally keep one row per ``key``
    (the first in ``order_by`` order, deterministic) - an aggregate, not a global sort."""
    reader = spark.read.option("basePath", base_path) if base_path else spark.read
    df = reader.parquet(*paths)
    if key:
        from kestrel.operators.relational import dedup_subset
        df = dedup_subset(df, key, order_by or key)
    return df


def save_candidates(candidates: DataFrame, path: str, algorithm: str) -> None:
    """Replace one algorithm's candidates by a new version, keep the others."""
    write_snapshot(candidates.withColumn("algorithm", F.lit(algorithm)), f"{path}/{quote(algorithm, safe='')}")


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Current candidates of all algorithms under ``path``."""
    tables = [read_snapshot(spark, f"{path}/{name}") for name in folder_names(spark, path) if versions(spark, f"{path}/{name}")]
    if not tables:
        raise SnapshotMissing(f"no candidates under {path}")
    return reduce(DataFrame.unionByName, tables)


class ModelDowngrade(ValueError):
    """Refused to overwrite a saved model with one holding fewer algorithms."""


def save_model(candidates: DataFrame, path: str, check: bool = True) -> None:
    """Save a mapping model (candidates of several algorithms); with ``check``, refuse
    to replace a saved model that holds more algorithms than the new one. The model is a
    snapshot (``sources.snapshots``): a lost job leaves the old one whole."""
    spark = candidates.sparkSession
    if check:
        saved = path_exists(spark, path)  # a saved model that cannot be read is an error, not a reason to replace it
        old = load_model(spark, path).select(F.countDistinct("algorithm")).first()[0] if saved else 0
        new = candidates.select(F.countDistinct("algorithm")).first()[0]
        if old > new:
            raise ModelDowngrade(f"{path} holds {old} algorithms, the new model {new}")
    write_snapshot(candidates, path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path)


def log_metrics(spark: SparkSession, path: str, run: str, values: dict[str, float], kind: str = "metric") -> DataFrame:
    """Append (run, kind, name, value) rows to a metrics table and return the table."""
    rows = [(run, kind, k, float(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "run string, kind string, name string, value double").write.mode("append").parquet(path)
    return spark.read.parquet(path)
