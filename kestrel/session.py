"""Session construction and the few cluster-level helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session defaults of this library; a value given to the cluster or the builder wins.
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kestrel") -> SparkSession:
    """Return the active session or build one.

    Settings that were given (spark-submit, defaults file, environment) are left as they
    are: only ``DEFAULTS`` that nobody gave are set, after the session exists. Shuffle
    partitions and the driver's memory belong to the cluster; ``shuffle_partitions`` sets the
    first where a caller asks for it (bench and tests), and a local session without a given
    driver memory takes ``KESTREL_DRIVER_MEMORY``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false") \
            .config("spark.ui.showConsoleProgress", "false")
        given = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
        if master.startswith("local") and "driver-memory" not in given and "spark.driver.memory" not in given:
            builder = builder.config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    known = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not known.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions and not known.contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is set, a local session gets a scratch folder of its own; a cluster has no
    folder that every machine sees unless it names one, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set; {master} needs a folder that all machines share")
        path = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def small_side(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` for a join whose other side has few, hot keys: written, and with a broadcast hint if it has at most ``most`` rows.

    Spark learns the size of a join's side only when the other side is being shuffled by its hot keys already.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
