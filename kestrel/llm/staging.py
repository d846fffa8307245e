"""Written tables between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kestrel.session import ensure_checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release_staged)
    _WRITTEN.append((spark, path))
    return path


#: Rows and bytes of a batch that goes to a Python worker; a batch of texts is otherwise a few hundred MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends texts to Python in small batches (given settings are kept)."""
    spark = df.sparkSession
    known = spark.sparkContext.getConf()
    for key, value in BATCH.items():
        if key not in _PLAIN:  # Spark's own value, as a session on which nobody has set anything has it
            _PLAIN[key] = spark.newSession().conf.get(key, None)
        if not known.contains(key) and spark.conf.get(key, None) in (None, _PLAIN[key]):
            spark.conf.set(key, value)
    return df


_PLAIN: dict[str, str | None] = {}



def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow``, giving freed memory back when a task ends: workers live on through later stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


#: Spark removes a query's shuffle files when the query ends (else when the driver collects garbage).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_cleanly(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write ``df`` as Parquet and free the shuffle files of that job."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: its lineage ends here and it is not computed twice."""
    path = staging_path(df.sparkSession, name)
    write_cleanly(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for spark, path in list(_WRITTEN):
                if f"/{path.rsplit('/', 1)[-1]}/" in file:
                    _WRITTEN.remove((spark, path))
                    _delete(spark, path)


def release_staged() -> None:
    """Delete every staged table of this process (results that still read them become invalid)."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())
