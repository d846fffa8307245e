"""Range buckets: rows dealt to ordered, equally filled buckets by a plain expression.

``repartitionByRange`` samples anew in every execution, so two branches of a plan may cut the
order at different places. Here the cut points are sampled once, in a bounded number, and become
literals: the bucket of a row is a function of its keys, equal in every branch and every retry,
without writing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 40
ROWS_PER_BUCKET = 50_000  # a smaller bucket is not worth a task
MOST_BUCKETS = 1024  # literals of the expression; a bucket of any size is sorted within memory and disk


def _literal(row, types: dict[str, str]) -> Column:
    return F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in types.items()])


def _tree(key: Column, cuts: list[Column], low: int, high: int) -> Column:
    """Number of cuts at or below ``key`` among cuts[low:high], plus ``low`` (balanced tests)."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < cuts[mid], _tree(key, cuts, low, mid)).otherwise(_tree(key, cuts, mid + 1, high))


def range_bucket(df: DataFrame, cols: list[str], descending: bool = False) -> Column:
    """Bucket number of each row in the order of ``cols`` (nulls first; reversed if descending)."""
    return range_bucket_of(df, cols, descending)[0]


def range_bucket_of(df: DataFrame, cols: list[str], descending: bool = False) -> tuple[Column, DataFrame | None]:
    """``range_bucket`` and its cut points (``cols``, fewer than ``MOST_BUCKETS`` rows); None if there is one bucket.

    As many buckets as the rows fill, one per shuffle partition and ``MOST_BUCKETS`` at most. At
    most ``SAMPLE_PER_BUCKET`` key rows per bucket are collected.
    """
    parts = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), MOST_BUCKETS)
    size = df.select(cols[0]).count()
    buckets = min(parts, -(-size // ROWS_PER_BUCKET))
    if buckets < 2:
        return F.lit(0), None
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    sample = df.select(*cols).orderBy(F.rand(11)).limit(SAMPLE_PER_BUCKET * buckets).collect()
    kept = df.sparkSession.createDataFrame(sample, df.select(*cols).schema) \
        .orderBy(*[F.col(c).asc_nulls_first() for c in cols]).collect()  # Spark's own order
    rows = [kept[len(kept) * k // buckets] for k in range(1, buckets)]
    seen = {tuple(r): r for r in rows}
    cuts = [_literal(r, types) for r in seen.values()]
    number = _tree(F.struct(*[F.col(c) for c in cols]), cuts, 0, len(cuts))
    return (F.lit(len(cuts)) - number if descending else number).cast("int"), \
        df.sparkSession.createDataFrame(list(seen.values()), df.select(*cols).schema)
