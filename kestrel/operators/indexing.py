"""Contiguous, sorted integer indexes without funnelling rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ranges import range_bucket


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx", start: int = 0) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    Rows are numbered inside range buckets; a running count over the buckets (one row a
    bucket) gives each bucket's offset, which is joined back. No window over all rows,
    nothing collected but the sampled cut points.
    """
    dealt = df.withColumn("_bkt", range_bucket(df, order_cols))
    inside = Window.partitionBy("_bkt").orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    sizes = dealt.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = sizes.select("_bkt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return dealt.withColumn("_pos", F.row_number().over(inside)).join(offsets, "_bkt") \
        .withColumn(name, (F.col("_off") + F.col("_pos") - 1 + start).cast("long")).select(*df.columns, name)
