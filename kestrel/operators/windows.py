"""Ordered, per-key computations (section F).

Running quantities over a key use the skew-proof ``prefix_agg`` kernel, so one
customer or item holding a large share of the rows does not land in one task.
Lags over regular time series use ordinary windows: a series is bounded by its
calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.indexing import dense_index
from kestrel.operators.prefix import average_rank, prefix_agg


def disjoint_windows(df: DataFrame, key: str, date: str, tiebreak: str, window: int = 120) -> DataFrame:
    """Drop rows whose next row of the same key (by date, then tiebreak) is fewer than
    ``window`` days later."""
    nxt = prefix_agg(df, [key], [date, tiebreak], [("_next", date, "min")], exclusive=True, descending=True)
    return nxt.where(F.col("_next").isNull() | (F.datediff(F.col("_next"), F.col(date)) >= window)).drop("_next")


def cut_last_order(df: DataFrame, date: str, last_date: str) -> DataFrame:
    return df.where(F.col(date) <= F.to_date(F.lit(last_date)))


def rfm(df: DataFrame, key: str, date: str, tiebreak: str, amount: str) -> DataFrame:
    """As of each row: days since the key's previous row, count and sum of previous rows."""
    out = prefix_agg(df, [key], [date, tiebreak],
                     [("_prev", date, "max"), ("frequency", "*", "count"), ("monetary", amount, "sum")],
                     exclusive=True)
    return out.withColumn("recency", F.datediff(F.col(date), F.col("_prev"))).drop("_prev")


def rfm_asof(history: DataFrame, probes: DataFrame, key: str, date: str, amount: str, probe_id: str) -> DataFrame:
    """RFM of each probe against a separate history: rows of the history strictly before
    the probe date. History and probes are unioned and scanned once (no range join)."""
    h = history.select(key, F.col(date).alias("_d"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_pid"),
                       F.col(amount).cast("double").alias("_amt"))
    p = probes.select(key, F.col(date).alias("_d"), F.lit(0).alias("_kind"), F.col(probe_id).cast("long").alias("_pid"),
                      F.lit(None).cast("double").alias("_amt"))
    u = h.unionByName(p).withColumn("_hd", F.when(F.col("_kind") == 1, F.col("_d")))
    out = prefix_agg(u, [key], ["_d", "_kind", "_pid"],
                     [("_prev", "_hd", "max"), ("frequency", "_kind", "sum"), ("monetary", "_amt", "sum")],
                     exclusive=True)
    return out.where(F.col("_kind") == 0).select(
        F.col("_pid").alias(probe_id), key, F.col("_d").alias(date),
        F.datediff(F.col("_d"), F.col("_prev")).alias("recency"), F.col("frequency").cast("long").alias("frequency"),
        F.col("monetary").cast("double").alias("monetary"))


def avg_rank_pct(df: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """Average rank (descending, ties averaged) and rank / group size."""
    return average_rank(df, group_cols, value, descending=True)


def item_popularity(df: DataFrame, item: str, weight: str) -> DataFrame:
    pop = df.groupBy(item).agg(F.sum(weight).alias("popularity"))
    return average_rank(pop, [], "popularity", descending=True)


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str = "running") -> DataFrame:
    return prefix_agg(df, [key], order, [(name, value, "sum")])


def lag_pairs(df: DataFrame, key: str, order: str, value: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, value, *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in lags])


def index_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """Sorted contiguous 0-based index of the distinct values of ``col``."""
    return dense_index(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], name)


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merge overlapping or touching [start, end] intervals per key (gaps and islands)."""
    base = df.select(key, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull()).distinct()
    prev = prefix_agg(base, [key], [start, end], [("_pmax", end, "max")], exclusive=True)
    flagged = prev.withColumn("_new", F.when(F.col("_pmax").isNull() | (F.col(start) > F.col("_pmax")), 1)
                              .otherwise(0))
    isl = prefix_agg(flagged, [key], [start, end], [("_island", "_new", "sum")])
    return isl.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def longest_run(df: DataFrame, key: str, value: str) -> DataFrame:
    """Longest run of consecutive integers per key; ties go to the smallest start."""
    d = df.select(key, F.col(value).cast("long").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    r = prefix_agg(d, [key], ["_v"], [("_before", "*", "count")], exclusive=True)
    runs = r.groupBy(key, (F.col("_v") - F.col("_before")).alias("_g")).agg(
        F.min("_v").alias("start"), F.max("_v").alias("end"), F.count(F.lit(1)).alias("length"))
    best = runs.groupBy(key).agg(F.max_by(F.struct("start", "end", "length"),
                                          F.struct("length", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(key, "b.start", "b.end", "b.length")
