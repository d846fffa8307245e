"""Skew-proof running aggregates (prefix sums, counts, max, min) per group.

A plain ``Window.partitionBy(g).orderBy(x)`` puts every row of a group in one
task; when one group holds a third of the data that task carries a third of the
data. Here the rows are dealt to range buckets on (group, order) instead, so a hot
group is spread over many buckets of about equal size:

1. bucket = range of (group, order), from sampled cut points (``ranges``);
2. running aggregate inside each (bucket, group) slice;
3. one total per (bucket, group) slice of the groups that a cut point falls into - no other lies in
   several buckets, so there are fewer than two a bucket;
4. offsets = running aggregate of the slice totals of earlier buckets, sent to every task;
5. combine the local value with the offset.

The data is shuffled once (step 2); nothing is written.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ranges import range_bucket_of
from kestrel.session import cut_lineage

_COMBINE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b,
            "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_ZERO = ("sum", "count")


def prefix_agg(df: DataFrame, group_cols: list[str], order_cols: list[str],
               aggs: list[tuple[str, str, str]], exclusive: bool = False,
               descending: bool = False) -> DataFrame:
    """Add running aggregates over rows ordered by ``order_cols`` within ``group_cols``.

    ``aggs`` holds (output column, input column, function in sum/count/max/min).
    ``exclusive`` leaves the current row out (values of strictly earlier rows; rows
    with equal order keys are still taken in a fixed order, so make the order unique).
    Sums and counts of no rows are 0; max and min of no rows are null.
    """
    def srt(c: str) -> Column:
        return F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first()

    df = cut_lineage(df)  # the sample, the count and the rows below read what is written here
    bucket, cuts = range_bucket_of(df, [*group_cols, *order_cols], descending)
    numbered = ranged = df.withColumn("__pf_pid", bucket)
    if cuts is not None:
        ranged = numbered.repartition("__pf_pid", *group_cols)
    w = Window.partitionBy("__pf_pid", *group_cols).orderBy(*[srt(c) for c in order_cols])
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = ranged
    for out, col, fn in aggs:
        src = F.lit(1) if fn == "count" and col == "*" else F.col(col)
        local = local.withColumn("_l_" + out, _AGG[fn](src).over(frame))
    if cuts is None:
        done = local
        for out, _, fn in aggs:
            done = done.withColumn(out, F.coalesce("_l_" + out, F.lit(0)) if fn in _ZERO else F.col("_l_" + out))
        return done.drop("__pf_pid", *["_l_" + out for out, _, _ in aggs])
    if group_cols:
        same = [numbered[c].eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]
        split = cuts.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols]).distinct()
        numbered = numbered.join(F.broadcast(split), reduce(and_, same), "left_semi")
    totals = numbered.groupBy("__pf_pid", *group_cols).agg(
        *[_AGG[fn](F.lit(1) if fn == "count" and col == "*" else F.col(col)).alias("_t_" + out)
          for out, col, fn in aggs])
    wt = Window.partitionBy(*group_cols).orderBy("__pf_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pf_pid", *group_cols, *[
        (F.sum if fn in ("sum", "count") else _AGG[fn])(F.col("_t_" + out)).over(wt).alias("_o_" + out)
        for out, col, fn in aggs])
    same = [F.col("l.__pf_pid") == F.col("o.__pf_pid")] + [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group_cols]
    joined = local.alias("l").join(F.broadcast(offsets.alias("o")), reduce(and_, same), "left") \
        .select("l.*", *[F.col(f"o._o_{out}") for out, _, _ in aggs])
    for out, col, fn in aggs:
        loc, off = F.col("_l_" + out), F.col("_o_" + out)
        if fn in _ZERO:
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            val = F.when(loc.isNull(), off).when(off.isNull(), loc).otherwise(_COMBINE[fn](loc, off))
        joined = joined.withColumn(out, val)
    return joined.drop("__pf_pid", *[f"_{p}_{out}" for out, _, _ in aggs for p in ("l", "o")])


def average_rank(df: DataFrame, group_cols: list[str], value_col: str, descending: bool = True,
                 name: str = "avg_rank", pct_name: str = "pct_rank") -> DataFrame:
    """Average rank of tied values (1-based) and its share of the group size.

    Rows are first reduced to distinct (group, value) counts, then a skew-proof prefix
    count gives the number of rows ranked strictly before each value.
    """
    counts = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    pre = prefix_agg(counts, group_cols, [value_col], [("_before", "_n", "sum")], exclusive=True,
                     descending=descending)
    if group_cols:
        ranks = pre.join(counts.groupBy(*group_cols).agg(F.sum("_n").alias("_size")), group_cols, "left")
    else:
        ranks = pre.withColumn("_size", counts.select(F.sum("_n")).scalar())
    ranks = ranks.select(*group_cols, value_col,
                         (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name),
                         ((F.col("_before") + (F.col("_n") + 1) / 2.0) / F.col("_size")).alias(pct_name))
    return df.join(ranks, [*group_cols, value_col], "left")
