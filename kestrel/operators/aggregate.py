"""Aggregations, summaries, sorts and limits (section E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.relational import unpivot


def group_stats(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def interactions_2stage(purchases: DataFrame) -> DataFrame:
    """(user, master, subcategory, type) -> count, upper-cased max item, first/last date;
    then (user, item, subcategory, type) -> summed purchases, first/last date."""
    first = purchases.groupBy("user_id", "master_product_id", "subcategory", "type").agg(
        F.count(F.lit(1)).alias("purchases"), F.max(F.upper("item_id")).alias("item_id"),
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))
    return first.groupBy("user_id", "item_id", "subcategory", "type").agg(
        F.sum("purchases").alias("purchases"), F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"))


def txn_rollup(items: DataFrame) -> DataFrame:
    """Transaction level roll-up of item rows (``is_sample`` marks sample items)."""
    s = F.col("is_sample")
    return items.groupBy("transaction_id", "customer_id", "order_date").agg(
        F.sum(F.when(~s, 1).otherwise(0)).alias("products"),
        F.sum(F.when(s, 1).otherwise(0)).alias("samples"),
        F.sum("amount").alias("amount"),
        F.array_sort(F.collect_set(F.when(~s, F.col("category")))).alias("category_product"),
        F.array_sort(F.collect_set(F.when(s, F.col("category")))).alias("category_sample"),
        F.max(F.col("event").cast("int")).alias("event"))


def rule_stats(df: DataFrame, key: str, value: str, count_col: str, date_col: str, min_count: int) -> DataFrame:
    """Per entity: max value, count, first/last date; only entities with count > min_count."""
    return df.groupBy(key).agg(
        F.max(value).alias(f"max_{value}"), F.count(F.lit(1)).alias("count"),
        F.max(count_col).alias(f"max_{count_col}"),
        F.min(date_col).alias("start_date"), F.max(date_col).alias("end_date")).where(F.col("count") > min_count)


def clean_rule_share(stats: DataFrame, value_col: str) -> DataFrame:
    """Entities per value, sorted by count, and the share of entities at the most frequent value."""
    per = stats.groupBy(value_col).agg(F.count(F.lit(1)).alias("count"))
    total = stats.select(F.count(F.lit(1))).scalar()
    top = per.agg(F.max_by(value_col, F.struct("count", F.col(value_col))).alias(value_col),
                  F.max("count").alias("count"))
    return top.select(value_col, "count", total.alias("entities"), (F.col("count") / total).alias("share"))


def pivot_topn(df: DataFrame, groupby: list[str], count_col: str, n: int | None) -> DataFrame:
    """Counts of non-null ``count_col`` per group, largest first, top n; pct over the shown rows."""
    counts = df.groupBy(*groupby).agg(F.count(count_col).alias("count"))
    if n is not None:
        counts = counts.orderBy(F.col("count").desc(), *[F.col(g).asc() for g in groupby]).limit(n)
    shown = counts.select(F.sum("count")).scalar()
    return counts.withColumn("pct", F.col("count") / shown)


def category_summary(df: DataFrame, cols: list[str], n: int, ascending: bool = False) -> DataFrame:
    """Frequency of each value of several columns (one shuffle for all), top n per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("kv")).select("kv.*")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    tot = counts.groupBy("variable").agg(F.sum("count").alias("_t"))
    order = F.col("count").asc() if ascending else F.col("count").desc()
    w = Window.partitionBy("variable").orderBy(order, F.col("value").asc_nulls_first())
    return counts.join(tot, "variable").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("variable", "value", "count", (F.col("count") / F.col("_t")).alias("pct"), "rank")


def missing_summary(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Null counts of every column per ``by`` value, one aggregation, then long form."""
    agg = df.groupBy(by).agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in cols])
    return agg.unpivot([by], cols, "variable", "missing")


PCT_DEFAULT = list(range(0, 6)) + [25, 50, 75] + list(range(95, 101))


def outlier_percentiles(df: DataFrame, cols: list[str], percentiles: list[int] | None = None,
                        rounding: int = 2, accuracy: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (``accuracy`` switches to approximate)."""
    from kestrel.operators.scorecard import exact_quantiles
    ps = percentiles or PCT_DEFAULT
    frac = [p / 100.0 for p in ps]
    long = unpivot(df, [], cols).where(F.col("value").isNotNull())
    if accuracy:
        res = long.groupBy("variable").agg(F.percentile_approx("value", frac, accuracy).alias("_q"))
    else:
        res = exact_quantiles(long, "value", frac, ["variable"])
    return res.select("variable", F.posexplode("_q").alias("i", "v")).select(
        "variable", F.element_at(F.array(*[F.lit(f"p{p}") for p in ps]), F.col("i") + 1).alias("percentile"),
        F.round("v", rounding).alias("value"))


def cluster_categorical(df: DataFrame, cluster: str, variables: list[str]) -> DataFrame:
    """Counts and % per (variable, value) for each cluster and for the whole sample
    (cluster ``SAMPLE``), plus a Total row summing the first variable."""
    long = df.select(F.col(cluster).cast("string").alias("cluster"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables])).alias("kv")) \
        .select("cluster", "kv.*").where(F.col("value").isNotNull())
    per = long.groupBy("variable", "value", "cluster").agg(F.count(F.lit(1)).alias("count"))
    per = per.unionByName(per.groupBy("variable", "value").agg(F.sum("count").alias("count"))
                          .withColumn("cluster", F.lit("SAMPLE")))
    tot = per.groupBy("variable", "cluster").agg(F.sum("count").alias("_t"))
    out = per.join(tot, ["variable", "cluster"]).withColumn("pct", F.col("count") / F.col("_t") * 100).drop("_t")
    first = out.where(F.col("variable") == variables[0]).groupBy("cluster").agg(
        F.sum("count").alias("count"), F.sum("pct").alias("pct"))
    total = first.select(F.lit("Total").alias("variable"), F.lit("Total").alias("value"), "cluster", "count", "pct")
    return out.select("variable", "value", "cluster", "count", "pct").unionByName(total)


def cluster_continuous(df: DataFrame, cluster: str, variables: list[str], median_only: bool = False) -> DataFrame:
    """min, 1Q, median, mean, 3Q, max per (variable, cluster); ``median_only`` keeps the median."""
    from kestrel.operators.scorecard import exact_quantiles
    long = unpivot(df, [cluster], variables).where(F.col("value").isNotNull()) \
        .select("variable", F.col(cluster).alias("cluster"), "value")
    agg = long.groupBy("variable", "cluster").agg(F.min("value").alias("min"), F.avg("value").alias("avg"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["variable", "cluster"])
    out = agg.join(q, ["variable", "cluster"]).select(
        "variable", "cluster", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("med"), "avg",
        F.col("_q")[2].alias("q3"), "max")
    return out.select("variable", "cluster", "med") if median_only else out


def cluster_top5_other(df: DataFrame, cluster: str, variables: list[str], top: int = 5) -> DataFrame:
    """Categorical profile keeping the ``top`` most frequent values of each variable
    (overall), the rest as ``Other``; a null value stays null and takes no place; counts per cluster and a grand total (cluster null)
    from one rollup."""
    long = df.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables])).alias("kv")) \
        .select("cluster", "kv.*")
    counts = long.groupBy("variable", "value", "cluster").agg(F.count(F.lit(1)).alias("_n"))  # before any join
    freq = counts.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("variable").orderBy(F.col("_n").desc(), F.col("value").asc())
    keep = freq.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("variable", "value",
                                                                                          F.lit(True).alias("_k"))
    label = F.when(F.col("_k") | F.col("value").isNull(), F.col("value")).otherwise(F.lit("Other"))
    grp = counts.join(keep, ["variable", "value"], "left").withColumn("value", label)
    return grp.rollup("variable", "value", "cluster").agg(F.sum("_n").alias("count"), F.grouping_id().alias("_g")) \
        .where(F.col("_g").isin(0, 1)).drop("_g")


def rollup_total(df: DataFrame, key: str, count_name: str, sums: dict[str, str], ratios: dict[str, tuple[str, str]],
                 total_label: str = "Total") -> DataFrame:
    """Group rows plus a recomputed total row (ratios of sums, not sums of ratios)."""
    agg = df.rollup(key).agg(F.count(F.lit(1)).alias(count_name),
                             *[F.sum(c).alias(n) for n, c in sums.items()], F.grouping(key).alias("_g"))
    out = agg.withColumn(key, F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col(key).cast("string")))
    for n, (a, b) in ratios.items():
        out = out.withColumn(n, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    return out.drop("_g")


def dataset_report(df: DataFrame, user: str, item: str, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(user).alias("users"),
                  F.countDistinct(item).alias("items"), F.min(date).alias("first_date"),
                  F.max(date).alias("last_date")).withColumn(
        "density", F.col("rows") / (F.col("users") * F.col("items")))


def totals_distribution(df: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """Distribution of per-key totals: the n most and the n least frequent totals."""
    tot = df.groupBy(key).agg(F.sum(value).alias("total"))
    dist = tot.groupBy("total").agg(F.count(F.lit(1)).alias("keys"))
    head = dist.orderBy(F.col("keys").desc(), F.col("total").asc()).limit(n) \
        .select(F.lit("head").alias("end"), "total", "keys")
    tail = dist.orderBy(F.col("keys").asc(), F.col("total").desc()).limit(n) \
        .select(F.lit("tail").alias("end"), "total", "keys")
    return head.unionByName(tail)


def histogram(df: DataFrame, col: str, bins: int, group_cols: list[str] | None = None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), per group."""
    g = group_cols or []
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull()).select(*g, x.alias("_x"))
    if g:
        j = base.join(base.groupBy(*g).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), g)
    else:
        j = base.withColumn("_lo", base.select(F.min("_x")).scalar()) \
            .withColumn("_hi", base.select(F.max("_x")).scalar())
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    counts = j.groupBy(*g, b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(*g, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"),
                         (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def topk(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """orderBy + limit: Spark plans TakeOrderedAndProject (per-partition top n, then merge)."""
    return df.orderBy(*order).limit(n)
