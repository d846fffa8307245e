"""Projections, scalar feature maps, joins and set operations (sections B, C, G).

All functions are DataFrame -> DataFrame compositions of built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# B1-B19, B22, B26, B27
# ---------------------------------------------------------------------------

def wrangle_chain(df: DataFrame, rename: dict[str, str], flag_name: str, flag_cond: Column,
                  keep: Column, order_by: list[Column], columns: list[str]) -> DataFrame:
    """rename -> conditional 0/1 column -> filter -> sort -> select."""
    out = df
    for a, b in rename.items():
        out = out.withColumnRenamed(a, b)
    out = out.withColumn(flag_name, F.when(flag_cond, 1).otherwise(0))
    return out.where(keep).orderBy(*order_by).select(*columns)


def not_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(~F.col(col).startswith(prefix))


def date_from_parts(text: Column | str) -> Column:
    """Date from a ``dd.mm.yyyy...`` string by its fixed character positions."""
    s = _c(text)
    return F.make_date(F.substring(s, 7, 4).cast("int"), F.substring(s, 4, 2).cast("int"),
                       F.substring(s, 1, 2).cast("int"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def exclusion_share(df: DataFrame, keep: Column, event: Column | str) -> DataFrame:
    """Share of rows and of events that survive the ``keep`` condition, in one pass."""
    e = _c(event).cast("double")
    return df.agg(
        (F.sum(F.when(keep, 1).otherwise(0)) / F.count(F.lit(1))).alias("share_rows"),
        (F.sum(F.when(keep, e).otherwise(0.0)) / F.sum(e)).alias("share_events"),
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(keep, 1).otherwise(0)).alias("rows_kept"))


def bucket_other(col: Column | str, other: list, label: str = "OT") -> Column:
    return F.when(_c(col).isin(other), F.lit(label)).otherwise(_c(col))


def rare_to_other(df: DataFrame, col: str, min_share: float, label: str = "OT", out: str | None = None) -> DataFrame:
    """Merge values whose share of rows is below ``min_share`` into ``label``.
    Value counts are one row per distinct value; joined back by key."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1))).scalar()
    rare = counts.where(F.col("_n") < total * min_share).select(col, F.lit(True).alias("_rare"))
    j = df.join(rare, col, "left")
    return j.withColumn(out or col, F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(col))).drop("_rare")


def bands(col: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label by the first edge the value is below; the last label above all edges."""
    c = _c(col)
    expr = None
    for e, lab in zip(edges, labels):
        expr = F.when(c < e, lab) if expr is None else expr.when(c < e, lab)
    return expr.otherwise(labels[len(edges)])


def recode_values(col: Column | str, values: list, to) -> Column:
    return F.when(_c(col).isin(values), F.lit(to)).otherwise(_c(col))


def zero_flag(col: Column | str) -> Column:
    return F.when(_c(col) == 0, 1).otherwise(0)


def array_flags(col: Column | str, categories: list[str], suffix: str) -> list[Column]:
    return [F.array_contains(_c(col), c).alias(f"{c.lower()}_in_{suffix}") for c in categories]


def array_overlap(a: Column | str, b: Column | str) -> Column:
    """True when the arrays share an element (false when either is empty)."""
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def array_string(col: Column | str) -> Column:
    """Python-style text of a list of strings: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(col), lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                             ", "), F.lit("]"))


def date_parts(col: Column | str, prefix: str) -> list[Column]:
    d = _c(col)
    return [F.date_format(d, "MMMM").alias(f"{prefix}_month"), F.date_format(d, "EEEE").alias(f"{prefix}_day"),
            F.month(d).alias(f"{prefix}_month_id"), F.weekday(d).alias(f"{prefix}_day_id"),
            F.year(d).alias(f"{prefix}_year")]


def boxcox(col: Column | str, lmbda: float) -> Column:
    y = _c(col).cast("double")
    return F.log(y) if lmbda == 0 else (F.pow(y, F.lit(lmbda)) - 1) / lmbda


def inv_boxcox(col: Column | str, lmbda: float) -> Column:
    y = _c(col).cast("double")
    return F.exp(y) if lmbda == 0 else F.pow(y * lmbda + 1, F.lit(1.0 / lmbda))


def boxcox_lambda(df: DataFrame, col: str, group_cols: list[str] | None = None,
                  grid: tuple[float, float, float] = (-2.0, 2.0, 0.01)) -> DataFrame:
    """Maximum-likelihood Box-Cox lambda per group, on a lambda grid, in one pass.

    llf(l) = -(n/2) ln(var_l) + (l-1) sum(ln y), var_l the (biased) variance of the
    transformed values. A task transforms its rows with all lambdas in Arrow batches and returns
    one row of moments per group and lambda, which are put together by group; the best lambda is kept with max_by.
    """
    group_cols = group_cols or []
    lo, hi, step = grid
    lams = [round(i * step + lo, 6) for i in range(int(round((hi - lo) / step)) + 1)]
    y = F.col(col).cast("double")
    named = {c: f"_g{i}" for i, c in enumerate(group_cols)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(y > 0).select(*[F.col(c).alias(n) for c, n in named.items()], y.alias("_y")).repartition(parts)
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in named.values()]
    kept = rows.mapInArrow(_boxcox_moments(list(named.values()), lams),
                           ", ".join([*kinds, "lmbda double", "n long", "m double", "m2 double", "sl double"]))
    # moments about the smallest mean: exactly 0 where all values are the same
    keys = [*named.values(), "lmbda"]
    least = F.min("m").over(Window.partitionBy(*keys))
    kept = kept.withColumn("d", F.col("m") - least)
    agg = kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sl").alias("sl"), F.sum("m2").alias("m2"),
                                  F.sum(F.col("n") * F.col("d")).alias("s1"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("s2"))
    v = (F.col("m2") + F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))) / F.col("n")
    llf = -(F.col("n") / 2.0) * F.log(v) + (F.col("lmbda") - 1) * F.col("sl")
    return agg.withColumn("llf", llf).groupBy(*[F.col(n).alias(c) for c, n in named.items()]).agg(
        F.max_by("lmbda", "llf").alias("lmbda"), F.max("llf").alias("llf"))


def _boxcox_moments(keys: list[str], lams: list[float], block: int = 4096, held: int = 512):
    """Per group and lambda: count, mean and summed squares about it of the transformed values, and sum(ln y).
    At most ``held`` groups are kept at a time; what is returned early is put together later."""
    lam = np.array(lams)[:, None]
    some = np.where(lam == 0, 1.0, lam)

    def rows_of(found: dict, kind: pa.Schema) -> pa.RecordBatch:
        k = len(lams)
        columns = [pa.array([g[i] for g in found for _ in range(k)], kind.field(c).type) for i, c in enumerate(keys)]
        n, m, m2, sl = ([f[i] for f in found.values()] for i in range(4))
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.tile(np.array(lams), len(found))), pa.array(np.repeat(np.array(n, np.int64), k)),
             pa.array(np.concatenate(m)), pa.array(np.concatenate(m2)), pa.array(np.repeat(np.array(sl), k))],
            names=[*keys, "lmbda", "n", "m", "m2", "sl"])

    def add(found: dict, group: tuple, y: np.ndarray) -> None:
        ln = np.log(y)
        t = np.where(lam == 0, ln, (np.power(y, lam) - 1) / some)
        t0 = t[:, :1]
        m = (t0 + (t - t0).sum(1, keepdims=True) / len(y))
        m2, m, n, sl = ((t - m) ** 2).sum(1), m[:, 0], len(y), float(ln.sum())
        if group in found:
            n0, mean, square, s0 = found[group]
            d = m - mean
            m, m2, n, sl = mean + d * n / (n0 + n), square + m2 + d * d * (n0 * n / (n0 + n)), n0 + n, s0 + sl
        found[group] = n, m, m2, sl

    def run(batches):
        found: dict = {}
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            names = list(zip(*[batch.column(c).to_pylist() for c in keys])) if keys else [()] * len(y)
            number: dict = {}
            code = np.array([number.setdefault(g, len(number)) for g in names], np.int64)
            by = np.argsort(code, kind="stable")
            first = np.searchsorted(code[by], np.arange(len(number) + 1))
            for g, a, b in zip(number, first, first[1:]):
                for at in range(a, b, block):
                    add(found, g, y[by[at:min(b, at + block)]])
                if len(found) >= held:
                    yield rows_of(found, batch.schema)
                    found = {}
            schema = batch.schema
        if found:
            yield rows_of(found, schema)

    return run


def unpivot(df: DataFrame, ids: list[str], values: list[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    cast = [F.col(v).cast("double").alias(v) for v in values]
    return df.select(*ids, *cast).unpivot(ids, values, var, val)


def category_order(df: DataFrame, col: str, order_cols: list[str], name: str = "ord",
                   prefix: str | None = None) -> DataFrame:
    """Ordinal sort key of each category by its first position in a stated row order;
    numeric categories may be wrapped in ``prefix`` to make them labels."""
    from kestrel.operators.indexing import dense_index
    label = F.concat(F.lit(prefix), F.col(col).cast("string"), F.lit(prefix)) if prefix else F.col(col)
    firsts = df.select(label.alias("category"), *order_cols).groupBy("category") \
        .agg(F.min(F.struct(*order_cols)).alias("_first"))
    ordered = dense_index(firsts.select("category", *[F.col("_first." + c).alias(c) for c in order_cols]),
                          order_cols, name)
    return ordered.select("category", name)


# ---------------------------------------------------------------------------
# C4-C11 joins
# ---------------------------------------------------------------------------

def left_lookup(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a lookup table; Spark broadcasts it where its size in bytes is small at run time."""
    return df.join(lookup, on, "left")


def semi_mapped(df: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    return df.join(mapping, on, "left_semi")


def anti_unmapped(df: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    return df.join(mapping, on, "left_anti")


def interval_match(items: DataFrame, campaigns: DataFrame, item_key: str, camp_key: str, date_col: str,
                   start_col: str, end_col: str, most: int = 100_000) -> DataFrame:
    """Pairs of one product with ``start <= date <= end`` (both ends inclusive), by time slices.

    An interval of up to 2^k days is dealt to slices of 2^k / 8 days (nine at most, so copies of
    a campaign are bounded whatever its length), a date to the one slice of every width in use. The
    join key is (product, width, slice): a product that sells a lot spreads over its slices, meets
    only campaigns that touch the slice, and every pair is found in the slice of its date alone.
    Spark judges a side by its compressed files, which tell nothing of the copies: only campaigns
    counted to be few go to every task, others meet the items by a sort-merge join.
    """
    def day(c: str) -> Column:
        return F.datediff(F.col(c), F.lit("1970-01-01"))

    def slices(d: Column, level: Column) -> Column:
        return F.floor(d / F.pow(F.lit(2.0), F.greatest(level - 3, F.lit(0)))).cast("int")

    c = campaigns.withColumnRenamed(camp_key, "_ck").where(F.col(start_col) <= F.col(end_col)) \
        .withColumn("_level", F.ceil(F.log2(day(end_col) - day(start_col) + 1.0)).cast("int"))
    counts = c.groupBy("_level").count().collect()  # powers of two of the interval lengths: a few
    levels = [r["_level"] for r in counts]
    few = 9 * sum(r["count"] for r in counts) <= most
    c = c.withColumn("_slice", F.explode(F.sequence(slices(day(start_col), F.col("_level")), slices(day(end_col), F.col("_level")))))
    every = F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")
    i = items.withColumn("_level", F.explode(every)).withColumn("_slice", slices(day(date_col), F.col("_level")))
    c = c.withColumnsRenamed({"_level": "_cl", "_slice": "_cs"}).hint("broadcast" if few else "merge")
    j = i.join(c, (i[item_key] == c["_ck"]) & (i["_level"] == c["_cl"]) & (i["_slice"] == c["_cs"]) &
               (i[date_col] >= c[start_col]) & (i[date_col] <= c[end_col]), "inner")
    return j.drop("_ck", "_cl", "_cs", "_level", "_slice")


def min_orders_semi(df: DataFrame, key: str, min_orders: int, order_col: str) -> DataFrame:
    """Keep rows of keys having at least ``min_orders`` distinct orders (semi-join reduction)."""
    keys = df.groupBy(key).agg(F.countDistinct(order_col).alias("_n")).where(F.col("_n") >= min_orders).select(key)
    return df.join(keys, key, "left_semi")


def conversion(txns: DataFrame, items: DataFrame, window_days: int = 120) -> DataFrame:
    """Earliest later order of the same customer, within ``window_days`` after the
    transaction date (exclusive start, inclusive end), that buys a watched product.

    ``txns``: transaction_id, customer_id, order_date, watched (array of products).
    ``items``: transaction_id, customer_id, order_date, product_id.

    No pair join: watch events and purchases of each (customer, product) are unioned
    and scanned newest-first with the skew-proof prefix kernel; the running minimum
    of (purchase date, transaction) over strictly later purchases is the next purchase
    after each watch. A customer-product with many rows is split across partitions
    like any other hot key. The winner per transaction is the minimum over its
    watched products (ties on the date go to the smaller transaction id).
    """
    from kestrel.operators.prefix import prefix_agg
    day = F.datediff(F.col("order_date"), F.lit("1970-01-01")).cast("long")
    w = txns.select("transaction_id", "customer_id", "order_date", F.explode("watched").alias("product_id")) \
        .select("customer_id", "product_id", day.alias("_d"), F.lit(1).alias("_kind"),
                F.col("transaction_id").alias("_txn"))
    # newest-first scan with watches (kind 1) ahead of purchases (kind 0) of the same day,
    # so a watch only sees strictly later purchases
    p = items.select("customer_id", "product_id", day.alias("_d"), F.lit(0).alias("_kind"),
                     F.col("transaction_id").alias("_txn"))
    purchase = F.when(F.col("_kind") == 0, F.struct(F.col("_d").alias("d"), F.col("_txn").alias("t")))
    ev = w.unionByName(p).withColumn("_code", purchase)
    nxt = prefix_agg(ev, ["customer_id", "product_id"], ["_d", "_kind", "_txn"], [("_next", "_code", "min")],
                     exclusive=True, descending=True)
    hits = nxt.where((F.col("_kind") == 1) & F.col("_next").isNotNull()) \
        .where((F.col("_next.d") > F.col("_d")) & (F.col("_next.d") <= F.col("_d") + window_days))
    best = hits.groupBy(F.col("_txn").alias("transaction_id")).agg(F.min("_next").alias("_b"))
    return best.select("transaction_id",
                       F.date_add(F.lit("1970-01-01").cast("date"), F.col("_b.d").cast("int")).alias("converted_date"),
                       F.col("_b.t").alias("converted_txn_id"))


def forecast_align(forecast: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Right join: every observed point, with the forecast where there is one."""
    return forecast.join(observed, on, "right")


# ---------------------------------------------------------------------------
# G1-G4 set operations
# ---------------------------------------------------------------------------

def union_samples(frames: dict[str, DataFrame], name: str = "sample") -> DataFrame:
    out = None
    for label, f in frames.items():
        f = f.withColumn(name, F.lit(label))
        out = f if out is None else out.unionByName(f)
    return out


def except_strings(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).distinct().join(b.select(col), col, "left_anti")


def intersect_strings(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).intersect(b.select(col))


def dedup_subset(df: DataFrame, subset: list[str], order_cols: list[str], ascending: bool = True) -> DataFrame:
    """One row per ``subset`` key: the first row in ``order_cols`` order (last when
    ``ascending`` is false). An aggregate with map-side combine, so a hot key is
    reduced before the shuffle instead of being sorted in one task."""
    rest = [c for c in df.columns if c not in subset]
    pick = (F.min_by if ascending else F.max_by)(F.struct(*rest), F.struct(*order_cols))
    return df.groupBy(*subset).agg(pick.alias("_r")).select(*subset, *[F.col("_r." + c).alias(c) for c in rest])
