"""Scorecard analytics: binning, train/test tables, WOE, PSI, Somers' D, splits, scaling.

Every statistic is computed in one aggregation over a long frame keyed by
(sample, predictor, value) instead of one pass per predictor or per sample; the
only values that reach the driver are bin edges and means (one row per
predictor).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.prefix import prefix_agg
from kestrel.operators.relational import unpivot
from kestrel.operators.selection import values_at_ranks
from kestrel.session import cut_lineage, small_side


def _pct(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")) * 100, digits)


# ---------------------------------------------------------------------------
# H1, H2: quantile bins and reference-edge histogram
# ---------------------------------------------------------------------------

def quantile_edges(df: DataFrame, col: str, bins: int = 10, group_cols: list[str] | None = None,
                   accuracy: int | None = None) -> DataFrame:
    """Distinct quantile edges at 0, 1/bins, ..., 1 (exact, linear interpolation).

    ``accuracy`` switches to ``percentile_approx`` for inputs whose distinct-value map
    would not fit an executor.
    """
    g = group_cols or []
    probs = [i / bins for i in range(bins + 1)]
    x = F.col(col).cast("double")
    if accuracy:
        q = F.percentile_approx(x, probs, accuracy)
        return df.where(x.isNotNull()).groupBy(*g).agg(F.array_distinct(q).alias("_edges"))
    return exact_quantiles(df, col, probs, g).select(*g, F.array_distinct("_q").alias("_edges"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group_cols: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, by digit selection of the two values around
    each: q = v[lo] + (v[hi] - v[lo]) * (h - lo), h = p (n - 1)."""
    g = group_cols or []

    def wanted(n: Column) -> Column:
        h = [F.lit(float(p)) * (n - 1) for p in probs]
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), x.alias("h"), pos(x).cast("long").alias("rank"))
                         for i, x in enumerate(h) for side, pos in (("lo", F.floor), ("hi", F.ceil))])

    hits = values_at_ranks(df.select(*g, F.col(col).cast("double").alias("_x")), "_x", g, wanted)
    per = hits.groupBy(*g, "i").agg(F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("vlo"),
                                    F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("vhi"),
                                    F.first("h").alias("h"))
    val = F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("h") - F.floor("h"))
    return per.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("i", val.alias("q")))).alias("_s")) \
        .select(*g, F.transform("_s", lambda e: e["q"]).alias("_q"))


def bin_of(x: Column, edges: Column, max_edges: int | None = None) -> Column:
    """Right-closed bin index; the minimum falls in bin 0; null outside the edges.
    With ``max_edges`` known the count of edges below x is a plain sum of comparisons
    (code-generated) instead of a lambda over the array."""
    if max_edges:
        below = [F.when(F.try_element_at(edges, F.lit(i)) < x, 1).otherwise(0) for i in range(1, max_edges + 1)]
        k = sum(below[1:], below[0]) - 1
    else:
        k = F.size(F.filter(edges, lambda e: e < x)) - 1
    return F.when(x.isNull() | (x < F.element_at(edges, 1)) | (x > F.element_at(edges, -1)), F.lit(None)) \
        .otherwise(F.greatest(k, F.lit(0)))


def _fmt(v: Column) -> Column:
    return v.cast("string")


def quantile_bins(df: DataFrame, col: str, bins: int = 10, rounding: int = 2,
                  group_cols: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Add ``{col}_bin``, ``{col}_bin_low``, ``{col}_bin_upp``, ``{col}_bin_rng``.

    Edges come from ``quantile_edges`` per group (tiny: one array per group) and are
    joined back; the lowest edge is the minimum itself.
    """
    g = group_cols or []
    e = edges if edges is not None else quantile_edges(df, col, bins, g)
    j = df.join(small_side(e), g, "left") if g else df.withColumn("_edges", e.select("_edges").scalar())
    x = F.col(col).cast("double")
    b = bin_of(x, F.col("_edges"), bins + 1)
    low = F.round(F.element_at(F.col("_edges"), b + 1), rounding)
    upp = F.round(F.element_at(F.col("_edges"), b + 2), rounding)
    return j.withColumn(f"{col}_bin", b.cast("int")) \
        .withColumn(f"{col}_bin_low", low).withColumn(f"{col}_bin_upp", upp) \
        .withColumn(f"{col}_bin_rng", F.concat(F.lit("("), _fmt(low), F.lit(", "), _fmt(upp), F.lit(")"))) \
        .drop("_edges")


def histogram_edges(df: DataFrame, col: str, edges: Column, group_cols: list[str] | None = None) -> DataFrame:
    """Counts per left-closed bin [e_k, e_k+1) of given edges, last bin closed; values
    outside the edges are dropped."""
    g = group_cols or []
    df = df.withColumn("_he", edges)
    edges = F.col("_he")
    x = F.col(col).cast("double")
    k = F.size(F.filter(edges, lambda e: e <= x)) - 1
    last = F.size(edges) - 2
    b = F.when((x < F.element_at(edges, 1)) | (x > F.element_at(edges, -1)) | x.isNull(), F.lit(None)) \
        .otherwise(F.least(k, last))
    return df.select(*g, b.cast("int").alias("bin")).where(F.col("bin").isNotNull()) \
        .groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------------------
# H3, H4: train / test statistics and univariate analysis
# ---------------------------------------------------------------------------

def train_test_stats(df: DataFrame, sample_col: str, group: str, response: str,
                     train: str = "train", test: str = "test", event: str = "event",
                     valid: str | None = None, order_by: str | None = None) -> DataFrame:
    """Observations, events and event rates of train, test and total (all rows) per
    group, plus a Total row whose percentages are recomputed from the summed counts.
    One rollup aggregation; groups missing from a sample count 0. With ``valid`` the same
    columns for a third sample; with ``order_by`` the groups' smallest value of that column
    as ``group_order`` and rows in its order, the Total last."""
    s, r = F.col(sample_col), F.col(response).cast("long")
    agg = df.rollup(group).agg(
        F.sum(F.when(s == train, 1).otherwise(0)).alias("train_obs"),
        F.sum(F.when(s == test, 1).otherwise(0)).alias("test_obs"),
        F.count(F.lit(1)).alias("total_obs"),
        F.sum(F.when(s == train, r).otherwise(0)).alias(f"train_{event}"),
        F.sum(F.when(s == test, r).otherwise(0)).alias(f"test_{event}"),
        F.sum(r).alias(f"total_{event}"),
        F.grouping(group).alias("_g"),
        *([F.sum(F.when(s == valid, 1).otherwise(0)).alias("valid_obs"),
           F.sum(F.when(s == valid, r).otherwise(0)).alias(f"valid_{event}")] if valid else []),
        *([F.min(order_by).alias("_o")] if order_by else []))
    out = agg.withColumn(group, F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(group).cast("string")))
    te, se, oe = F.col(f"train_{event}"), F.col(f"test_{event}"), F.col(f"total_{event}")
    more = []
    if valid:
        more += ["valid_obs", f"valid_{event}",
                 F.coalesce(_pct(F.col(f"valid_{event}"), F.col("valid_obs")), F.lit(0.0)).alias("er_valid_pct")]
    if order_by:
        out = out.orderBy("_g", F.col("_o").asc_nulls_last(), group)
        more.append(F.when(F.col("_g") == 0, F.col("_o")).alias("group_order"))
    return out.select(
        group, "train_obs", "test_obs", "total_obs",
        F.coalesce(_pct(F.col("train_obs"), F.col("total_obs")), F.lit(0.0)).alias("train_obs_pct"),
        f"train_{event}", f"test_{event}", f"total_{event}",
        F.coalesce(_pct(te, oe), F.lit(0.0)).alias(f"train_{event}_pct"),
        F.coalesce(_pct(te, F.col("train_obs")), F.lit(0.0)).alias("er_train_pct"),
        F.coalesce(_pct(se, F.col("test_obs")), F.lit(0.0)).alias("er_test_pct"),
        F.coalesce(_pct(oe, F.col("total_obs")), F.lit(0.0)).alias("er_total_pct"), *more)


def univariate_continuous(df: DataFrame, sample_col: str, col: str, response: str, bins: int = 10,
                          rounding: int = 2) -> DataFrame:
    """Quantile bins computed within each sample, then the train/test table per bin id
    with each sample's bin range text."""
    binned = quantile_bins(df, col, bins, rounding, [sample_col])
    stats = train_test_stats(binned, sample_col, f"{col}_bin", response)
    rngs = binned.groupBy(F.col(f"{col}_bin").cast("string").alias(f"{col}_bin")).agg(
        F.max(F.when(F.col(sample_col) == "train", F.col(f"{col}_bin_rng"))).alias("train_rng"),
        F.max(F.when(F.col(sample_col) == "test", F.col(f"{col}_bin_rng"))).alias("test_rng"))
    return stats.join(rngs, f"{col}_bin", "left")


def univariate_categorical(df: DataFrame, sample_col: str, col: str, response: str,
                           min_obs: int = 0) -> DataFrame:
    """Train/test table per category, categories with fewer than ``min_obs`` rows dropped."""
    stats = train_test_stats(df, sample_col, col, response)
    return stats.where((F.col(col) == "Total") | (F.col("total_obs") >= min_obs))


# ---------------------------------------------------------------------------
# H5: weight of evidence
# ---------------------------------------------------------------------------

def woe(df: DataFrame, predictor: str, response: str) -> DataFrame:
    """WOE per category (events floored at 0.5, shares rounded to 2 places, woe of the
    rounded shares rounded to 4) and a Total row with woe 0."""
    r = F.col(response).cast("long")
    g = df.groupBy(F.col(predictor).cast("string").alias(predictor)).agg(
        F.count(F.lit(1)).alias("count"), F.sum(r).alias("events"))
    g = g.withColumn("non_events", F.col("count") - F.col("events"))
    tot_e, tot_n = g.select(F.sum("events")).scalar(), g.select(F.sum("non_events")).scalar()
    g = g.withColumn("events_pct", F.round(F.greatest(F.col("events").cast("double"), F.lit(0.5)) / tot_e * 100, 2)) \
        .withColumn("non_events_pct", F.round(F.greatest(F.col("non_events").cast("double"), F.lit(0.5)) / tot_n * 100, 2)) \
        .withColumn("event_rate_pct", _pct(F.col("events"), F.col("count"))) \
        .withColumn("woe", F.round(F.log(F.col("non_events_pct") / F.col("events_pct")), 4))
    total = g.agg(F.lit("Total").alias(predictor), F.sum("count").alias("count"), F.sum("events").alias("events"),
                  F.sum("non_events").alias("non_events"), F.sum("events_pct").alias("events_pct"),
                  F.sum("non_events_pct").alias("non_events_pct")) \
        .withColumn("event_rate_pct", _pct(F.col("events"), F.col("count"))).withColumn("woe", F.lit(0.0))
    return g.unionByName(total)


def woe_table(df: DataFrame, predictors: list[str], response: str) -> DataFrame:
    """(predictor, value, woe) for many predictors from one aggregation."""
    long = df.select(F.col(response).cast("long").alias("_r"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.col(p).cast("string").alias("value")) for p in predictors]))
        .alias("kv")).select("_r", "kv.*")
    g = long.groupBy("predictor", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("e"))
    w = Window.partitionBy("predictor")
    ne = F.col("n") - F.col("e")
    ep = F.round(F.greatest(F.col("e").cast("double"), F.lit(0.5)) / F.sum("e").over(w) * 100, 2)
    nep = F.round(F.greatest(ne.cast("double"), F.lit(0.5)) / F.sum(ne).over(w) * 100, 2)
    return g.select("predictor", "value", F.round(F.log(nep / ep), 4).alias("woe"))


def woe_apply(df: DataFrame, table: DataFrame, predictors: list[str]) -> DataFrame:
    """Add ``{p}_woe`` for every predictor: one left join per predictor with its slice of
    the WOE table (one row a category; Spark broadcasts it where it is small at run time).
    Unknown categories get null."""
    out = df
    for p in predictors:
        sl = table.where(F.col("predictor") == p).select(F.col("value").alias(f"_v_{p}"), F.col("woe").alias(f"{p}_woe"))
        out = out.join(sl, F.col(p).cast("string") == F.col(f"_v_{p}"), "left") \
            .drop(f"_v_{p}")
    return out


# ---------------------------------------------------------------------------
# H6, H7: population stability
# ---------------------------------------------------------------------------

def _psi_from_counts(counts: DataFrame, key: str) -> DataFrame:
    """counts: key, count_sample_1, count_sample_2 (0 when absent) -> shares, psi, total row."""
    c1, c2 = F.col("count_sample_1"), F.col("count_sample_2")
    p1 = F.when(c1 > 0, c1 / counts.select(F.sum("count_sample_1")).scalar())
    p2 = F.when(c2 > 0, c2 / counts.select(F.sum("count_sample_2")).scalar())
    out = counts.select(key, c1, c2, p1.alias("percent_sample_1"), p2.alias("percent_sample_2"))
    out = out.withColumn("psi", (F.col("percent_sample_1") - F.col("percent_sample_2")) *
                         F.log(F.col("percent_sample_1") / F.col("percent_sample_2")))
    total = out.agg(F.lit("total").alias(key), F.sum(c1).alias("count_sample_1"),
                    F.sum(c2).alias("count_sample_2"),
                    F.sum("percent_sample_1").alias("percent_sample_1"),
                    F.sum("percent_sample_2").alias("percent_sample_2"), F.sum("psi").alias("psi"))
    return out.unionByName(total).fillna(0, ["percent_sample_1", "percent_sample_2", "psi"])


def psi_categorical(sample_1: DataFrame, sample_2: DataFrame, variable: str) -> DataFrame:
    """PSI = sum (p1 - p2) ln(p1 / p2) over categories; a category missing from one sample
    contributes nothing (its term is null, shown as 0)."""
    a = sample_1.where(F.col(variable).isNotNull()).groupBy(F.col(variable).cast("string").alias(variable)) \
        .agg(F.count(F.lit(1)).alias("count_sample_1"))
    b = sample_2.where(F.col(variable).isNotNull()).groupBy(F.col(variable).cast("string").alias(variable)) \
        .agg(F.count(F.lit(1)).alias("count_sample_2"))
    j = a.join(b, variable, "full").fillna(0, ["count_sample_1", "count_sample_2"])
    return _psi_from_counts(j, variable)


def psi_continuous(sample_1: DataFrame, sample_2: DataFrame, variable: str, bins: int = 10,
                   bins_definition: str = "jointly", rounding: int = 2) -> DataFrame:
    """PSI over quantile bins: edges from the union of both samples (``jointly``), or
    from sample 1 with sample 2 counted by a left-closed histogram on sample 1's
    rounded edges (``reference``)."""
    key = f"{variable}_bin_rng"
    if bins_definition == "jointly":
        u = sample_1.select(variable, F.lit(1).alias("_s")).unionByName(sample_2.select(variable, F.lit(2).alias("_s")))
        b = quantile_bins(u.where(F.col(variable).isNotNull()), variable, bins, rounding)
        counts = b.groupBy(key).agg(F.sum(F.when(F.col("_s") == 1, 1).otherwise(0)).alias("count_sample_1"),
                                    F.sum(F.when(F.col("_s") == 2, 1).otherwise(0)).alias("count_sample_2"))
        return _psi_from_counts(counts, key)
    e = quantile_edges(sample_1, variable, bins)
    b1 = quantile_bins(sample_1.where(F.col(variable).isNotNull()), variable, bins, rounding, edges=e)
    c1 = b1.groupBy(F.col(f"{variable}_bin").alias("bin"), key).agg(F.count(F.lit(1)).alias("count_sample_1"))
    redges = e.select(F.transform("_edges", lambda x: F.round(x, rounding)).alias("r")).scalar()
    c2 = histogram_edges(sample_2, variable, redges).withColumnRenamed("count", "count_sample_2")
    j = c1.join(c2, "bin", "full").fillna(0, ["count_sample_1", "count_sample_2"])
    return _psi_from_counts(j.select(key, "count_sample_1", "count_sample_2"), key)


# ---------------------------------------------------------------------------
# H8, I4: exact AUC (mid-rank) and Somers' D
# ---------------------------------------------------------------------------

def auc_long(df: DataFrame, group_cols: list[str], score: str, label: str) -> DataFrame:
    """Exact AUC per group with ties counted one half.

    Rows are reduced to distinct (group, score) with positive / negative counts; a
    skew-proof prefix sum gives the negatives below each score;
    AUC = sum pos * (neg_below + neg / 2) / (P * N).
    """
    y = F.col(label).cast("long")
    d = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*group_cols, F.col(score).cast("double").alias("_s")) \
        .agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    pre = prefix_agg(d, group_cols, ["_s"], [("_below", "_neg", "sum")], exclusive=True)
    agg = pre.groupBy(*group_cols).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(*group_cols, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("auc"))


def somers_d(df: DataFrame, sample_col: str, predictors: list[str], response: str,
             samples: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """round(2 AUC - 1, 4) * 100 per predictor for each sample and the total, one pass.
    Sorted by |train| descending by the caller (``orderBy``)."""
    long = unpivot(df, [sample_col, response], predictors, "predictor", "value")
    both = long.unionByName(long.withColumn(sample_col, F.lit("total")))
    a = auc_long(both, ["predictor", sample_col], "value", response)
    sd = a.withColumn("sd", F.round(2 * F.col("auc") - 1, 4) * 100)
    return sd.groupBy("predictor").pivot(sample_col, list(samples) + ["total"]).agg(F.first("sd"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, long form, from one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return agg.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(
        F.split("pair", r"\|")[0].alias("var_1"), F.split("pair", r"\|")[1].alias("var_2"), "corr")


# ---------------------------------------------------------------------------
# Splits, imputation, standardisation
# ---------------------------------------------------------------------------

def seeded_digest(seed: int, *ids: str) -> Column:
    """Hex digest of (seed, ids): an order that every engine and every run agrees on."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]).cast("binary"))


def seeded_share(seed: int, *ids: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(seeded_digest(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def stratified_split(df: DataFrame, strata: list[str], id_col: str, sizes: dict[str, float],
                     seed: int = 42, name: str = "sample") -> DataFrame:
    """Exact, reproducible stratified split: rows ordered within each stratum by a seeded
    digest of the id; a row's position share picks its part by cumulative ``sizes``.

    Rows are counted by the first digits of the digest; only those whose digits a cut falls into are ordered, the
    others lie on one side of every cut and are neither shuffled nor written."""
    cuts, cum = [], 0.0
    for label, size in list(sizes.items())[:-1]:
        cum += size
        cuts.append((label, cum))
    last, names = list(sizes)[-1], [*strata, *[c for c in df.columns if c not in strata]]

    def named(parts: Column) -> list:
        own = [parts.alias(name) if c == name else F.col(c) for c in names]
        return own if name in names else [*own, parts.alias(name)]

    def part(pos: Column, n: Column) -> Column:
        out = F.lit(last)
        for label, c in reversed(cuts):
            out = F.when((pos - 0.5) / n < c, label).otherwise(out)
        return out

    keyed = df.withColumn("_h", seeded_digest(seed, id_col)).withColumn("_bin", F.substring("_h", 1, 4))
    inside = Window.partitionBy(*strata)
    before = inside.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    for c in strata:
        bins = bins.where(F.col(c).isNotNull())
    bins = bins.withColumn("_n", F.sum("_c").over(inside)).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    bins = cut_lineage(bins.select(*strata, "_bin", "_n", "_before", part(F.col("_before") + 1, F.col("_n")).alias("_first"),
                                   part(F.col("_before") + F.col("_c"), F.col("_n")).alias("_last")))
    split = small_side(bins.where("_first != _last").select(*strata, "_bin", "_n", "_before"))
    ends = small_side(bins.where("_first = _last").groupBy(*strata).agg(*[
        F.max(F.when(F.col("_first") == label, F.col("_bin"))).alias(f"_end{k}") for k, (label, _) in enumerate(cuts)]))
    whole = F.lit(last)
    for k, (label, _) in reversed(list(enumerate(cuts))):
        whole = F.when(F.col("_bin") <= F.col(f"_end{k}"), label).otherwise(whole)
    clear = keyed.join(split.select(*strata, "_bin"), [*strata, "_bin"], "left_anti").join(ends, strata).select(*named(whole))
    near = prefix_agg(keyed.join(split, [*strata, "_bin"]), [*strata, "_bin"], ["_h", id_col], [("_pos", "*", "count")])
    return clear.unionByName(near.select(*named(part(F.col("_before") + F.col("_pos"), F.col("_n")))))


def user_split(df: DataFrame, user: str, n_valid: int, seed: int = 42, frac: float = 0.5) -> DataFrame:
    """Half of the users (by seeded digest) are held out; of those, the first ``n_valid`` in
    digest order go to ``valid`` and the rest to ``test``; the others are ``train``."""
    users = df.select(user).distinct().withColumn("_h", seeded_digest(seed, user))
    held = users.where(seeded_share(seed, user) < frac)
    ranked = prefix_agg(held.withColumn("_k", F.lit(0)), ["_k"], ["_h", user], [("_r", "*", "count")])
    lab = ranked.select(user, F.when(F.col("_r") <= n_valid, "valid").otherwise("test").alias("split"))
    return df.join(lab, user, "left").fillna("train", ["split"])


def random_split(df: DataFrame, weights: list[float], ids: list[str], seed: int = 42) -> list[DataFrame]:
    """Parts by a seeded digest of the ids, in shares of ``weights``: the same rows in every run."""
    total, low, out = sum(weights), 0.0, []
    share = seeded_share(seed, *ids)
    for k, w in enumerate(weights):
        high = low + w / total
        out.append(df.where((share >= low) & (share < high)) if k + 1 < len(weights) else df.where(share >= low))
        low = high
    return out


def impute_train_mean(df: DataFrame, cols: list[str], sample_col: str, train: str = "train") -> DataFrame:
    """Fill nulls of every sample with the train means (one small aggregate)."""
    means = df.where(F.col(sample_col) == train).agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.fillna({c: float(means[c]) for c in cols if means[c] is not None})


def standardize(df: DataFrame, cols: list[str], sample_col: str, train: str = "train") -> DataFrame:
    """(x - train mean) / train standard deviation (ddof 1), for every sample."""
    stats = df.where(F.col(sample_col) == train).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return df.select(*[c for c in df.columns if c not in cols],
                     *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# Monotone fold and cost features
# ---------------------------------------------------------------------------

def monotone_fold(df: DataFrame, col: str, response: str, bins: int = 10, spike: str | None = "up",
                  centre: float | None = None, name: str | None = None) -> DataFrame:
    """abs(x - c): c given, or the mid-point of the quantile bin with the highest
    (``spike='up'``) or lowest event rate on the whole frame."""
    out = name or f"{col}_fold"
    if centre is None:
        b = quantile_bins(df, col, bins, 10)
        rates = b.groupBy(f"{col}_bin").agg(F.avg(F.col(response).cast("double")).alias("_er"),
                                            F.first(F.col(f"{col}_bin_low")).alias("_lo"),
                                            F.first(F.col(f"{col}_bin_upp")).alias("_hi"))
        pick = F.max_by if spike == "up" else F.min_by
        c = rates.select(pick((F.col("_lo") + F.col("_hi")) / 2, F.struct("_er", (-F.col(f"{col}_bin")).alias("b")))
                         .alias("c")).scalar()
    else:
        c = F.lit(centre)
    return df.withColumn(out, F.abs(F.col(col) - c))


def cost_features(df: DataFrame, woe_cols: dict[str, str], abs_cols: list[str], flag_cols: list[str],
                  square_cols: list[str]) -> DataFrame:
    """Feature map of the cost model: WOE recodes already joined, absolute values,
    positive flags, squares; nulls become 0."""
    out = df
    for src, dst in woe_cols.items():
        out = out.withColumn(dst, F.coalesce(F.col(src), F.lit(0.0)))
    for c in abs_cols:
        out = out.withColumn(f"{c}_abs", F.coalesce(F.abs(c), F.lit(0.0)))
    for c in flag_cols:
        out = out.withColumn(f"{c}_flag", F.when(F.col(c) > 0, 1).otherwise(0))
    for c in square_cols:
        out = out.withColumn(f"{c}_sq", F.coalesce(F.pow(F.col(c), 2), F.lit(0.0)))
    return out
