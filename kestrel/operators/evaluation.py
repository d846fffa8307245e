"""Model evaluation and cut-off economics (section I).

A prediction is positive when the probability is strictly above the threshold.
Threshold sweeps are one aggregation with one conditional sum per threshold (no
loop of jobs, no join); AUC uses the exact mid-rank kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.prefix import prefix_agg
from kestrel.operators.scorecard import auc_long


def confusion(df: DataFrame, actual: str, prob: str, threshold: float, group_cols: list[str] | None = None) -> DataFrame:
    g = group_cols or []
    pred = F.when(F.col(prob) > threshold, 1).otherwise(0)
    return df.groupBy(*g, F.col(actual).cast("int").alias("actual"), pred.alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, actual: str, prob: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages, accuracy."""
    a = F.col(actual).cast("int")
    p = F.when(F.col(prob) > threshold, 1).otherwise(0)
    c = df.agg(F.sum(F.when((a == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
               F.sum(F.when((a == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
               F.sum(F.when((a == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
               F.sum(F.when((a == 1) & (p == 0), 1).otherwise(0)).alias("fn"))

    def row(label: str, tp: str, fp: str, fn: str, sup: Column) -> Column:
        prec = F.coalesce(F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fp)), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fn)), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1_score"), sup.cast("long").alias("support"))

    r1 = row("1", "tp", "fp", "fn", F.col("tp") + F.col("fn"))
    r0 = row("0", "tn", "fn", "fp", F.col("tn") + F.col("fp"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    base = c.select(r0.alias("r0"), r1.alias("r1"), n.alias("n"),
                    ((F.col("tp") + F.col("tn")) / n).alias("acc"))
    macro = F.struct(F.lit("macro avg").alias("label"),
                     *[((F.col(f"r0.{k}") + F.col(f"r1.{k}")) / 2).alias(k) for k in ("precision", "recall", "f1_score")],
                     F.col("n").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("label"),
                        *[((F.col(f"r0.{k}") * F.col("r0.support") + F.col(f"r1.{k}") * F.col("r1.support")) / F.col("n"))
                          .alias(k) for k in ("precision", "recall", "f1_score")], F.col("n").alias("support"))
    acc = F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                   F.col("n").alias("support"))
    return base.select(F.explode(F.array("r0", "r1", macro, weighted, acc)).alias("r")).select("r.*")


def roc_curve(df: DataFrame, actual: str, prob: str, group_cols: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, cumulative from the highest score
    (every point kept, none dropped as collinear)."""
    g = group_cols or []
    y = F.col(actual).cast("long")
    d = df.groupBy(*g, F.col(prob).cast("double").alias("threshold")).agg(
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    cum = prefix_agg(d, g, ["threshold"], [("_tp", "_p", "sum"), ("_fp", "_n", "sum")], descending=True)
    tot = d.groupBy(*g).agg(F.sum("_p").alias("_P"), F.sum("_n").alias("_N")) if g else None
    if g:
        cum = cum.join(tot, g)
        P, N = F.col("_P"), F.col("_N")
    else:
        P, N = d.select(F.sum("_p")).scalar(), d.select(F.sum("_n")).scalar()
    return cum.select(*g, "threshold", F.try_divide(F.col("_fp").cast("double"), N).alias("fpr"),
                      F.try_divide(F.col("_tp").cast("double"), P).alias("tpr"))


def auroc(df: DataFrame, actual: str, prob: str, group_cols: list[str] | None = None) -> DataFrame:
    a = auc_long(df, group_cols or [], prob, actual)
    return a.withColumn("auroc", F.round("auc", 4)).withColumn("somers_d", F.round(2 * F.col("auroc") - 1, 4)).drop("auc")


def score_rollup(df: DataFrame, bid: str, prob: str, response: str, lost: str, saved: str,
                 saved_agg=F.sum, others: list[str] | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """Row scores to the bid level: sum of probability, max response / lost margin /
    others, ``saved_agg`` of the saved cost."""
    g = group_cols or []
    return df.groupBy(*g, bid).agg(F.max(lost).alias(lost), saved_agg(saved).alias(saved),
                                   F.sum(prob).alias(prob), F.max(response).alias(response),
                                   *[F.max(c).alias(c) for c in (others or [])])


def _perf_aggs(prob: str, response: str, saved: str, lost: str, t: float, suffix: str = "") -> list[Column]:
    p = F.col(prob) > t
    r = F.col(response).cast("int") == 1
    return [F.sum(F.when(p & r, 1).otherwise(0)).alias(f"tp{suffix}"),
            F.sum(F.when(p & ~r, 1).otherwise(0)).alias(f"fp{suffix}"),
            F.sum(F.when(~p & ~r, 1).otherwise(0)).alias(f"tn{suffix}"),
            F.sum(F.when(~p & r, 1).otherwise(0)).alias(f"fn{suffix}"),
            F.sum(F.when(p & r, F.col(saved)).otherwise(0.0)).alias(f"saved_cost{suffix}"),
            F.sum(F.when(p & ~r, F.col(lost)).otherwise(0.0)).alias(f"lost_margin{suffix}")]


def model_performance(scored: DataFrame, sample_col: str, prob: str, response: str, saved: str, lost: str,
                      threshold: float, samples: tuple[str, str] = ("TRAIN", "TEST")) -> DataFrame:
    """Performance rows at a threshold for each sample and TOTAL (TOTAL auroc = mean)."""
    agg = scored.groupBy(sample_col).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col(response).cast("long")).alias("events"),
        F.sum(saved).alias("total_cost"), *_perf_aggs(prob, response, saved, lost, threshold))
    au = auroc(scored, response, prob, [sample_col])
    rows = agg.join(au, sample_col, "left")
    num = ["count", "events", "total_cost", "tp", "fp", "tn", "fn", "saved_cost", "lost_margin"]
    total = rows.agg(*[F.sum(c).alias(c) for c in num], F.avg("auroc").alias("auroc")) \
        .withColumn(sample_col, F.lit("TOTAL")).withColumn("somers_d", F.round(2 * F.col("auroc") - 1, 4))
    allr = rows.unionByName(total.select(rows.columns))
    return allr.select(
        F.lit(threshold).alias("threshold"), sample_col, "count", "events",
        F.round(F.col("events") * 100.0 / F.col("count"), 2).alias("event_rate"),
        F.round("total_cost", 2).alias("total_cost"), "tp", "fp", "tn", "fn",
        F.round(F.col("fp") / (F.col("tp") + 1), 2).alias("fp_tp"), "auroc", "somers_d",
        F.round("saved_cost", 2).alias("saved_cost"), F.round("lost_margin", 2).alias("lost_margin"),
        F.round(F.col("saved_cost") - F.col("lost_margin"), 2).alias("net_savings"))


def threshold_sweep(scored: DataFrame, sample_col: str, prob: str, response: str, saved: str, lost: str,
                    thresholds: list[float]) -> DataFrame:
    """Confusion counts and economics for every threshold from ONE aggregation pass
    (one conditional sum per threshold and measure), then unpivoted; TOTAL = all samples."""
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += _perf_aggs(prob, response, saved, lost, t, f"_{i}")
    per = scored.rollup(sample_col).agg(*aggs, F.grouping(sample_col).alias("_g"))
    per = per.withColumn(sample_col, F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(sample_col)))
    entries = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                                 *[F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "tn", "fn", "saved_cost",
                                                                       "lost_margin")])
                        for i, t in enumerate(thresholds)])
    long = per.select(sample_col, F.explode(entries).alias("e")).select(sample_col, "e.*")
    return long.withColumn("saved_cost", F.round("saved_cost", 2)).withColumn("lost_margin", F.round("lost_margin", 2)) \
        .withColumn("net_savings", F.round(F.col("saved_cost") - F.col("lost_margin"), 2))


def threshold_shortlist(sweep: DataFrame, sample_col: str, min_savings: float) -> DataFrame:
    """Thresholds whose TOTAL net savings exceed ``min_savings`` (all their rows)."""
    ok = sweep.where((F.col(sample_col) == "TOTAL") & (F.col("net_savings") > min_savings)).select("threshold")
    return sweep.join(ok, "threshold", "left_semi")


def cost_evaluation(df: DataFrame, group: str, actual: str, estimated: str, ceiling: float | None = None) -> DataFrame:
    """Estimated vs actual per group and in total: counts, sums, means, diff in %."""
    est = F.least(F.col(estimated), F.lit(ceiling)) if ceiling is not None else F.col(estimated)
    agg = df.rollup(group).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.when(F.col(actual) > 0, 1).otherwise(0)).alias("count_actual"),
        F.sum(F.when(est > 0, 1).otherwise(0)).alias("count_estimated"),
        F.sum(actual).alias("sum_actual"), F.sum(est).alias("sum_estimated"),
        F.grouping(group).alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(group).cast("string")).alias(group),
        "count", "count_actual", "count_estimated", F.round("sum_actual", 2).alias("sum_actual"),
        F.round("sum_estimated", 2).alias("sum_estimated"),
        F.round(F.col("sum_actual") / F.col("count") * 100, 2).alias("mean_actual_pct"),
        F.round(F.col("sum_estimated") / F.col("count") * 100, 2).alias("mean_estimated_pct"),
        F.round(F.try_divide(F.col("sum_estimated") - F.col("sum_actual"), F.col("sum_actual")) * 100, 2)
        .alias("diff_pct"))


def regression_metrics(df: DataFrame, actual: str, pred: str, group_cols: list[str] | None = None) -> DataFrame:
    """Sum of prediction, sum of error, MAE, MSE, RMSE and R2 in one aggregation."""
    g = group_cols or []
    e = F.col(pred) - F.col(actual)
    agg = df.groupBy(*g).agg(F.sum(pred).alias("sum_pred"), F.sum(e).alias("sum_error"),
                             F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                             F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*g, "sum_pred", "sum_error", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      (1 - F.col("_sse") / (F.col("_v") * F.col("_n"))).alias("r2"))


def logit_fit_stats(df: DataFrame, actual: str, prob: str, n_params: int) -> DataFrame:
    """Log-likelihood, AIC and McFadden pseudo R2 of fitted probabilities."""
    y = F.col(actual).cast("double")
    p = F.col(prob)
    agg = df.agg(F.sum(y * F.log(p) + (1 - y) * F.log(1 - p)).alias("llf"), F.avg(y).alias("_m"),
                 F.count(F.lit(1)).alias("_n"))
    ll0 = F.col("_n") * (F.col("_m") * F.log("_m") + (1 - F.col("_m")) * F.log(1 - F.col("_m")))
    return agg.select("llf", (2 * n_params - 2 * F.col("llf")).alias("aic"), (1 - F.col("llf") / ll0).alias("prsquared"))
