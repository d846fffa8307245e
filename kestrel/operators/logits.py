"""Many logistic regressions at once: every Newton step of all predictor subsets from one pass.

A task adds up, for each subset, the gradient and the Hessian of its rows at the subset's present
coefficients; the sums (a few numbers per subset) are added over the tasks and the step is
solved on the driver. So the number of passes is the number of steps, whatever the number of
subsets. Measures of all subsets come from one long aggregation per sample batch as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.evaluation import auroc
from kestrel.session import cut_lineage

AT_ONCE = 256  # subsets of one pass
SCORED = 32  # subsets whose scores are ranked in one aggregation
RIDGE = 1e-9  # keeps a step of separable data finite


def _sums(columns: list[str], response: str, means: np.ndarray, scales: np.ndarray, subsets: list[tuple[int, ...]], betas: list[np.ndarray]):
    """(subset, place, value): log-likelihood, gradient and Hessian of the rows of a task, as one list per subset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 + len(b) + len(b) ** 2) for b in betas]
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), (np.column_stack([batch.column(c).to_numpy() for c in columns]) - means) / scales])
            y = batch.column(response).to_numpy()
            for s, (subset, beta) in enumerate(zip(subsets, betas)):
                own = x[:, [0, *[k + 1 for k in subset]]]
                line = own @ beta
                p = 1 / (1 + np.exp(-np.clip(line, -35, 35)))
                hess = (own * (p * (1 - p))[:, None]).T @ own
                total[s] += np.concatenate([[(y * line - np.logaddexp(0, line)).sum()], own.T @ (y - p), hess.ravel()])
        size = [len(t) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(total)), size)), pa.array(np.concatenate([np.arange(n) for n in size])),
                                          pa.array(np.concatenate(total))], names=["subset", "place", "value"])

    return run


def fit_logits(train: DataFrame, predictors: list[str], response: str, subsets: list[tuple[str, ...]], steps: int = 30,
               tolerance: float = 1e-9) -> dict[tuple[str, ...], np.ndarray]:
    """Intercept and coefficients (of the predictors as they are) of an unpenalised logistic regression on every subset.

    Rows with a null predictor or response are left out.
    """
    plain = train.select(*[F.col(c).cast("double").alias(c) for c in predictors], F.col(response).cast("double").alias(response)).dropna()
    rows = cut_lineage(plain)
    moments = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in predictors for f in (F.avg, F.stddev_samp)]).first()
    means = np.array([moments[f"avg_{c}"] or 0.0 for c in predictors])
    scales = np.array([moments[f"stddev_samp_{c}"] or 1.0 for c in predictors])
    out: dict[tuple[str, ...], np.ndarray] = {}
    for lo in range(0, len(subsets), AT_ONCE):
        names = subsets[lo: lo + AT_ONCE]
        index = [tuple(predictors.index(c) for c in s) for s in names]
        betas = [np.zeros(1 + len(s)) for s in names]
        open_ = list(range(len(names)))
        for _ in range(steps):
            asked = [betas[s] for s in open_]
            got = rows.mapInArrow(_sums(predictors, response, means, scales, [index[s] for s in open_], asked), "subset long, place long, value double") \
                .groupBy("subset", "place").agg(F.sum("value").alias("value")).collect()  # 1 + p + p * p numbers per subset
            sums = [np.zeros(1 + len(b) + len(b) ** 2) for b in asked]
            for r in got:
                sums[r["subset"]][r["place"]] = r["value"]
            still = []
            for s, t in zip(open_, sums):
                n = len(betas[s])
                hess = t[1 + n:].reshape(n, n)
                step = np.linalg.lstsq(hess + RIDGE * np.trace(hess) * np.eye(n) / n + 1e-12 * np.eye(n), t[1: 1 + n], rcond=None)[0]
                step = step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-300))
                betas[s] = betas[s] + step
                if np.abs(step).max() > tolerance:
                    still.append(s)
            open_ = still
            if not open_:
                break
        for s, name in enumerate(names):
            k = list(index[s])
            coefs = betas[s][1:] / scales[k]
            out[name] = np.concatenate([[betas[s][0] - (coefs * means[k]).sum()], coefs])
    return out


def measured(samples: dict[str, DataFrame], response: str, models: dict[tuple[str, ...], np.ndarray], threshold: float) -> DataFrame:
    """(subset, sample, precision, recall, auroc) of every model on every sample."""
    frames = [d.withColumn("sample", F.lit(n)) for n, d in samples.items()]
    used = sorted({c for s in models for c in s})
    rows = frames[0].select("sample", response, *used)
    for d in frames[1:]:
        rows = rows.unionByName(d.select("sample", response, *used))
    rows = cut_lineage(rows.dropna())
    out = None
    names = list(models)
    for lo in range(0, len(names), SCORED):
        probs = []
        for s in names[lo: lo + SCORED]:
            line = sum((F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(models[s][1:], s)), F.lit(float(models[s][0])))
            probs.append(F.struct(F.lit(",".join(s)).alias("subset"), (1 / (1 + F.exp(-line))).alias("prob")))
        long = rows.select("sample", F.col(response).cast("int").alias("_y"), F.explode(F.array(*probs)).alias("m")) \
            .select("sample", "_y", "m.subset", "m.prob").groupBy("sample", "subset", "_y", "prob").agg(F.count(F.lit(1)).alias("n"))
        long = cut_lineage(long)  # distinct scores of each subset, counted
        over = F.col("prob") > threshold
        table = long.groupBy("sample", "subset").agg(
            *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k)
              for k, c in (("tp", over & (F.col("_y") == 1)), ("fp", over & (F.col("_y") == 0)), ("fn", ~over & (F.col("_y") == 1)))])
        area = auroc(long.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))), "_y", "prob", ["sample", "subset"])
        part = table.join(area.select("sample", "subset", "auroc"), ["sample", "subset"], "left") \
            .select("subset", "sample", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


def logit_best_subset(train: DataFrame, test: DataFrame, predictors: list[str], response: str, p: int, threshold: float,
                      first: list[str] | None = None, valid: DataFrame | None = None, criterion: str = "auroc",
                      ascending: bool = False) -> DataFrame:
    """Every subset of size ``p`` (always containing ``first``) fitted on train; precision, recall and AUROC at the
    threshold on test and, with a ``valid`` sample, on that (``valid_precision`` and so on), sorted by ``criterion``."""
    first = first or []
    rest = [c for c in predictors if c not in first]
    subsets = [(*first, *more) for more in itertools.combinations(rest, max(p - len(first), 0))]
    models = fit_logits(train, predictors, response, subsets)
    samples = {"test": test} | ({"valid": valid} if valid is not None else {})
    wide = None
    found = measured(samples, response, models, threshold)
    for name in samples:
        prefix = "" if name == "test" else f"{name}_"
        part = found.where(F.col("sample") == name).select("subset", *[F.col(c).alias(prefix + c) for c in ("precision", "recall", "auroc")])
        wide = part if wide is None else wide.join(part, "subset")
    wide = wide.withColumn("p", F.size(F.split("subset", ",")))
    if criterion not in wide.columns:
        raise ValueError(f"unknown criterion {criterion!r}; known: {', '.join(c for c in wide.columns if c not in ('subset', 'p'))}")
    order = F.col(criterion).asc() if ascending else F.col(criterion).desc()
    columns = ["subset", "p", *[c for c in wide.columns if c not in ("subset", "p")]]
    return wide.select(*columns).orderBy(order, "subset")
