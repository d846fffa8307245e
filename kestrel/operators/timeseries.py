"""Many-series time-series operators on long frames (series_id, ts, y).

Calendar filling, classical decomposition, autocorrelation and the Ljung-Box
statistic are native windows and aggregates; they scale with the number of
series (each series is bounded by its calendar). STL, ARIMA and exponential
smoothing run per series in numpy inside ``groupBy(series).applyInPandas``:
one series per task call, never the whole frame.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# K1: daily calendar with linear interpolation
# ---------------------------------------------------------------------------

def daily_interpolate(df: DataFrame, key: str, ts: str, numeric: list[str], others: list[str] | None = None) -> DataFrame:
    """Every day between each series' first and last date; numeric columns linearly
    interpolated in time, other columns back-filled - all within the series."""
    others = others or []
    rng = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    cal = rng.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(ts))
    j = cal.join(df.select(key, ts, *numeric, *others), [key, ts], "left")
    back = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    # "next known value" as a growing frame over descending time (linear), not a
    # shrinking unbounded-following frame (quadratic in the series length)
    fwd = Window.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    day = F.datediff(F.col(ts), F.lit("1970-01-01"))
    out = j.withColumn("_day", day)
    cols = []
    for c in numeric:
        pd_ = F.last(F.when(F.col(c).isNotNull(), F.col("_day")), True).over(back)
        py = F.last(c, True).over(back)
        nd = F.last(F.when(F.col(c).isNotNull(), F.col("_day")), True).over(fwd)
        ny = F.last(c, True).over(fwd)
        interp = F.when(F.col(c).isNotNull(), F.col(c)) \
            .when(pd_.isNull(), ny) \
            .when(nd.isNull(), py) \
            .otherwise(py + (ny - py) * (F.col("_day") - pd_) / (nd - pd_))
        cols.append(interp.cast("double").alias(c))
    for c in others:
        cols.append(F.last(c, True).over(fwd).alias(c))
    return out.select(key, ts, *cols)


# ---------------------------------------------------------------------------
# K2, K4: classical decomposition
# ---------------------------------------------------------------------------

def decompose_classical(df: DataFrame, key: str, ts: str, y: str, period: int, model: str = "additive") -> DataFrame:
    """Centred moving-average trend (2 x m for even m), seasonal index = mean of the
    detrended values per phase, centred (additive) or normalised (multiplicative),
    residual and seasonally adjusted series. Ends without a full window are null."""
    w = Window.partitionBy(key).orderBy(ts)
    k = period // 2
    wr = w.rowsBetween(-k, k)
    base = df.select(key, ts, F.col(y).cast("double").alias(y)).withColumn("_pos", F.row_number().over(w) - 1)
    full = F.count(y).over(wr) == (2 * k + 1)
    if period % 2 == 0:
        tr = (F.sum(y).over(wr) - 0.5 * (F.lag(y, k).over(w) + F.lead(y, k).over(w))) / period
    else:
        tr = F.avg(y).over(wr)
    base = base.withColumn("trend", F.when(full, tr))
    mult = model.startswith("m")
    det = (F.col(y) / F.col("trend")) if mult else (F.col(y) - F.col("trend"))
    base = base.withColumn("_det", det).withColumn("_phase", F.col("_pos") % period)
    idx = base.groupBy(key, "_phase").agg(F.avg("_det").alias("_s"))
    norm = idx.groupBy(key).agg(F.avg("_s").alias("_m"))
    idx = idx.join(norm, key).withColumn("seasonal", (F.col("_s") / F.col("_m")) if mult else (F.col("_s") - F.col("_m")))
    out = base.join(idx.select(key, "_phase", "seasonal"), [key, "_phase"], "left")
    if mult:
        out = out.withColumn("resid", F.col(y) / (F.col("trend") * F.col("seasonal"))) \
            .withColumn("seasadj", F.col(y) / F.col("seasonal"))
    else:
        out = out.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal")) \
            .withColumn("seasadj", F.col(y) - F.col("seasonal"))
    return out.select(key, ts, y, "trend", "seasonal", "resid", "seasadj")


# ---------------------------------------------------------------------------
# K7-K9: autocorrelation, partial autocorrelation, Ljung-Box
# ---------------------------------------------------------------------------

def acf(df: DataFrame, key: str, ts: str, y: str, nlags: int = 10) -> DataFrame:
    """acf(k) = sum (y_t - m)(y_t-k - m) / sum (y_t - m)^2 per series, k = 0..nlags."""
    w = Window.partitionBy(key).orderBy(ts)
    m = F.avg(y).over(Window.partitionBy(key))
    c = df.select(key, ts, (F.col(y) - m).alias("_c"))
    lags = c.select(key, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, nlags + 1)])
    agg = lags.groupBy(key).agg(F.sum(F.col("_c") * F.col("_c")).alias("_d"), F.count(F.lit(1)).alias("nobs"),
                                *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_n{k}") for k in range(1, nlags + 1)])
    entries = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")),
                      *[F.struct(F.lit(k).alias("lag"), (F.col(f"_n{k}") / F.col("_d")).alias("acf"))
                        for k in range(1, nlags + 1)])
    return agg.select(key, "nobs", F.explode(entries).alias("e")).select(key, "nobs", "e.lag", "e.acf")


def pacf(acf_df: DataFrame, key: str) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion, folded over each series'
    autocorrelations (an array of as many lags as ``acf_df`` has)."""
    r = acf_df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("_r"))

    def dot(phi, values):
        return F.aggregate(F.zip_with(phi, values, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def step(acc, k):
        phi = acc["phi"]
        before = F.slice(F.col("_r"), 2, k - 1)  # lags 1 .. k - 1
        num = F.element_at("_r", k + 1) - dot(phi, F.reverse(before))
        p = F.try_divide(num, 1 - dot(phi, before))
        grown = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - p * b), F.array(p))
        return F.struct(grown.alias("phi"), F.concat(acc["out"], F.array(p)).alias("out"))

    first = F.struct(F.array(F.element_at("_r", 2)).alias("phi"), F.array(F.lit(1.0), F.element_at("_r", 2)).alias("out"))
    lags = F.when(F.size("_r") > 2, F.sequence(F.lit(2), F.size("_r") - 1)).otherwise(F.array().cast("array<int>"))
    out = F.when(F.size("_r") > 1, F.aggregate(lags, first, step)["out"]).otherwise(F.array(F.lit(1.0)))
    return r.select(key, F.posexplode(out).alias("lag", "pacf"))


def chi2_sf_even(x, df: int):
    """Upper tail of chi-square with an even number of degrees of freedom, as a Column
    expression: exp(-x/2) * sum_{i<df/2} (x/2)^i / i!."""
    half = x / 2
    terms = [F.pow(half, F.lit(float(i))) / math.factorial(i) for i in range(df // 2)]
    return F.exp(-half) * sum(terms[1:], terms[0])


def _chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square (regularised upper incomplete gamma), any k."""
    if x <= 0:
        return 1.0
    a, z = k / 2.0, x / 2.0
    if z < a + 1:
        term = s = 1.0 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= z / n
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def ljung_box(acf_df: DataFrame, key: str, lags: int, model_df: int = 0) -> DataFrame:
    """Q = n(n+2) sum_{k<=lags} acf_k^2 / (n-k) natively; p-value from the chi-square
    tail with lags - model_df degrees of freedom (closed form for even df, otherwise a
    vectorised helper on the one row per series)."""
    q = acf_df.where((F.col("lag") >= 1) & (F.col("lag") <= lags)).groupBy(key).agg(
        (F.first("nobs") * (F.first("nobs") + 2) *
         F.sum(F.col("acf") * F.col("acf") / (F.col("nobs") - F.col("lag")))).alias("lb_stat"))
    dfree = lags - model_df
    if dfree > 0 and dfree % 2 == 0:
        return q.withColumn("lb_pvalue", chi2_sf_even(F.col("lb_stat"), dfree))

    @F.pandas_udf("double")
    def sf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: _chi2_sf(float(v), dfree))

    return q.withColumn("lb_pvalue", sf("lb_stat"))


def series_select(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n series ids (sorted); a selection for small-multiple displays."""
    first = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(first), key, "left_semi")


# ---------------------------------------------------------------------------
# K3, K5, K6: STL, ARIMA and exponential smoothing per series (numpy)
# ---------------------------------------------------------------------------

def _loess(y: np.ndarray, x: np.ndarray, xo: np.ndarray, span: int, w: np.ndarray | None = None,
           degree: int = 1) -> np.ndarray:
    """Local linear (or constant) regression with tricube weights on ``span`` neighbours."""
    n = len(x)
    q = min(span, n)
    out = np.empty(len(xo))
    w = np.ones(n) if w is None else w
    for i, x0 in enumerate(xo):
        d = np.abs(x - x0)
        idx = np.argsort(d, kind="stable")[:q]
        h = d[idx].max()
        if span > n:
            h += (span - n) / 2.0
        u = d[idx] / h if h > 0 else np.zeros(q)
        tw = np.clip(1 - u ** 3, 0, None) ** 3 * w[idx]
        if tw.sum() <= 0:
            out[i] = np.nan
            continue
        xs, ys = x[idx], y[idx]
        if degree == 0:
            out[i] = np.sum(tw * ys) / tw.sum()
            continue
        xm = np.sum(tw * xs) / tw.sum()
        ym = np.sum(tw * ys) / tw.sum()
        sxx = np.sum(tw * (xs - xm) ** 2)
        b = np.sum(tw * (xs - xm) * (ys - ym)) / sxx if sxx > 1e-12 else 0.0
        out[i] = ym + b * (x0 - xm)
    return out


def _odd(v: int) -> int:
    v = int(v)
    return v if v % 2 else v + 1


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None,
        robust: bool = False, inner: int = 2, outer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by LOESS (Cleveland et al., 1990)."""
    n = len(y)
    ns = _odd(seasonal)
    nt = _odd(trend or math.ceil(1.5 * period / (1 - 1.5 / ns)))
    nl = _odd(low_pass or period)
    t = np.arange(n, dtype=float)
    trend_c = np.zeros(n)
    season = np.zeros(n)
    rw = np.ones(n)
    for _ in range(max(outer, 0) + 1):
        for _ in range(inner):
            det = y - trend_c
            c = np.empty(n + 2 * period)
            for ph in range(period):
                idx = np.arange(ph, n, period)
                xs = idx.astype(float)
                xo = np.concatenate([[ph - period], idx, [idx[-1] + period]]).astype(float)
                sm = _loess(det[idx], xs, xo, ns, rw[idx])
                c[np.concatenate([[ph], idx + period, [idx[-1] + 2 * period]])] = sm
            ma = np.convolve(c, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(3) / 3, mode="valid")
            low = _loess(ma, t, t, nl)
            season = c[period:period + n] - low
            trend_c = _loess(y - season, t, t, nt, rw)
        if robust and outer > 0:
            r = np.abs(y - season - trend_c)
            h = 6 * np.median(r)
            rw = np.clip(1 - (r / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return trend_c, season, y - trend_c - season


def _stl_group(key: str, ts: str, y: str, period: int, seasonal: int, robust: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        v = pdf[y].to_numpy(dtype=float)
        tr, se, re = stl(v, period, seasonal, robust=robust, outer=15 if robust else 0)
        return pd.DataFrame({key: pdf[key].to_numpy(), ts: pdf[ts].to_numpy(), y: v, "trend": tr, "seasonal": se,
                             "resid": re, "seasadj": v - se})
    return run


def decompose_stl(df: DataFrame, key: str, ts: str, y: str, period: int, seasonal: int = 7,
                  robust: bool = False) -> DataFrame:
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {ts} {types[ts]}, {y} double, trend double, seasonal double, resid double, seasadj double"
    return df.select(key, ts, F.col(y).cast("double").alias(y)).groupBy(key) \
        .applyInPandas(_stl_group(key, ts, y, period, seasonal, robust), schema)


def _arma_fit(z: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """ARMA(p, q) with intercept by Hannan-Rissanen: a long AR gives residual estimates,
    then least squares on lagged values and lagged residuals (conditional sum of squares)."""
    n = len(z)
    if q > 0:
        m = min(max(p + q + 5, int(round(np.log(n) ** 2))), max(n // 3, 1))
        X = np.column_stack([np.ones(n - m)] + [z[m - i:n - i] for i in range(1, m + 1)])
        b, *_ = np.linalg.lstsq(X, z[m:], rcond=None)
        e = np.zeros(n)
        e[m:] = z[m:] - X @ b
    else:
        e = np.zeros(n)
    s = max(p, q, 1) + (min(max(p + q + 5, int(round(np.log(n) ** 2))), max(n // 3, 1)) if q > 0 else 0)
    s = min(s, n - 1)
    cols = [np.ones(n - s)] + [z[s - i:n - i] for i in range(1, p + 1)] + [e[s - j:n - j] for j in range(1, q + 1)]
    X = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(X, z[s:], rcond=None)
    c, phi, theta = beta[0], beta[1:1 + p], beta[1 + p:]
    resid = np.zeros(n)
    for t_ in range(n):
        ar = sum(phi[i] * z[t_ - 1 - i] for i in range(p) if t_ - 1 - i >= 0)
        ma = sum(theta[j] * resid[t_ - 1 - j] for j in range(q) if t_ - 1 - j >= 0)
        resid[t_] = z[t_] - c - ar - ma
    sigma2 = float(np.mean(resid[max(p, q):] ** 2)) if n > max(p, q) else float("nan")
    return np.concatenate([[c], phi]), theta, sigma2, resid


def _psi_weights(phi: np.ndarray, theta: np.ndarray, d: int, h: int) -> np.ndarray:
    ar = np.concatenate([[1.0], -phi])
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    ma = np.concatenate([[1.0], theta])
    psi = np.zeros(h)
    for j in range(h):
        v = ma[j] if j < len(ma) else 0.0
        for i in range(1, min(j, len(ar) - 1) + 1):
            v -= ar[i] * psi[j - i]
        psi[j] = v
    return psi


def arima_forecast(y: np.ndarray, order: tuple[int, int, int], steps: int, z_alpha: float = 1.959963984540054):
    """Point forecasts and normal prediction intervals of ARIMA(p, d, q)."""
    p, d, q = order
    z = np.diff(y, n=d) if d else y.copy()
    cphi, theta, sigma2, resid = _arma_fit(z, p, q)
    c, phi = cphi[0], cphi[1:]
    hist, eh = list(z), list(resid)
    fc = []
    for h in range(steps):
        v = c + sum(phi[i] * hist[-1 - i] for i in range(p)) + \
            sum(theta[j] * eh[-1 - j] for j in range(q) if h - j <= 0 and len(eh) > j)
        hist.append(v)
        eh.append(0.0)
        fc.append(v)
    fc = np.array(fc)
    if d:
        last = y[-d:].astype(float)
        for _ in range(d):
            fc = np.cumsum(fc) + last[-1]
    psi = _psi_weights(phi, theta, d, steps)
    se = np.sqrt(sigma2 * np.cumsum(psi ** 2))
    k = p + q + 1
    n = len(z)
    aic = n * math.log(sigma2) + 2 * k if sigma2 > 0 else float("nan")
    aicc = aic + 2 * k * (k + 1) / max(n - k - 1, 1)
    return fc, fc - z_alpha * se, fc + z_alpha * se, resid, aic, aicc, sigma2


def _stl_arima_group(key, ts, y, period, order, steps, freq_days, boxcox_lambda):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        v = pdf[y].to_numpy(dtype=float)
        if boxcox_lambda is not None:
            v = np.log(v) if boxcox_lambda == 0 else (np.power(v, boxcox_lambda) - 1) / boxcox_lambda
        _, se, _ = stl(v, period)
        adj = v - se
        fc, lo, hi, resid, aic, aicc, mse = arima_forecast(adj, order, steps)
        seas = np.array([se[len(se) - period + (h % period)] for h in range(steps)])
        fc, lo, hi = fc + seas, lo + seas, hi + seas
        if boxcox_lambda is not None:
            inv = (lambda a: np.exp(a)) if boxcox_lambda == 0 else \
                (lambda a: np.power(a * boxcox_lambda + 1, 1 / boxcox_lambda))
            fc, lo, hi = inv(fc), inv(lo), inv(hi)
        last = pd.Timestamp(pdf[ts].iloc[-1])
        if freq_days:
            dates = [last + pd.Timedelta(days=freq_days * (h + 1)) for h in range(steps)]
        else:
            dates = [last + pd.DateOffset(months=h + 1) for h in range(steps)]
        return pd.DataFrame({key: pdf[key].iloc[0], ts: [x.date() for x in dates], "step": np.arange(1, steps + 1),
                             "forecast": fc, "lower": lo, "upper": hi, "aic": aic, "aicc": aicc, "mse": mse})
    return run


def forecast_stl_arima(df: DataFrame, key: str, ts: str, y: str, period: int, order: tuple[int, int, int],
                       steps: int, freq_days: int | None = None, boxcox_lambda: float | None = None) -> DataFrame:
    """Per series: STL, ARIMA on the seasonally adjusted values, seasonal naive
    re-seasonalising, 95 % intervals, optional inverse Box-Cox; exactly ``steps`` rows."""
    types = dict(df.dtypes)
    schema = (f"{key} {types[key]}, {ts} date, step int, forecast double, lower double, upper double, "
              f"aic double, aicc double, mse double")
    return df.select(key, ts, F.col(y).cast("double").alias(y)).groupBy(key) \
        .applyInPandas(_stl_arima_group(key, ts, y, period, order, steps, freq_days, boxcox_lambda), schema)


def holt_winters(y: np.ndarray, period: int, alpha: float, beta: float, gamma: float, phi: float = 1.0):
    n = len(y)
    level = float(np.mean(y[:period]))
    trend = float((np.mean(y[period:2 * period]) - np.mean(y[:period])) / period) if n >= 2 * period else 0.0
    season = list(y[:period] - level)
    fitted = np.empty(n)
    for t_ in range(n):
        s = season[t_ % period] if t_ < period else season[-period]
        fitted[t_] = level + phi * trend + s
        new_level = alpha * (y[t_] - s) + (1 - alpha) * (level + phi * trend)
        trend = beta * (new_level - level) + (1 - beta) * phi * trend
        season.append(gamma * (y[t_] - new_level) + (1 - gamma) * s)
        level = new_level
    return level, trend, season, fitted


def ets_forecast(y: np.ndarray, period: int, steps: int, damped: bool = False, z_alpha: float = 1.959963984540054):
    """Additive Holt-Winters; smoothing weights by SSE grid search."""
    grid = np.round(np.arange(0.1, 1.0, 0.2), 2)
    phis = [0.9, 0.98] if damped else [1.0]
    best = None
    for a in grid:
        for b in grid:
            for g in grid:
                for ph in phis:
                    _, _, _, fit = holt_winters(y, period, a, b, g, ph)
                    sse = float(np.sum((y - fit) ** 2))
                    if best is None or sse < best[0]:
                        best = (sse, a, b, g, ph)
    sse, a, b, g, ph = best
    level, trend, season, fit = holt_winters(y, period, a, b, g, ph)
    fc = []
    damp = 0.0
    for h in range(1, steps + 1):
        damp += ph ** h
        fc.append(level + damp * trend + season[-period + (h - 1) % period])
    fc = np.array(fc)
    sigma2 = sse / len(y)
    se = np.sqrt(sigma2 * (1 + np.arange(steps) * a ** 2))
    k = 4
    aic = len(y) * math.log(sigma2) + 2 * k if sigma2 > 0 else float("nan")
    return fc, fc - z_alpha * se, fc + z_alpha * se, aic, sigma2, (a, b, g, ph)


def forecast_ets(df: DataFrame, key: str, ts: str, y: str, period: int, steps: int, damped: bool = False,
                 last_n: int | None = None) -> DataFrame:
    """Per series exponential smoothing (trend, optional damping, additive season) fitted
    on the last ``last_n`` observations, with 95 % intervals."""
    types = dict(df.dtypes)
    schema = (f"{key} {types[key]}, step int, forecast double, lower double, upper double, aic double, mse double, "
              f"alpha double, beta double, gamma double, phi double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        v = pdf[y].to_numpy(dtype=float)
        if last_n:
            v = v[-last_n:]
        fc, lo, hi, aic, mse, (a, b, g, ph) = ets_forecast(v, period, steps, damped)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, steps + 1), "forecast": fc, "lower": lo,
                             "upper": hi, "aic": aic, "mse": mse, "alpha": a, "beta": b, "gamma": g, "phi": ph})

    return df.select(key, ts, F.col(y).cast("double").alias(y)).groupBy(key).applyInPandas(run, schema)
