"""Time-series queries.

Binding: monthly order value by priority (5 series) and daily order value by the
customer's nation (25 series, most days empty).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import timeseries as TS
from kestrel.plans.registry import register
from kestrel.sources.tables import Tables

MONTHLY_SQL = """ms AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS ts,
  round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"""
DAILY_SQL = """ds AS (SELECT n_name AS series_id, o_orderdate::DATE AS ts, round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def monthly(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("series_id"),
                            F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts")) \
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def daily(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("series_id"), F.to_date("o_orderdate").alias("ts")) \
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


@register("daily_interpolate", f"""WITH {DAILY_SQL},
r AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM ds GROUP BY 1),
cal AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS ts FROM r),
j AS (SELECT cal.series_id, cal.ts, ds.y, date_diff('day', DATE '1970-01-01', cal.ts) AS d FROM cal
      LEFT JOIN ds ON cal.series_id = ds.series_id AND cal.ts = ds.ts),
k AS (SELECT *,
  last_value(CASE WHEN y IS NOT NULL THEN d END IGNORE NULLS) OVER b AS pd, last_value(y IGNORE NULLS) OVER b AS py,
  first_value(CASE WHEN y IS NOT NULL THEN d END IGNORE NULLS) OVER f AS nd, first_value(y IGNORE NULLS) OVER f AS ny
  FROM j WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ts, CASE WHEN y IS NOT NULL THEN y WHEN pd IS NULL THEN ny WHEN nd IS NULL THEN py
  ELSE py + (ny - py) * (d - pd) / (nd - pd) END AS y FROM k""")
def q_daily_interpolate(t: Tables):
    return TS.daily_interpolate(daily(t), "series_id", "ts", ["y"])


@register("decompose_classical", f"""WITH {MONTHLY_SQL},
b AS (SELECT *, row_number() OVER w - 1 AS pos,
  CASE WHEN count(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
    (sum(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
     - 0.5 * (lag(y, 6) OVER w + lead(y, 6) OVER w)) / 12 END AS trend
  FROM ms WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
i AS (SELECT series_id, pos % 12 AS ph, avg(y - trend) AS s FROM b GROUP BY ALL),
m AS (SELECT series_id, avg(s) AS mm FROM i GROUP BY 1),
o AS (SELECT b.series_id, b.ts, b.y, b.trend, i.s - m.mm AS seasonal FROM b
  JOIN i ON b.series_id = i.series_id AND b.pos % 12 = i.ph JOIN m ON b.series_id = m.series_id)
SELECT series_id, ts, y, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
  round(y - trend - seasonal, 6) AS resid, round(y - seasonal, 6) AS seasadj FROM o""")
def q_decompose_classical(t: Tables):
    out = TS.decompose_classical(monthly(t), "series_id", "ts", "y", 12, "additive")
    for c in ("trend", "seasonal", "resid", "seasadj"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@register("decompose_stl")
def q_decompose_stl(t: Tables):
    """STL (seasonal window 7) of each monthly priority series."""
    return TS.decompose_stl(monthly(t), "series_id", "ts", "y", 12, 7)


@register("forecast_stl_arima")
def q_forecast_stl_arima(t: Tables):
    """STL + ARIMA(1,1,1) 12-month forecasts with 95 % intervals per priority."""
    return TS.forecast_stl_arima(monthly(t), "series_id", "ts", "y", 12, (1, 1, 1), 12)


@register("forecast_ets")
def q_forecast_ets(t: Tables):
    """Damped additive Holt-Winters 12-month forecasts per priority on the last 60 months."""
    return TS.forecast_ets(monthly(t), "series_id", "ts", "y", 12, 12, damped=True, last_n=60)


def _acf_sql(nlags: int) -> str:
    lags = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, nlags + 1))
    sums = ", ".join(f"sum(c * l{k}) AS n{k}" for k in range(1, nlags + 1))
    rows = " UNION ALL ".join([f"SELECT series_id, nobs, 0 AS lag, 1.0::DOUBLE AS acf FROM a"] +
                              [f"SELECT series_id, nobs, {k}, n{k} / d FROM a" for k in range(1, nlags + 1)])
    return f"""c AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS c FROM ms),
l AS (SELECT series_id, c, {lags} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
a AS (SELECT series_id, sum(c * c) AS d, count(*) AS nobs, {sums} FROM l GROUP BY series_id),
acf AS ({rows})"""


@register("acf", f"""WITH {MONTHLY_SQL}, {_acf_sql(10)}
SELECT series_id, nobs, lag::INTEGER AS lag, round(acf, 9) AS acf FROM acf""")
def q_acf(t: Tables):
    return TS.acf(monthly(t), "series_id", "ts", "y", 10).withColumn("acf", F.round("acf", 9))


def _pacf_sql(lags: int) -> str:
    """Durbin-Levinson unrolled: one step per lag, phi as a list."""
    steps = ["r AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM acf GROUP BY series_id)",
             "d1 AS (SELECT series_id, r, [r[2]] AS phi, [1.0::DOUBLE, r[2]] AS o FROM r)"]
    for k in range(2, lags + 1):
        num = " - ".join([f"r[{k + 1}]"] + [f"phi[{j}] * r[{k - j + 1}]" for j in range(1, k)])
        den = " - ".join(["1"] + [f"phi[{j}] * r[{j + 1}]" for j in range(1, k)])
        phi = ", ".join([f"phi[{j}] - p * phi[{k - j}]" for j in range(1, k)] + ["p"])
        steps.append(f"d{k} AS (SELECT series_id, r, [{phi}] AS phi, list_append(o, p) AS o FROM "
                     f"(SELECT *, ({num}) / ({den}) AS p FROM d{k - 1}))")
    return ", ".join(steps)


@register("pacf", f"""WITH {MONTHLY_SQL}, {_acf_sql(10)}, {_pacf_sql(10)}
SELECT series_id, (unnest(range(0, 11)))::INTEGER AS lag, round(unnest(o), 7) AS pacf FROM d10""")
def q_pacf(t: Tables):
    return TS.pacf(TS.acf(monthly(t), "series_id", "ts", "y", 10), "series_id").withColumn("pacf", F.round("pacf", 7))


@register("ljung_box", f"""WITH {MONTHLY_SQL}, {_acf_sql(10)},
q AS (SELECT series_id, any_value(nobs) * (any_value(nobs) + 2) * sum(acf * acf / (nobs - lag)) AS lb_stat
      FROM acf WHERE lag BETWEEN 1 AND 10 GROUP BY series_id)
SELECT series_id, round(lb_stat, 6) AS lb_stat, round(exp(-lb_stat / 2) * ({' + '.join(
    f'pow(lb_stat / 2, {i}) / {__import__("math").factorial(i)}' for i in range(5))}), 9) AS lb_pvalue FROM q""")
def q_ljung_box(t: Tables):
    out = TS.ljung_box(TS.acf(monthly(t), "series_id", "ts", "y", 10), "series_id", 10, 0)
    return out.withColumn("lb_stat", F.round("lb_stat", 6)).withColumn("lb_pvalue", F.round("lb_pvalue", 9))


@register("series_select", f"""WITH {DAILY_SQL} SELECT * FROM ds WHERE series_id IN (
  SELECT DISTINCT series_id FROM ds ORDER BY series_id LIMIT 4)""")
def q_series_select(t: Tables):
    """The first 2 x 2 nation series (by name) for a small-multiple display."""
    return TS.series_select(daily(t), "series_id", 4)


@register("forecast_align", f"""WITH {MONTHLY_SQL},
fc AS (SELECT series_id, (ts + INTERVAL 12 MONTH)::DATE AS ts, y AS forecast FROM ms)
SELECT ms.series_id, ms.ts, fc.forecast, ms.y FROM fc RIGHT JOIN ms ON fc.series_id = ms.series_id AND fc.ts = ms.ts""")
def q_forecast_align(t: Tables):
    """Seasonal-naive forecasts (value 12 months earlier) aligned to every observed month."""
    from kestrel.operators.relational import forecast_align
    m = monthly(t)
    fc = m.select("series_id", F.add_months("ts", 12).alias("ts"), F.col("y").alias("forecast"))
    return forecast_align(fc, m, ["series_id", "ts"]).select("series_id", "ts", "forecast", "y")
