"""Time-series fixtures: interpolation, classical decomposition, STL re-adds to observed."""

import datetime as dt

import numpy as np

from kestrel.operators import timeseries as TS


def test_interpolation(spark):
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("s", d0, 1.0), ("s", d0 + dt.timedelta(days=3), 4.0)], "k string, ts date, y double")
    got = [r.y for r in TS.daily_interpolate(df, "k", "ts", ["y"]).orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0]


def test_classical_decomposition(spark):
    y = [10, 12, 11, 13, 12, 14, 13, 15]
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("s", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)],
                               "k string, ts date, y double")
    out = TS.decompose_classical(df, "k", "ts", "y", 2).orderBy("ts").collect()
    assert [r.trend for r in out] == [None, 11.25, 11.75, 12.25, 12.75, 13.25, 13.75, None]
    assert [round(r.seasonal, 6) for r in out[:2]] == [-0.75, 0.75]


def test_stl_parts_add_up():
    rng = np.random.default_rng(1)
    t = np.arange(96)
    y = 10 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.3, len(t))
    tr, se, re = TS.stl(y, 12)
    assert np.allclose(tr + se + re, y)
    assert np.corrcoef(se, 3 * np.sin(2 * np.pi * t / 12))[0, 1] > 0.9


def test_arima_forecast_shape():
    y = np.cumsum(np.random.default_rng(2).normal(0, 1, 120)) + 50
    fc, lo, hi, *_ = TS.arima_forecast(y, (1, 1, 1), 6)
    assert len(fc) == 6 and np.all(lo <= fc) and np.all(fc <= hi)
