"""Skew-proof prefix kernel, average rank, dense index against plain windows / pandas."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators.indexing import dense_index
from kestrel.operators.prefix import average_rank, prefix_agg


def test_prefix_agg_matches_window_under_skew(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    got = prefix_agg(df, ["g"], ["t"], [("s", "v", "sum"), ("c", "*", "count"), ("m", "v", "max")], exclusive=True)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("g", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count(F.lit(1)).over(w).alias("c"),
                    F.max("v").over(w).alias("m"))
    a = sorted(tuple(r) for r in got.select("g", "t", "s", "c", "m").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_average_rank_fixture(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)], "id int, x double")
    got = {r.id: r.pct_rank for r in average_rank(df, [], "x").collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 7, 2]], "v int")
    got = [(r.v, r.idx) for r in dense_index(df, ["v"]).orderBy("v").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (5, 3), (7, 4), (9, 5)]


def test_windows_fixtures(spark):
    from kestrel.operators.windows import longest_run, merge_intervals
    iv = spark.createDataFrame([(1, a, b) for a, b in [(1, 2), (3, 5), (4, 7), (6, 8), (9, 10)]], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in merge_intervals(iv, "k", "s", "e").collect()) == [(1, 2), (3, 8), (9, 10)]
    one = spark.createDataFrame([(1, 4, 6)], "k int, s int, e int")
    assert [(r.s, r.e) for r in merge_intervals(one, "k", "s", "e").collect()] == [(4, 6)]
    vals = spark.createDataFrame([(1, v) for v in [1, 11, 3, 0, 15, 5, 2, 4, 10, 7, 12, 6]], "k int, v int")
    r = longest_run(vals, "k", "v").first()
    assert (r.start, r.end) == (0, 7)
