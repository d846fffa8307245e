"""Digit selection and the time-sliced interval join against brute force."""

import math
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import relational as R
from kestrel.operators.scorecard import exact_quantiles, quantile_bins
from kestrel.operators.selection import ordered_bits, values_at_ranks


def test_bits_are_in_the_order_of_the_doubles():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.0, 1.0]])
    bits = ordered_bits(v)
    for a, b in zip(v, np.roll(v, 1)):
        x, y = ordered_bits(np.array([a, b]))
        assert (x < y) == (a < b) and (x == y) == (a == b)
    assert (v[np.argsort(bits, kind="stable")] == np.sort(v)).all()
    assert ordered_bits(np.array([np.nan]))[0] > bits.max()


def test_values_at_all_ranks(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9), float(rng.randrange(5)), -0.0])) for g in ("a", "b", None) for _ in range(120)]
    rows += [("a", None), ("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    every = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda r: F.struct(r.alias("rank")))
    got = {}
    for r in values_at_ranks(df, "x", ["g"], every).collect():
        got.setdefault(r.g, []).append((r["rank"], r.v))
    want = {g: sorted(x for h, x in rows if h == g and x is not None) for g in "abc"}
    assert {g: [v for _, v in sorted(x)] for g, x in got.items()} == want
    assert values_at_ranks(df.limit(0), "x", ["g"], every).count() == 0


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    columns = {"wide": rng.normal(size=3000) * 10.0 ** rng.integers(-20, 20, 3000), "few": rng.integers(0, 4, 3000).astype(float),
               "hot": np.where(rng.random(3000) < 0.4, 1.5, rng.random(3000)), "one": np.array([2.5])}
    df = spark.createDataFrame([(n, float(x)) for n, v in columns.items() for x in v], "n string, x double")
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]
    got = {r.n: r["_q"] for r in exact_quantiles(df, "x", probs, ["n"]).collect()}
    for n, v in columns.items():
        v = np.sort(v)
        h = [p * (len(v) - 1) for p in probs]
        assert got[n] == [v[math.floor(x)] + (v[math.ceil(x)] - v[math.floor(x)]) * (x - math.floor(x)) for x in h]
    assert exact_quantiles(df, "x", [0.5]).count() == 1 and exact_quantiles(df.limit(0), "x", [0.5]).first()["_q"] == []


def test_interval_match(spark):
    rng = random.Random(4)
    day = lambda k: date(1999, 12, 1) + timedelta(k) if k is not None else None
    items = [(i, rng.choice(["a", "b", "b", "b", None]), day(rng.choice([None, *range(400)]))) for i in range(300)]
    camps = [(k, rng.choice("abc"), day(s), day(s + n)) for k in range(60) for s in [rng.randrange(-4000, 400)] for n in [rng.choice([0, 1, 6, 7, 8, 365, 5000, -3])]]
    camps += [(99, "a", None, day(3)), (98, "b", day(3), None)]
    i = spark.createDataFrame(items, "id int, p string, d date")
    c = spark.createDataFrame(camps, "camp int, q string, s date, e date")
    got = R.interval_match(i, c, "p", "q", "d", "s", "e")
    assert got.columns == ["id", "p", "d", "camp", "s", "e"]
    want = [(x, k) for x, p, d in items for k, q, s, e in camps if d and s and e and p == q and s <= d <= e]
    assert sorted((r.id, r.camp) for r in got.collect()) == sorted(want) and len(want) > 200
    assert R.interval_match(i, c.limit(0), "p", "q", "d", "s", "e").count() == 0


def test_hot_product_is_spread_over_slices(spark):
    """Half of the rows are one product: no join key holds more than the rows of one slice."""
    items = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("p"),
                                       F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 1000).cast("int")).alias("d"))
    camps = spark.range(30).select(F.col("id").alias("camp"), F.lit(0).alias("q"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 30).cast("int")).alias("s")) \
        .withColumn("e", F.date_add("s", 89))
    joined = R.interval_match(items, camps, "p", "q", "d", "s", "e")
    keys = joined.withColumn("slice", F.floor(F.datediff("d", F.lit("1970-01-01")) / 16)).groupBy("p", "slice").agg(F.countDistinct("id").alias("n")).collect()
    assert len(keys) > 50 and max(r.n for r in keys) <= 10_000 * 16 / 1000 + 20
    assert joined.count() == sum(1 for i in range(0, 20_000, 2) for k in range(30) if k * 30 <= i % 1000 <= k * 30 + 89)


def test_bins_of_few_hot_groups_do_not_gather_them(spark, capsys):
    """The edges of two groups go to the rows: no task gets all rows of a group."""
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i)) for i in range(90)], "g string, x double")
    out = quantile_bins(df, "x", 3, group_cols=["g"])
    out.explain()
    assert "BroadcastHashJoin" in (plan := capsys.readouterr().out) and "SortMergeJoin" not in plan
    got = {(r.g, r.x_bin): r["count"] for r in out.groupBy("g", "x_bin").count().collect()}
    assert got == {(g, b): n for g, n in (("a", 20), ("b", 10)) for b in range(3)}


def test_many_campaigns_are_not_sent_to_every_task(spark, capsys):
    """Copies by slice are counted: only few campaigns are broadcast, with the same pairs."""
    items = spark.range(200).select("id", (F.col("id") % 40).alias("p"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("d"))
    camps = spark.range(40).select(F.col("id").alias("q"), F.lit("2000-01-10").cast("date").alias("s"), F.lit("2000-03-01").cast("date").alias("e"))
    got = {}
    for most in (100_000, 9 * 39):
        joined = R.interval_match(items, camps, "p", "q", "d", "s", "e", most=most)
        capsys.readouterr()
        joined.explain()
        got["SortMergeJoin" in capsys.readouterr().out] = sorted(r.id for r in joined.collect())
    assert got[True] == got[False] == [i for i in range(200) if 9 <= i % 100 <= 60]
