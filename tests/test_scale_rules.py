"""Cases where a cap, a packed key or a swallowed error once gave a wrong result."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators import aggregate as A
from kestrel.operators import recommend as RC
from kestrel.operators import relational as R
from kestrel.operators.indexing import dense_index
from kestrel.operators.prefix import average_rank, prefix_agg
from kestrel.operators.scorecard import train_test_stats
from kestrel.sources import files as FS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_kcore_of_a_chain_is_empty(spark):
    edges = [(f"u{i // 2 + i % 2}", f"i{i // 2}", 1) for i in range(41)]
    assert RC.kcore_filter(spark.createDataFrame(edges, "user string, item string, r int"), 2, 2).count() == 0


def test_conversion_with_huge_negative_and_text_ids(spark):
    big = 1 << 41
    for ids in ((big + 5, big + 9, big + 7), (-5, -9, -7), ("a", "c", "b")):
        rows = [(ids[0], 1, "2000-01-01", "p"), (ids[1], 1, "2000-01-13", "p"), (ids[2], 1, "2000-01-11", "p")]
        kind = "string" if isinstance(ids[0], str) else "long"
        items = spark.createDataFrame(rows, f"transaction_id {kind}, customer_id long, order_date string, product_id string") \
            .withColumn("order_date", F.to_date("order_date"))
        txns = items.groupBy("transaction_id", "customer_id", "order_date").agg(F.collect_set("product_id").alias("watched"))
        got = {r["transaction_id"]: (str(r["converted_date"]), r["converted_txn_id"]) for r in R.conversion(txns, items).collect()}
        assert got == {ids[0]: ("2000-01-11", ids[2]), ids[2]: ("2000-01-13", ids[1])}


def test_null_is_not_one_of_the_top_values(spark):
    rows = [(1, None)] * 10 + [(1, "x")] * 3 + [(1, c) for c in "abcde"]
    out = A.cluster_top5_other(spark.createDataFrame(rows, "k int, v string"), "k", ["v"])
    got = {r["value"]: r["count"] for r in out.where("cluster = 1").collect()}
    assert got[None] == 10 and got["x"] == 3 and got["Other"] == 1 and len(got) == 7


def test_unreadable_model_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "model")
    os.makedirs(path)
    with open(f"{path}/part-0.parquet", "wb") as f:
        f.write(b"not parquet")
    one = spark.createDataFrame([("a", "x")], "input string, algorithm string")
    with pytest.raises(Exception):  # noqa: B017 - the reader's error
        FS.save_model(one, path)
    assert open(f"{path}/part-0.parquet", "rb").read() == b"not parquet"
    FS.save_model(one, str(tmp_path / "new"))
    with pytest.raises(FS.ModelDowngrade):
        FS.save_model(one.limit(0), str(tmp_path / "new"))


def test_given_settings_survive():
    code = "from kestrel.session import get_session; s = get_session('local[1]'); print('GOT', s.conf.get('spark.sql.shuffle.partitions'), " \
           "s.conf.get('spark.sql.session.timeZone'))"
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=77 --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell",
                        "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300).stdout
    assert "GOT 77 Asia/Tokyo" in out


def test_prefix_kernel_with_a_key_of_half_the_rows(spark, monkeypatch):
    from kestrel.operators import ranges
    monkeypatch.setattr(ranges, "ROWS_PER_BUCKET", 100)
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else ("hot" if i % 2 else f"k{rng.randrange(9)}"), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    plain = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    for down in (False, True):
        w = Window.partitionBy("g").orderBy(F.col("o").desc() if down else F.col("o")).rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("g", "o", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
        got = prefix_agg(df, ["g"], ["o"], [("s", "v", "sum"), ("m", "v", "max")], descending=down).select("g", "o", "s", "m")
        assert got.exceptAll(want).isEmpty() and got.count() == 3000
    buckets = df.select(ranges.range_bucket(df, ["g", "o"]).alias("b")).groupBy("b").count().collect()
    assert len(buckets) >= 6 and max(r["count"] for r in buckets) < 1500
    index = dense_index(df, ["v", "o"]).orderBy("idx").collect()
    assert [r["idx"] for r in index] == list(range(3000)) and [(r["v"], r["o"]) for r in index] == sorted((v, o) for _, o, v in rows)
    assert prefix_agg(df.limit(0), ["g"], ["o"], [("s", "v", "sum")]).count() == 0
    assert plain is not None and average_rank(df, [], "v").count() == 3000


def test_prefix_offsets_are_of_split_groups_only(spark, monkeypatch):
    """Many small groups and a hot one: the offsets, which go to every task, are a few rows a bucket, not one a group."""
    from kestrel.operators import prefix, ranges
    monkeypatch.setattr(ranges, "ROWS_PER_BUCKET", 100)
    sent = []
    plain = F.broadcast
    monkeypatch.setattr(prefix.F, "broadcast", lambda df: sent.append(df) or plain(df))
    rows = [(None if i % 50 == 0 else (-1 if i % 3 == 0 else i // 2), i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    w = Window.partitionBy("g").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.min("v").over(w).alias("m"))
    got = prefix_agg(df, ["g"], ["o"], [("s", "v", "sum"), ("m", "v", "min")], exclusive=True, descending=True).select("g", "o", "s", "m")
    assert got.exceptAll(want).isEmpty() and got.count() == 2000
    split, offsets = sent
    assert split.count() < 8 and offsets.count() < 16


@pytest.fixture(scope="module")
def factors(spark):
    rng = random.Random(5)
    rows = {(u, i): 1 + rng.randrange(3) for u in range(12) for i in rng.sample(range(30), 4 if u else 26)}
    train = spark.createDataFrame([(u, i, r) for (u, i), r in rows.items()], "user int, item int, r int")
    return train, RC.als_fit(train, 4, 0.1, 10.0, 3), rows


def test_heavy_user_leaves_other_lists_alone(factors):
    train, model, rows = factors
    got = {}
    for r in RC.als_recommend(model, train, 5).collect():
        got.setdefault(r["user"], []).append((r["rank"], r["item"], r["score"]))
    x = {r["id"]: r["features"] for r in model.userFactors.collect()}
    y = {r["id"]: r["features"] for r in model.itemFactors.collect()}
    for u, f in x.items():
        unseen = sorted(((-sum(a * b for a, b in zip(f, v)), i) for i, v in y.items() if (u, i) not in rows))
        have = [i for _, i, _ in sorted(got.get(u, []))]
        assert len(have) == min(5, len(unseen))
        assert all(abs(unseen[k][0] + s) < 1e-4 for k, (_, _, s) in enumerate(sorted(got.get(u, []))))


def test_rank_among_all_unseen_items(spark, factors):
    train, model, rows = factors
    x = {r["id"]: r["features"] for r in model.userFactors.collect()}
    y = {r["id"]: r["features"] for r in model.itemFactors.collect()}
    new = [(u, next(i for i in sorted(y, reverse=True) if (u, i) not in rows), 1) for u in x]
    pairs = spark.createDataFrame(new, "user int, item int, r int")
    for load in (20, 1 << 21):
        got = {r["user"]: (r["position"], r["pct_rank"]) for r in RC.als_unseen_ranks(model, train, pairs, shard_load=load).collect()}
        for u, i, _ in new:
            score = {j: sum(a * b for a, b in zip(x[u], v)) for j, v in y.items() if (u, j) not in rows}
            higher = sum(s > score[i] + 1e-9 for s in score.values())
            assert got[u][0] == higher and abs(got[u][1] - (higher + 1) / len(score)) < 1e-12
    grid = RC.als_grid(train, pairs, [{"rank": 3, "max_iter": 2}], 3).collect()
    assert 0 < grid[0]["mpr"] <= 1 and {r["model"][:4] for r in grid} == {"als", "popu", "neig"}


def test_stats_with_a_third_sample_in_order(spark):
    rows = [("train", "b", 2, 1), ("train", "a", 1, 0), ("valid", "a", 1, 1), ("test", "b", 2, 0), ("valid", "c", 0, 0)]
    df = spark.createDataFrame(rows, "s string, g string, o int, y int")
    got = train_test_stats(df, "s", "g", "y", valid="valid", order_by="o").collect()
    assert [r["g"] for r in got] == ["c", "a", "b", "Total"] and [r["valid_obs"] for r in got] == [1, 1, 0, 2]
    assert [r["er_valid_pct"] for r in got] == [0.0, 100.0, 0.0, 50.0]


def test_boxcox_lambda_by_moments(spark):
    """Moments of many batches and groups give the likelihood of the definition; equal values have none."""
    import math

    import numpy as np

    from kestrel.operators import relational as R
    rnd = np.random.default_rng(5)
    y = {f"g{k}": np.exp(rnd.normal(k % 3, 1, 40)) for k in range(4)}
    rows = [(g, float(v)) for g, vs in y.items() for v in vs] + [("same", 7.3)] * 30 + [(None, 2.0), (None, 5.0), ("low", -1.0), ("low", None)]
    got = {r.g: r for r in R.boxcox_lambda(spark.createDataFrame(rows, "g string, y double").repartition(5), "y", ["g"], (-1.0, 1.0, 0.25)).collect()}
    assert got.keys() == {*y, "same", None} and got["same"].llf is None and got["same"].lmbda is None
    for g, v in [*y.items(), (None, np.array([2.0, 5.0]))]:
        llf = {lam: -len(v) / 2 * math.log(np.var(np.log(v) if lam == 0 else (v ** lam - 1) / lam)) + (lam - 1) * np.log(v).sum()
               for lam in np.arange(-1, 1.01, 0.25).round(6)}
        assert got[g].lmbda == max(llf, key=llf.get) and abs(got[g].llf - max(llf.values())) < 1e-9


def test_gram_tables_deal_rows_by_their_terms(spark, monkeypatch):
    from kestrel.operators import matching as M
    monkeypatch.setattr(M, "TERMS_PER_TASK", 20)
    df = spark.createDataFrame([(k % 40, f"aa b{k} aa") for k in range(80)] + [(None, "aa")], "k int, t string")
    out = M.bow_counts(df, "k", "t", (1, 2), 1)
    assert out.rdd.getNumPartitions() > 8
    got = {(r.key, r.term): r.n for r in out.collect()}
    assert got[0, "aa"] == 4 and got[3, "b3 aa"] == 1 and got[None, "aa"] == 1 and len(got) == 40 * 7 + 1
    out = M.gram_counts_table(df, "k", F.split("t", " "))
    assert out.rdd.getNumPartitions() > 8
    assert {(r.key, r.gram): r.n for r in out.collect()}[7, "aa"] == 4
