"""Scorecard kernels on the worked examples."""

import math

from pyspark.sql import functions as F

from kestrel.operators import scorecard as SC


def test_quantile_edges_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert SC.quantile_edges(df, "x", 4).first()["_edges"] == [1.0, 3.25, 5.5, 7.75, 10.0]
    dup = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    assert SC.quantile_edges(dup, "x", 4).first()["_edges"] == [1.0, 1.5, 3.25, 5.0]
    bins = [r.x_bin for r in SC.quantile_bins(dup, "x", 4).orderBy("x").collect()]
    assert bins == [0, 0, 0, 0, 1, 1, 2, 2]


def test_woe_fixture(spark):
    rows = [("a", 1)] * 2 + [("a", 0)] * 8 + [("b", 0)] * 20 + [("c", 1)] * 8 + [("c", 0)] * 2
    df = spark.createDataFrame(rows, "p string, y int")
    got = {r.p: (r.woe, r.event_rate_pct) for r in SC.woe(df, "p", "y").collect()}
    assert got["a"] == (0.2878, 20.0) and got["b"] == (2.5903, 0.0) and got["c"] == (-2.4844, 80.0)
    assert got["Total"][0] == 0.0


def test_psi_fixture(spark):
    s1 = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20, "v string")
    s2 = spark.createDataFrame([("a",)] * 40 + [("b",)] * 40 + [("c",)] * 20, "v string")
    total = SC.psi_categorical(s1, s2, "v").where(F.col("v") == "total").first()
    assert abs(total.psi - 0.0510826) < 1e-6
    same = SC.psi_categorical(s1, s1, "v").where(F.col("v") == "total").first()
    assert same.psi == 0.0


def test_auc_fixture_and_symmetry(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 0), (4.0, 1)], "x double, y int")
    auc = SC.auc_long(df, [], "x", "y").first().auc
    assert abs(auc - 0.75) < 1e-12
    neg = SC.auc_long(df.withColumn("x", -F.col("x")), [], "x", "y").first().auc
    assert abs(neg - (1 - auc)) < 1e-12


def test_stratified_split_is_exact_and_complete(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1000)], "id int, s int")
    out = SC.stratified_split(df, ["s"], "id", {"train": 0.6, "valid": 0.2, "test": 0.2})
    assert out.count() == 1000
    counts = {(r.s, r.sample): r["count"] for r in out.groupBy("s", "sample").count().collect()}
    for s in range(3):
        n = sum(v for (k, _), v in counts.items() if k == s)
        assert abs(counts[(s, "train")] - 0.6 * n) <= 1


def test_chi2_tail():
    from kestrel.operators.timeseries import _chi2_sf
    assert abs(_chi2_sf(14.116, 8) - 0.0788) < 1e-3
    assert abs(_chi2_sf(3.0, 3) - 0.3916251762710877) < 1e-9
    assert math.isclose(_chi2_sf(0.0, 5), 1.0)


def test_split_orders_only_rows_that_a_cut_may_divide(spark, monkeypatch):
    """Equal ids, null ids and null strata: parts are those of a window over all rows, of which few are ordered."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rows = [(None if i % 97 == 0 else i // 2, None if i % 50 == 0 else "ab"[i % 3 % 2], float(i)) for i in range(6000)] + [(7, "c", 1.0), (8, "c", 2.0)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    ordered, plain = [], SC.prefix_agg
    monkeypatch.setattr(SC, "prefix_agg", lambda d, *a, **k: ordered.append(d.count()) or plain(d, *a, **k))
    sizes = {"train": 0.5, "valid": 0.2, "test": 0.3}
    out = SC.stratified_split(df, ["s"], "id", sizes, 3)
    w = Window.partitionBy("s")
    share = (F.row_number().over(w.orderBy(SC.seeded_digest(3, "id"), "id")) - 0.5) / F.count(F.lit(1)).over(w)
    want = df.where("s IS NOT NULL").withColumn("sample", F.when(share < 0.5, "train").when(share < 0.7, "valid").otherwise("test"))
    key = ["s", "id", "sample"]
    assert out.columns == ["s", "id", "x", "sample"] and out.select("id", "s", "x").exceptAll(df).isEmpty()
    assert sorted(map(str, out.groupBy(key).count().collect())) == sorted(map(str, want.groupBy(key).count().collect()))
    assert sum(ordered) < 100
    again = SC.stratified_split(df.withColumn("sample", F.lit("old")).select("sample", "id", "s", "x"), ["s"], "id", sizes, 3)
    assert again.columns == ["s", "sample", "id", "x"] and again.select(*out.columns).exceptAll(out).isEmpty()
