"""Op 10: held-out accuracy, and the awkward tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from kestrel.llm.cotrain import _sample, drop_rejected, fit_quality_model, meta_features, quality_features, score_quality
from tests.llm.cases import documents, frame, words


def test_held_out(spark):
    rng = random.Random(12)
    rows, labels, bad = [], [], {}
    for i in range(600):
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        text = " ".join(["buy ## now"] * 20) if kind == "junk" else words(rng, rng.randrange(20, 80), 500)
        if kind == "toxic":
            text += " " + rng.choice(["vile", "scum", "idiot"])
        rows.append((i, text, "en", "farm" if kind == "junk" and rng.random() < 0.7 else "web", len(text)))
        bad[i] = kind != "good"
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = fit_quality_model(docs, marked)
    got = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    unseen = [i for i in got if i % 2 == 0]
    assert sum(got[i]["rejected"] == bad[i] for i in unseen) >= 0.93 * len(unseen)
    # the metadata view alone tells part of the junk
    farm = [got[r[0]]["meta_score"] for r in rows if r[3] == "farm"]
    assert min(farm) > max(got[r[0]]["meta_score"] for r in rows if r[3] == "web")
    kept = drop_rejected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in got.values())
    again = fit_quality_model(docs.repartition(5), marked.repartition(3))
    assert (again.text.buckets == model.text.buckets).all() and abs(again.mix - model.mix).max() < 1e-9


def test_surest_of_all_unlabelled(spark):
    """Sure documents that come late by the digest of their id still teach the other view."""
    rng = random.Random(21)
    order = [r["id"] for r in spark.range(1000, 4400).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, words(rng, 12, 60), "en", "web", 0) for i in order[:3100]]
    rows += [(i, words(rng, 12, 60) + " vile scum", "en", "den", 0) for i in order[3100:]]
    rows += [(i, words(rng, 12, 60) + (" vile scum" if i % 3 == 0 else ""), "en", "web", 0) for i in range(400)]
    marked = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = fit_quality_model(frame(spark, rows), marked)
    known = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["web", "den"], "n_chars": ["0", "0"]})
    web, den = model.meta.score(*meta_features(known), 2)
    assert den > web + 1


def test_awkward_tables(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(0, None, None), (1, 1, 0), (1, 0, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = fit_quality_model(docs, some)
        got = score_quality(docs, model)
        assert got.count() == len(documents()) and got.filter("rejected").isEmpty()
        assert score_quality(docs.limit(0), model).count() == 0
    assert fit_quality_model(docs.limit(0), labels) is not None
    assert score_quality(docs, model).filter(F.col("score").isNull()).isEmpty()


def test_one_id_on_many_rows_counts_rows(spark):
    """The bound is on rows, not on ids: many equal rows are one, many different ones are cut to the bound."""
    rows = [(7, "one text", "en", "web", 0)] * 500 + [(8, f"text {i}", "en", "web", 0) for i in range(300)] + [(i, "x y", "en", "web", 0) for i in range(20, 40)]
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)] + [(i, 1, 0) for i in range(20, 40)], "doc_id long, y int, z int")
    features = quality_features(frame(spark, rows))
    got = _sample(features, labels.select("doc_id", "y"), 50)
    assert got.count() == 50 and got.select("key").distinct().count() == 50
    assert _sample(features, labels.select("doc_id", "y"), 1000).count() == 1 + 300 + 20
