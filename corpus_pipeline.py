"""A corpus pipeline: filter, de-duplicate, decontaminate and tokenise ``documents``.

Each stage takes the documents that the one before kept, as a written table, and all but the
last return the same columns. Rows that share a ``doc_id``, or have none, are told apart by a
digest of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.bpe import bpe_round_trip
from kestrel.llm.cotrain import drop_rejected, fit_quality_model, quality_features
from kestrel.llm.countjoin import jaccard_components
from kestrel.llm.queries import TOKENIZER, table
from kestrel.llm.staging import drop_staged, stage
from kestrel.llm.substrings import remove_repeats
from kestrel.llm.winnow import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    features = quality_features(docs)
    model = fit_quality_model(docs, table(spark, sf_dir, "labels"), features=features)
    drop_staged(features)
    return drop_rejected(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near-duplicates, equal rows once."""
    first = jaccard_components(docs, with_rows=True).filter("first").select("doc_id", "row").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.row"))
    kept = docs.alias("d").join(first.alias("f"), same, "left_semi")
    return kept.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; untouched texts stay as they are."""
    done = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("whole.text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("whole.n_chars"))
    new = {"text": text, "n_chars": size}
    return done.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "row").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.row"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe_round_trip(docs, TOKENIZER, with_ids=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings),
          ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]
ORACLE_SQL = None  # the classifier is a fitted model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
