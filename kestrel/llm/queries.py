"""The operators bound to the driver tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import sql
from kestrel.llm.bpe import bpe_round_trip
from kestrel.llm.cascade import BASE, quality_cascade
from kestrel.llm.cotrain import fit_quality_model, quality_features, score_quality
from kestrel.llm.countjoin import jaccard_components
from kestrel.llm.huffman import token_index, write_token_ids
from kestrel.llm.lengths import length_histogram, token_lengths
from kestrel.llm.licenses import scan_licenses
from kestrel.llm.periodic import periodic_runs, repeat_tails, run_digest
from kestrel.llm.repair import damaged, repair_digest
from kestrel.llm.simhash import simhash_components
from kestrel.llm.staging import staging_path
from kestrel.llm.substrings import removal_digest, remove_repeats
from kestrel.llm.urlrules import filter_urls
from kestrel.llm.winnow import contamination_digest, decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: URL rules (action, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))


def query(key: str, oracle: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_index(spark, path)


@query("op2_substring_dedup", sql.SUBSTRING)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), TOKENIZER))


@query("op4_jaccard_join", sql.JACCARD)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_decontamination", sql.DECONTAMINATION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op7_url_filter", sql.URLS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@query("op8_quality_rules", sql.QUALITY)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = quality_features(docs)
    return score_quality(docs, fit_quality_model(docs, table(spark, sf_dir, "labels"), features=features), features=features)


@query("op11_conversation_repair", sql.REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_digest(rows, damaged(rows))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(repeat_tails(table(spark, sf_dir, "documents"))))
