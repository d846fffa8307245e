"""Spark results equal the DuckDB reference SQL on the smallest data (a selection by
default; KESTREL_ORACLE_ALL=1 checks every key)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["tfidf_match", "mapping_response", "dist_levenshtein", "sim_jaccard", "txn_rollup", "conversion", "rfm",
        "rfm_asof", "merge_intervals", "quantile_bins", "woe", "psi_continuous_ref", "somers_d", "threshold_sweep",
        "model_performance", "item_cosine", "daily_interpolate", "decompose_classical", "ljung_box", "avg_rank_pct"]
KEYS = sorted(E.oracle_sql()) if os.environ.get("KESTREL_ORACLE_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    ok, msg = compare(spark, SF, key, con)
    assert ok, msg
