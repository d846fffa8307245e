"""Text normalisation, tokenisation and TF-IDF matching on small hand-computed fixtures."""

from pyspark.sql import functions as F

from kestrel.functions import text as T
from kestrel.operators import matching as M


def _one(spark, col):
    return spark.createDataFrame([("x",)], "d string").select(col.alias("v")).first()["v"]


def test_slugify_and_stem(spark):
    df = spark.createDataFrame([("ACC_NO",), ("CUST.BIRTH_DT",), ("Écoute--l'été 1,000",)], "raw string")
    out = {r.raw: r.s for r in df.select("raw", T.stem(T.slugify("raw")).alias("s")).collect()}
    assert out["ACC_NO"] == "account no"
    assert out["CUST.BIRTH_DT"] == "customer birth date"
    assert df.select(T.slugify(F.lit("Écoute--l'été 1,000")).alias("s")).first().s == "ecoute l ete 1000"


def test_stemmer_table_is_consistent():
    pairs = T.stem_pairs()
    variants = [v for v, _ in pairs]
    assert len(variants) == len(set(variants))
    assert ("fva", "market value") in pairs and ("eur", " ") in pairs
    assert "ast" not in variants


def test_char_wb_short_words(spark):
    assert _one(spark, T.char_wb_ngrams(F.lit("zz q"), 3)) == [" zz", "zz ", " q "]


def test_char_and_word_ngrams(spark):
    assert _one(spark, T.char_ngrams(F.lit("ab  cd"), 3)) == ["ab ", "b c", " cd"]
    assert _one(spark, T.word_ngrams(F.lit("The cat, a dog"), 2)) == ["the cat", "cat dog"]
    assert _one(spark, T.word_ngrams(F.lit("a"), 2)) == []


def test_cleaned_char_ngrams(spark):
    assert _one(spark, T.cleaned_char_ngrams(F.lit("a-b.c BD"), 3)) == ["abc"]


def test_tfidf_match_golden(spark):
    inputs = spark.createDataFrame([("ACC_NO",), ("CUST.BIRTH_DT",), ("ZZ_Q",)], "k string")
    terms = spark.createDataFrame([("Account.Number",), ("Customer.Birth Date",), ("Rate",)], "k string")
    got = M.tfidf_match(inputs, terms, "k", "k", 5).orderBy("input", "rank").collect()
    res = {}
    for r in got:
        res.setdefault(r.input, []).append((r.match, r.score))
    assert res["ACC_NO"] == [("Account.Number", 0.5695)]
    assert res["CUST.BIRTH_DT"] == [("Customer.Birth Date", 1.0), ("Rate", 0.1692), ("Account.Number", 0.0456)]
    assert "ZZ_Q" not in res
    resp = {r.input_string: r.match_strings for r in M.mapping_response(M.tfidf_match(inputs, terms, "k", "k", 5),
                                                                         inputs, "k").collect()}
    assert resp["ZZ_Q"] == []


def test_lookup_one_raises(spark):
    import pytest
    inputs = spark.createDataFrame([("ACC_NO",), ("ZZ_Q",)], "k string")
    terms = spark.createDataFrame([("Account.Number",)], "k string")
    cand = M.tfidf_match(inputs, terms, "k", "k", 5)
    assert M.lookup_one(cand, "ACC_NO").count() == 1
    with pytest.raises(M.StringNotFound):
        M.lookup_one(cand, "ZZ_Q")


def test_catalog_dense_index(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", "c", "a", None]], "s string")
    cat = M.string_catalog(df, "s")
    assert [(r.idx, r.raw) for r in cat.orderBy("idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    more = M.catalog_add(cat, spark.createDataFrame([("d",), ("a",), ("aa",)], "s string"), "s")
    assert [(r.idx, r.raw) for r in more.orderBy("idx").collect()][-2:] == [(3, "aa"), (4, "d")]
