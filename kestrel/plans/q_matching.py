"""Glossary-matching queries on the driver tables.

Binding: data fields are ``p_brand.p_name``, business terms ``p_type.p_name``
(distinct, from ``part``); entities are nation and region names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import matching as M
from kestrel.plans import sqlkit as S
from kestrel.plans.registry import register
from kestrel.sources.tables import Tables

FIELDS_SQL = "SELECT concat_ws('.', p_brand, p_name) AS key FROM part"
TERMS_SQL = "SELECT concat_ws('.', p_type, p_name) AS key FROM part"


def data_fields(t: Tables):
    return t.part.select(F.concat_ws(".", "p_brand", "p_name").alias("key"))


def business_terms(t: Tables):
    return t.part.select(F.concat_ws(".", "p_type", "p_name").alias("key"))


@register("tfidf_match", S.tfidf_match_sql(FIELDS_SQL, TERMS_SQL, 5))
def tfidf_match(t: Tables):
    """Flagship: top-5 TF-IDF (char_wb 3-gram, stemmer on) candidates per data field."""
    return M.tfidf_match(data_fields(t), business_terms(t), "key", "key", ncandidates=5)


# ---- text-distance ranking (inputs and terms as normalised keys) ----------
from kestrel.functions import distance as DI  # noqa: E402

NK_FIELDS_SQL = f"SELECT {S.norm_key('p_brand', 'p_name')} AS key FROM part"
NK_TERMS_SQL = f"SELECT {S.norm_key('p_type', 'p_name')} AS key FROM part"


def nk_fields(t: Tables):
    return M.normalize_key(t.part, "p_brand", "p_name")


def nk_terms(t: Tables):
    return M.normalize_key(t.part, "p_type", "p_name")


def _textdist(algorithm: str, ngrams: int = 1):
    def run(t: Tables):
        return M.textdist_match(nk_fields(t), nk_terms(t), "key", "key", algorithm, ngrams, 5)
    return run


_DIST_KEYS = {
    "dist_hamming": "Hamming", "dist_levenshtein": "Levenshtein", "dist_damerau": "DamerauLevenshtein",
    "sim_jaro": "Jaro", "sim_jaro_winkler": "JaroWinkler", "sim_strcmp95": "StrCmp95",
    "sim_needleman_wunsch": "NeedlemanWunsch", "sim_gotoh": "Gotoh", "sim_smith_waterman": "SmithWaterman",
    "sim_overlap": "Overlap", "sim_cosine": "Cosine", "sim_jaccard": "Jaccard", "sim_tversky": "Tversky",
    "sim_sorensen": "Sorensen",
}
for _key, _algo in _DIST_KEYS.items():
    _sql = None
    if _algo in S.TOKEN_FORMULA or _algo in S.EDIT_SQL:
        _sql = S.textdist_sql(NK_FIELDS_SQL, NK_TERMS_SQL, _algo, _algo in DI.REVERSE)
    register(_key, _sql)(_textdist(_algo))

register("textdist_match", S.textdist_sql(NK_FIELDS_SQL, NK_TERMS_SQL, "JaroWinkler", True))(
    _textdist("JaroWinkler"))


# ---- tokens, weights, catalogs ---------------------------------------------
from kestrel.functions import text as TX  # noqa: E402

FIELDS_D = "(SELECT DISTINCT concat_ws('.', p_brand, p_name) AS key FROM part)"


def fields_distinct(t: Tables):
    return data_fields(t).distinct()


@register("slugify", f"SELECT key, {S.slug('key')} AS slugified FROM {FIELDS_D}")
def q_slugify(t: Tables):
    return fields_distinct(t).select("key", TX.slugify("key").alias("slugified"))


@register("stem_tokens", f"SELECT key, {S.stem(S.slug('key'))} AS stemmed FROM {FIELDS_D}")
def q_stem(t: Tables):
    return fields_distinct(t).select("key", TX.stem(TX.slugify("key")).alias("stemmed"))


def _tok_sql(expr: str) -> str:
    return (f"SELECT key, term, count(*) AS n FROM (SELECT key, unnest({expr}) AS term FROM "
            f"(SELECT key, {S.slug('key')} AS txt FROM {FIELDS_D})) GROUP BY key, term")


def _tok(analyzer: str, n: int):
    def run(t: Tables):
        f = fields_distinct(t).select("key", TX.slugify("key").alias("text"))
        return M.gram_counts_table(f, "key", TX.analyzer_ngrams(F.col("text"), analyzer, n)) \
            .withColumnRenamed("gram", "term")
    return run


register("tokens_word", _tok_sql(S.grams("txt", "word", 2)))(_tok("word", 2))
register("tokens_char", _tok_sql(S.grams("txt", "char", 3)))(_tok("char", 3))
register("tokens_char_wb", _tok_sql(S.grams("txt", "char_wb", 3)))(_tok("char_wb", 3))


@register("tfidf_weights", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}
SELECT side, key, term, round(weight, 9) AS weight FROM wn""")
def q_tfidf_weights(t: Tables):
    docs = M.match_documents(data_fields(t), business_terms(t), "key", "key", True)
    return M.tfidf_weights(docs).withColumn("weight", F.round("weight", 9))


@register("tfidf_cosine", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}, {S.cosine_cte()}
SELECT input, match, score FROM cos""")
def q_tfidf_cosine(t: Tables):
    docs = M.match_documents(data_fields(t), business_terms(t), "key", "key", True)
    return M.sparse_cosine(M.tfidf_weights(docs))


@register("topn_candidates", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, 'word', 1, False)}, {S.cosine_cte()},
{S.topn_cte(3)}
SELECT inp.key AS input, top.rank, top.match, top.score FROM inp LEFT JOIN top ON inp.key = top.input""")
def q_topn_candidates(t: Tables):
    """Word unigrams, no stemmer, top 3; inputs without any candidate keep a null row."""
    cand = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 3, "word", 1, False)
    allin = fields_distinct(t).select(F.col("key").alias("input"))
    return allin.join(cand, "input", "left").select("input", "rank", "match", "score")


@register("matrix_stats", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}
SELECT (SELECT count(*) FROM docs) AS n_rows, count(DISTINCT term) AS n_features, count(*) AS nnz,
       count(*) / ((SELECT count(*) FROM docs) * count(DISTINCT term)) AS density FROM wn""")
def q_matrix_stats(t: Tables):
    docs = M.match_documents(data_fields(t), business_terms(t), "key", "key", True)
    return M.matrix_stats(docs, M.tfidf_weights(docs))


@register("mapping_response", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}, {S.cosine_cte()}, {S.topn_cte(5)}
SELECT 'data_field' AS input_type, 'business_term' AS match_type, inp.key AS input_string,
       coalesce(list(top.match ORDER BY top.rank) FILTER (WHERE top.match IS NOT NULL), []::VARCHAR[]) AS match_strings,
       coalesce(list(top.score ORDER BY top.rank) FILTER (WHERE top.match IS NOT NULL), []::DOUBLE[]) AS match_similarities
FROM inp LEFT JOIN top ON inp.key = top.input GROUP BY inp.key""")
def q_mapping_response(t: Tables):
    cand = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 5)
    return M.mapping_response(cand, data_fields(t), "key")


@register("tfidf_match_one", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}, {S.cosine_cte()}, {S.topn_cte(5)}
SELECT input, rank, match, score FROM top WHERE input = (SELECT min(input) FROM top)""")
def q_tfidf_match_one(t: Tables):
    """Lookup of one data field (the smallest one having candidates) after the full model."""
    cand = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 5)
    first = cand.agg(F.min("input")).first()[0]
    return M.lookup_one(cand, first)


@register("data_fields", """SELECT DISTINCT concat_ws('.', n_name, s_name) AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_data_fields(t: Tables):
    """Structure = nation, field = supplier."""
    return M.dotted_names(t.nation, t.supplier, "n_nationkey", "s_nationkey", "n_name", "s_name")


@register("business_terms", """SELECT DISTINCT concat_ws('.', n_name, r_name) AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_business_terms(t: Tables):
    """Attribute = customer, entity = nation, definition = region (through the nation's region key)."""
    c = t.customer.join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.three_way_names(c, t.nation.select("n_nationkey", "n_name").withColumnRenamed("n_nationkey", "e_key"),
                             t.region, "c_nationkey", "e_key", "n_regionkey", "r_regionkey", "n_name", "r_name")


@register("distinct_names", "SELECT DISTINCT n_name AS name FROM nation")
def q_distinct_names(t: Tables):
    return M.distinct_names(t.nation, "n_name")


CATALOG_SQL = f"""WITH a AS (SELECT DISTINCT key AS raw FROM ({FIELDS_SQL})),
b AS (SELECT DISTINCT key AS raw FROM ({TERMS_SQL}) WHERE key NOT IN (SELECT raw FROM a)),
c AS (SELECT (row_number() OVER (ORDER BY raw) - 1) AS idx, raw FROM a
      UNION ALL SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY raw) - 1 AS idx, raw FROM b)
SELECT idx, raw, {S.slug('raw')} AS slugified FROM c"""


@register("catalog_add", CATALOG_SQL)
def q_catalog_add(t: Tables):
    """Catalog of data fields, then business terms added with continuing indexes."""
    cat = M.string_catalog(data_fields(t), "key")
    return M.catalog_add(cat, business_terms(t), "key")


@register("catalog_get", f"SELECT idx, raw FROM ({CATALOG_SQL}) WHERE idx = 7")
def q_catalog_get(t: Tables):
    cat = M.catalog_add(M.string_catalog(data_fields(t), "key"), business_terms(t), "key")
    return M.catalog_get(cat, 7)


# ---- validation against truth: the business term of the same part ----------
TRUTH_SQL = ("SELECT concat_ws('.', p_brand, p_name) AS input, "
             "list_sort(list(DISTINCT concat_ws('.', p_type, p_name))) AS truth FROM part GROUP BY 1")


def truth(t: Tables):
    pairs = t.part.select(F.concat_ws(".", "p_brand", "p_name").alias("k"),
                          F.concat_ws(".", "p_type", "p_name").alias("v"))
    return M.truth_sets(pairs, "k", "v")


@register("truth_sets", TRUTH_SQL)
def q_truth_sets(t: Tables):
    return truth(t)


@register("mapping_report", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL)}, {S.cosine_cte()}, {S.topn_cte(5)},
tr AS ({TRUTH_SQL}),
hits AS (SELECT top.input, min(rank) AS best FROM top JOIN tr ON top.input = tr.input
         WHERE list_contains(tr.truth, top.match) GROUP BY top.input)
SELECT inp.key AS data_field,
  max(CASE WHEN top.rank = 1 THEN top.match END) AS business_term_1,
  max(CASE WHEN top.rank = 2 THEN top.match END) AS business_term_2,
  max(CASE WHEN top.rank = 3 THEN top.match END) AS business_term_3,
  max(CASE WHEN top.rank = 4 THEN top.match END) AS business_term_4,
  max(CASE WHEN top.rank = 5 THEN top.match END) AS business_term_5,
  CASE WHEN any_value(tr.truth) IS NOT NULL AND
       coalesce(list_contains(any_value(tr.truth), max(CASE WHEN top.rank = 1 THEN top.match END)), false)
       THEN 1 ELSE 0 END AS exact_match,
  CASE WHEN any_value(tr.truth) IS NOT NULL THEN coalesce(any_value(hits.best), 0) ELSE 0 END::INTEGER AS top_n_match,
  CASE WHEN any_value(tr.truth) IS NOT NULL THEN 1 ELSE 0 END AS is_validation,
  array_to_string(any_value(tr.truth), ', ') AS ground_truth
FROM inp LEFT JOIN top ON inp.key = top.input LEFT JOIN tr ON inp.key = tr.input
LEFT JOIN hits ON inp.key = hits.input GROUP BY inp.key""")
def q_mapping_report(t: Tables):
    cand = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 5)
    return M.mapping_report(cand, data_fields(t), "key", truth(t), 5)


_VARIANTS = [("Tfidf-char_wb", "3", "1", "char_wb", 3, True), ("Tfidf-char", "3", "0", "char", 3, False),
             ("Tfidf-word", "1", "0", "word", 1, False)]


def _validation_sql() -> str:
    ctes, unions = [], []
    for i, (name, ng, st, an, n, stem_) in enumerate(_VARIANTS):
        p = f"v{i}_"
        ctes.append(S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, an, n, stem_, True, p))
        ctes.append(S.cosine_cte(p))
        ctes.append(S.topn_cte(5, p))
        unions.append(f"SELECT '{name}' AS algorithm, '{ng}' AS ngrams, '{st}' AS stemmer, input, rank, match "
                      f"FROM {p}top")
    return f"""WITH {', '.join(ctes)}, tr AS ({TRUTH_SQL}),
cand AS ({' UNION ALL '.join(unions)}),
h AS (SELECT algorithm, ngrams, stemmer, cand.input,
             max(CASE WHEN rank = 1 AND list_contains(truth, match) THEN 1 ELSE 0 END) AS e,
             max(CASE WHEN list_contains(truth, match) THEN 1 ELSE 0 END) AS h
      FROM cand JOIN tr ON cand.input = tr.input GROUP BY ALL),
agg AS (SELECT algorithm, ngrams, stemmer, sum(e) AS exact, sum(h) AS topn FROM h GROUP BY ALL),
al AS (SELECT DISTINCT algorithm, ngrams, stemmer FROM cand)
SELECT al.algorithm, al.ngrams, al.stemmer,
       coalesce(exact, 0) / (SELECT count(*) FROM tr) AS exact_match_rate,
       coalesce(topn, 0) / (SELECT count(*) FROM tr) AS top_n_match_rate,
       (SELECT count(*) FROM tr) AS data_fields, 5 AS ncandidates
FROM al LEFT JOIN agg USING (algorithm, ngrams, stemmer)"""


@register("mapping_validation", _validation_sql())
def q_mapping_validation(t: Tables):
    parts = []
    for name, ng, st, an, n, stem_ in _VARIANTS:
        c = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 5, an, n, stem_)
        parts.append(c.select(F.lit(name).alias("algorithm"), F.lit(ng).alias("ngrams"), F.lit(st).alias("stemmer"),
                              "input", "rank", "match"))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    return M.mapping_validation(cand, truth(t), 5)


# ---- bag of words on the text tables ----------------------------------------
@register("bow_counts", f"""WITH w AS (SELECT doc_id AS key, {S.word_tokens('text', 1)} AS w FROM documents),
t AS (SELECT key, unnest(w) AS term FROM w
      UNION ALL SELECT key, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term FROM w WHERE len(w) > 1)
SELECT key, term, count(*) AS n FROM t GROUP BY key, term""")
def q_bow_counts(t: Tables):
    """Word uni- and bi-grams (tokens of one or more word characters) per document."""
    return M.bow_counts(t.documents, "doc_id", "text", (1, 2), 1)


@register("fixed_vocab_tfidf", f"""WITH v AS (SELECT DISTINCT unnest({S.word_tokens('text')}) AS term FROM benchmark),
c AS (SELECT doc_id AS key, term, count(*) AS n FROM (SELECT doc_id, unnest({S.word_tokens('text')}) AS term
      FROM documents) WHERE term IN (SELECT term FROM v) GROUP BY ALL),
d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term),
w AS (SELECT key, c.term, n * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS w
      FROM c JOIN d ON c.term = d.term)
SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 9) AS weight FROM w""")
def q_fixed_vocab(t: Tables):
    """Vocabulary = words of the benchmark passages; corpus = documents."""
    bench_words = t.benchmark.select(F.explode(TX.word_tokens(F.col("text"))).alias("w"))
    out = M.fixed_vocab_tfidf(t.documents, "doc_id", "text", bench_words, "w")
    return out.withColumn("weight", F.round("weight", 9))


@register("tfidf_unsmoothed", f"""WITH c AS (SELECT conv_id * 1000 + turn AS key, term, count(*) AS n FROM (
   SELECT conv_id, turn, unnest({S.word_tokens('text')}) AS term FROM conversations) GROUP BY ALL),
d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term),
w AS (SELECT key, c.term, n * (ln((SELECT count(*) FROM conversations) / df) + 1) AS w FROM c JOIN d ON c.term = d.term)
SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 9) AS weight FROM w""")
def q_tfidf_unsmoothed(t: Tables):
    """Word unigram TF-IDF with idf = ln(N/df) + 1 over conversation turns."""
    conv = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    counts = M.bow_counts(conv, "key", "text", (1, 1), 2)
    n_docs = conv.select(F.count(F.lit(1)).cast("double")).scalar()
    return M.counts_tfidf(counts, n_docs, smooth_idf=False).withColumn("weight", F.round("weight", 9))


@register("char_ngrams", f"""SELECT p_partkey AS key, gram, count(*) AS n FROM (
  SELECT p_partkey, unnest({S.windows("regexp_replace(p_name || ' ' || p_brand, '[,./-]|\\sBD', '', 'g')", 3)}) AS gram
  FROM part) GROUP BY ALL""")
def q_char_ngrams(t: Tables):
    """Cleaned character 3-grams of each part's name and brand."""
    return M.gram_counts_table(t.part, "p_partkey",
                               TX.cleaned_char_ngrams(F.concat_ws(" ", "p_name", "p_brand"), 3))


@register("qgram_sequences", f"""SELECT key, gram, count(*) AS n FROM (
  SELECT key, unnest({S.windows("key", 2)}) AS gram FROM (SELECT DISTINCT key FROM ({NK_FIELDS_SQL}))) GROUP BY ALL""")
def q_qgram_sequences(t: Tables):
    """q = 2 character grams of the normalised data-field keys (q = 0 words, 1 characters)."""
    return M.gram_counts_table(nk_fields(t), "key", TX.qgrams(F.col("key"), 2))


@register("normalize_key", f"SELECT DISTINCT key FROM ({NK_FIELDS_SQL})")
def q_normalize_key(t: Tables):
    return nk_fields(t)


# Keywords that mark a field as personal data.
GDPR_KEYWORDS = ["ADDRESS", "NAME", "EMAIL", "BIRTH", "PHONE", "SURNAME", "SALARY"]


@register("gdpr_fields", f"""SELECT key FROM (SELECT DISTINCT upper(p_type || '_' || replace(p_name, ' ', '_')) AS key
  FROM part) WHERE regexp_matches(key, '{'|'.join(GDPR_KEYWORDS)}')""")
def q_gdpr_fields(t: Tables):
    fields = t.part.select(F.upper(F.concat(F.col("p_type"), F.lit("_"),
                                            F.regexp_replace("p_name", " ", "_"))).alias("key")).distinct()
    return M.keyword_fields(fields, "key", GDPR_KEYWORDS)
