"""Glossary matching: string catalogs, TF-IDF cosine and text-distance candidate ranking.

Every function maps DataFrames to a DataFrame. Documents are identified by
(``side``, ``key``) where side is ``"i"`` for inputs and ``"m"`` for matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import text as T
from kestrel.operators import nearest as N
from kestrel.operators.indexing import dense_index
from kestrel.session import cut_lineage


class StringNotFound(Exception):
    """Raised when a single-input lookup has no candidates."""


# ---------------------------------------------------------------------------
# String catalog
# ---------------------------------------------------------------------------

def string_catalog(df: DataFrame, col: str) -> DataFrame:
    """De-duplicated strings with a dense index in sorted order and their slug."""
    base = df.select(F.col(col).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return dense_index(base, ["raw"]).select("idx", "raw", T.slugify("raw").alias("slugified"))


def catalog_add(catalog: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Append strings not yet present; new indexes continue after the current maximum."""
    fresh = new.select(F.col(col).alias("raw")).where(F.col("raw").isNotNull()).distinct() \
        .join(catalog.select("raw"), "raw", "left_anti")
    start = catalog.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("s")).first()["s"]
    added = dense_index(fresh, ["raw"], start=int(start)).select("idx", "raw", T.slugify("raw").alias("slugified"))
    return catalog.select("idx", "raw", "slugified").unionByName(added)


def catalog_get(catalog: DataFrame, idx: int) -> DataFrame:
    return catalog.where(F.col("idx") == F.lit(idx)).select("idx", "raw")


# ---------------------------------------------------------------------------
# Tokens, TF-IDF weights, cosine, top-n
# ---------------------------------------------------------------------------

def prepare_text(raw: Column, use_stemmer: bool) -> Column:
    slug = T.slugify(raw)
    return T.stem(slug) if use_stemmer else slug


def match_documents(inputs: DataFrame, matches: DataFrame, input_col: str, match_col: str,
                    use_stemmer: bool = False) -> DataFrame:
    """One document per distinct input string and per distinct match string (no de-dup
    across the two sets): columns side, key, text."""
    i = inputs.select(F.col(input_col).alias("key")).where(F.col("key").isNotNull()).distinct() \
        .select(F.lit("i").alias("side"), "key")
    m = matches.select(F.col(match_col).alias("key")).where(F.col("key").isNotNull()).distinct() \
        .select(F.lit("m").alias("side"), "key")
    return i.unionByName(m).withColumn("text", prepare_text(F.col("key"), use_stemmer))


def term_counts(docs: DataFrame, analyzer: str = "char_wb", ngrams: int = 3) -> DataFrame:
    """(side, key, term, tf) raw term counts per document."""
    return docs.select("side", "key", F.explode(T.analyzer_ngrams(F.col("text"), analyzer, ngrams)).alias("term")) \
        .groupBy("side", "key", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_weights(docs: DataFrame, analyzer: str = "char_wb", ngrams: int = 3,
                  smooth_idf: bool = True) -> DataFrame:
    """L2-normalised TF-IDF weights (side, key, term, weight).

    idf = ln((1+N)/(1+df)) + 1 when smoothed, ln(N/df) + 1 otherwise; N counts
    every document, including those without terms. N is a scalar subquery, so the
    whole computation stays one lazy plan.
    """
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    tf = term_counts(docs, analyzer, ngrams)
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = (F.log((n_docs + 1) / (F.col("df") + 1)) + 1) if smooth_idf else (F.log(n_docs / F.col("df")) + 1)
    w = tf.join(dfreq, "term").withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("side", "key")))
    return w.select("side", "key", "term", (F.col("w") / norm).alias("weight"))


def matrix_stats(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows, features, stored values and density of the document-term matrix."""
    n_rows = docs.select(F.count(F.lit(1))).scalar()
    feats = weights.agg(F.countDistinct("term").alias("n_features"), F.count(F.lit(1)).alias("nnz"))
    return feats.select(
        n_rows.alias("n_rows"), "n_features", "nnz",
        (F.col("nnz") / (n_rows * F.col("n_features"))).alias("density"))


def weight_vectors(weights: DataFrame) -> DataFrame:
    """One row per document: (side, key, terms, weights)."""
    listed = weights.groupBy("side", "key").agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    return listed.select("side", "key", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"))


def sparse_cosine(weights: DataFrame) -> DataFrame:
    """(input, match, score) for every pair sharing a term; score rounded to 4 places, > 0."""
    a = weights.where(F.col("side") == "i").select(F.col("key").alias("input"), "term", F.col("weight").alias("wi"))
    b = weights.where(F.col("side") == "m").select(F.col("key").alias("match"), "term", F.col("weight").alias("wm"))
    dot = a.join(b, "term").groupBy("input", "match").agg(F.sum(F.col("wi") * F.col("wm")).alias("dot"))
    return dot.select("input", "match", F.round("dot", 4).alias("score")).where(F.col("score") > 0)


def top_n(pairs: DataFrame, n: int, key: str = "input", item: str = "match", score: str = "score",
          descending: bool = True) -> DataFrame:
    """Keep the n best ``item`` per ``key``; ties broken by item ascending. Adds ``rank``."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(key).orderBy(order, F.col(item).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tfidf_match(inputs: DataFrame, matches: DataFrame, input_col: str, match_col: str, ncandidates: int = 5,
                analyzer: str = "char_wb", ngrams: int = 3, use_stemmer: bool = True,
                smooth_idf: bool = True) -> DataFrame:
    """Top-n TF-IDF cosine candidates: (input, rank, match, score)."""
    docs = match_documents(inputs, matches, input_col, match_col, use_stemmer)
    # both sides of the search read the vectors: materialise them once (reliable
    # checkpoint) instead of recomputing tokens, document frequencies and norms per side
    vectors = cut_lineage(weight_vectors(tfidf_weights(docs, analyzer, ngrams, smooth_idf)))
    sides = [vectors.where(F.col("side") == s).drop("side") for s in ("i", "m")]
    found = N.nearest(*sides, F.size("terms"), N.cosine_index, ncandidates)
    pairs = found.select("input", "match", F.round("score", 4).alias("score")).where("match IS NOT NULL AND score > 0")
    return top_n(pairs, ncandidates).select("input", "rank", "match", "score")


def mapping_response(candidates: DataFrame, inputs: DataFrame, input_col: str,
                     input_type: str = "data_field", match_type: str = "business_term") -> DataFrame:
    """Nested result per input: ordered match strings and similarities (empty when none)."""
    allin = inputs.select(F.col(input_col).alias("input")).where(F.col("input").isNotNull()).distinct()
    grouped = candidates.groupBy("input").agg(
        F.array_sort(F.collect_list(F.struct("rank", "match", "score"))).alias("c"))
    j = allin.join(grouped, "input", "left")
    c = F.coalesce(F.col("c"), F.array().cast("array<struct<rank:int,match:string,score:double>>"))
    return j.select(
        F.lit(input_type).alias("input_type"), F.lit(match_type).alias("match_type"),
        F.col("input").alias("input_string"),
        F.transform(c, lambda x: x["match"]).alias("match_strings"),
        F.transform(c, lambda x: x["score"]).alias("match_similarities"))


def lookup_one(candidates: DataFrame, input_string: str) -> DataFrame:
    """Single-input lookup; the input is filtered after the full model is computed.
    An unknown input, or one without candidates, raises ``StringNotFound``."""
    out = candidates.where(F.col("input") == F.lit(input_string))
    if out.isEmpty():
        raise StringNotFound(f"no candidates for {input_string!r}")
    return out


# ---------------------------------------------------------------------------
# Text-distance candidate ranking
# ---------------------------------------------------------------------------

def normalize_key(df: DataFrame, parent: str, child: str, name: str = "key") -> DataFrame:
    """``parent.child`` with blanks turned into ``_``, lower-cased, distinct."""
    k = F.lower(F.concat(F.regexp_replace(F.col(parent), " ", "_"), F.lit("."),
                         F.regexp_replace(F.col(child), " ", "_")))
    return df.select(k.alias(name)).where(F.col(name).isNotNull()).distinct()


def _keys(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("key")).where(F.col("key").isNotNull()).distinct()


def _block_match(inputs: DataFrame, terms: DataFrame, algorithm: str, ngrams: int, n: int, block_size: int) -> DataFrame:
    """(input, match, score): the best of every block of terms, for measures that nothing bounds."""
    from kestrel.functions import distance as DI
    desc = algorithm in DI.REVERSE
    chunks = max(1, -(-terms.count() // block_size))
    blocks = terms.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks))) \
        .groupBy("chunk").agg(F.collect_list("key").alias("terms"))
    met = inputs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(blocks, "chunk")
    scored = F.zip_with(DI.block_scores_udf(algorithm, ngrams)(F.col("key"), F.col("terms")), F.col("terms"),
                        lambda s, t: F.struct((-F.round(s, 4) if desc else F.round(s, 4)).alias("k"), t.alias("term")))
    return met.select("key", F.explode(F.slice(F.sort_array(scored), 1, n)).alias("c")) \
        .select(F.col("key").alias("input"), F.col("c.term").alias("match"), (-F.col("c.k") if desc else F.col("c.k")).alias("score"))


def textdist_match(inputs: DataFrame, terms: DataFrame, input_col: str, term_col: str, algorithm: str,
                   ngrams: int = 1, ncandidates: int = 5, block_size: int = 4096, with_work: bool = False) -> DataFrame:
    """Rank every term for every input by ``algorithm``; keep the best ``ncandidates``.

    Scores are rounded to 4 places and ranked ascending for distances, descending for
    similarities, ties by term. Gram measures and, over characters, Levenshtein and
    Hamming search an index per shard of terms (``operators.nearest``) that leaves out what
    cannot be among the best; the other measures score blocks of ``block_size`` terms.
    ``with_work`` returns (input, scored) instead: how many pairs were scored for an input.
    """
    from kestrel.functions import distance as DI
    if algorithm not in DI.FEASIBLE:
        raise ValueError(f"unknown measure {algorithm!r}; known: {', '.join(sorted(DI.FEASIBLE))}")
    desc = algorithm in DI.REVERSE
    inp, term = _keys(inputs, input_col), _keys(terms, term_col)
    if algorithm in DI.TOKEN:
        inp, term = (cut_lineage(d.withColumn("terms", DI.gram_tags(F.col("key"), ngrams))) for d in (inp, term))
        found = N.nearest(inp, term, F.size("terms") + 1, N.gram_index(algorithm), ncandidates)
    elif algorithm in ("Hamming", "Levenshtein") and ngrams == 1:
        inp, term = cut_lineage(inp), cut_lineage(term)
        found = N.nearest(inp, term, F.length("key") + 1, N.edit_index(algorithm == "Levenshtein"), ncandidates, shard_load=N.STRING_LOAD)
    else:
        inp, term = cut_lineage(inp), cut_lineage(term)
        found = _block_match(inp, term, algorithm, ngrams, ncandidates, block_size).withColumn("scored", F.lit(None).cast("long"))
    if with_work:
        return found.groupBy("input").agg(F.sum("scored").alias("scored"))
    found = found.where(F.col("match").isNotNull()).select("input", "match", F.round("score", 4).alias("score"))
    return top_n(found, ncandidates, descending=desc).select("input", "rank", "match", "score")


# ---------------------------------------------------------------------------
# Metadata extraction (joins of structure/field and entity/definition tables)
# ---------------------------------------------------------------------------

def dotted_names(parent: DataFrame, child: DataFrame, parent_key: str, child_fk: str,
                 parent_name: str, child_name: str) -> DataFrame:
    """Distinct ``parent.child`` names over an inner equi-join."""
    j = child.join(parent, child[child_fk] == parent[parent_key], "inner")
    return j.select(F.concat_ws(".", parent[parent_name], child[child_name]).alias("name")).distinct()


def three_way_names(attribute: DataFrame, entity: DataFrame, definition: DataFrame,
                    attr_entity_fk: str, entity_key: str, attr_def_fk: str, def_key: str,
                    entity_name: str, def_name: str) -> DataFrame:
    """Distinct ``entity.definition`` names over attribute ⋈ entity ⋈ definition.
    Entity and definition tables are dimension-sized; Catalyst/AQE broadcast them."""
    j = attribute.join(entity, attribute[attr_entity_fk] == entity[entity_key], "inner") \
        .join(definition, attribute[attr_def_fk] == definition[def_key], "inner")
    return j.select(F.concat_ws(".", entity[entity_name], definition[def_name]).alias("name")).distinct()


def distinct_names(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()


# ---------------------------------------------------------------------------
# Validation against set-valued ground truth
# ---------------------------------------------------------------------------

def truth_sets(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, truth: sorted distinct array) from (key, value) rows."""
    return pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()) \
        .groupBy(F.col(key).alias("input")).agg(F.array_sort(F.collect_set(value)).alias("truth"))


def mapping_report(candidates: DataFrame, inputs: DataFrame, input_col: str, truth: DataFrame,
                   ncandidates: int) -> DataFrame:
    """Wide report: candidate columns, exact flag, best truth rank (0 when none), validation flag."""
    allin = inputs.select(F.col(input_col).alias("input")).where(F.col("input").isNotNull()).distinct()
    wide = candidates.groupBy("input").pivot("rank", list(range(1, ncandidates + 1))).agg(F.first("match"))
    for r in range(1, ncandidates + 1):
        wide = wide.withColumnRenamed(str(r), f"business_term_{r}")
    hits = candidates.join(truth, "input").where(F.array_contains("truth", F.col("match"))) \
        .groupBy("input").agg(F.min("rank").alias("best"))
    out = allin.join(wide, "input", "left").join(truth, "input", "left").join(hits, "input", "left")
    labelled = F.col("truth").isNotNull()
    return out.select(
        F.col("input").alias("data_field"),
        *[F.col(f"business_term_{r}") for r in range(1, ncandidates + 1)],
        F.when(labelled & F.coalesce(F.array_contains("truth", F.col("business_term_1")), F.lit(False)), 1)
         .otherwise(0).alias("exact_match"),
        F.when(labelled, F.coalesce(F.col("best"), F.lit(0))).otherwise(0).cast("int").alias("top_n_match"),
        F.when(labelled, 1).otherwise(0).alias("is_validation"),
        F.array_join("truth", ", ").alias("ground_truth"))


def mapping_validation(candidates: DataFrame, truth: DataFrame, ncandidates: int) -> DataFrame:
    """Exact@1 and any@n rates per algorithm over all labelled inputs.

    ``candidates`` carries ``algorithm``, ``ngrams``, ``stemmer`` columns; one shuffle
    aggregates every algorithm at once.
    """
    algos = candidates.select("algorithm", "ngrams", "stemmer").distinct()
    hits = candidates.join(truth, "input") \
        .groupBy("algorithm", "ngrams", "stemmer", "input").agg(
            F.max(F.when((F.col("rank") == 1) & F.array_contains("truth", F.col("match")), 1).otherwise(0)).alias("e"),
            F.max(F.when(F.array_contains("truth", F.col("match")), 1).otherwise(0)).alias("h")) \
        .groupBy("algorithm", "ngrams", "stemmer").agg(F.sum("e").alias("exact"), F.sum("h").alias("topn"))
    total = truth.select(F.count(F.lit(1))).scalar()
    return algos.join(hits, ["algorithm", "ngrams", "stemmer"], "left").select(
        "algorithm", "ngrams", "stemmer",
        (F.coalesce(F.col("exact"), F.lit(0)) / total).alias("exact_match_rate"),
        (F.coalesce(F.col("topn"), F.lit(0)) / total).alias("top_n_match_rate"),
        total.alias("data_fields"), F.lit(ncandidates).alias("ncandidates"))


# ---------------------------------------------------------------------------
# Bag-of-words and n-gram counts
# ---------------------------------------------------------------------------

TERMS_PER_TASK = 1 << 20


def dealt_by_key(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """Rows dealt by key to as many tasks as keep the sum of ``terms``, the terms a row is counted for, to about
    ``TERMS_PER_TASK``: a task's table of counts stays the same size however many rows there are."""
    total = df.agg(F.sum(terms)).first()[0] or 0
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism if total > TERMS_PER_TASK else 1, int(total // TERMS_PER_TASK) + 1), F.col(key))


def bow_counts(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 2),
               min_token_len: int = 1) -> DataFrame:
    """(key, term, count) for word n-grams with n in ``ngram_range``: tokens by a regex,
    n-grams of two or more words by Spark ML's ``NGram`` (JVM, one pass per n). The texts are
    dealt out by key first, so what is shuffled is each text once, not its n-grams."""
    from pyspark.ml.feature import NGram
    tok = dealt_by_key(df.select(key, text), key, F.length(text) / 4 * (ngram_range[1] - ngram_range[0] + 1)).select(F.col(key).alias("key"), T.word_tokens(F.col(text), min_token_len).alias("_g1"))
    cols = []
    for n in range(ngram_range[0], ngram_range[1] + 1):
        if n > 1:
            tok = NGram(n=n, inputCol="_g1", outputCol=f"_g{n}").transform(tok)
        cols.append(f"_g{n}")
    return tok.select("key", F.explode(F.concat(*cols)).alias("term")) \
        .groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))


def counts_tfidf(counts: DataFrame, n_docs: Column, smooth_idf: bool = True) -> DataFrame:
    """TF-IDF from (key, term, n) counts; idf smoothed or not, rows L2-normalised."""
    dfreq = counts.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = (F.log((n_docs + 1) / (F.col("df") + 1)) + 1) if smooth_idf else (F.log(n_docs / F.col("df")) + 1)
    w = counts.join(dfreq, "term").withColumn("w", F.col("n") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return w.select("key", "term", (F.col("w") / norm).alias("weight"))


def fixed_vocab_tfidf(df: DataFrame, key: str, text: str, vocabulary: DataFrame, vocab_col: str) -> DataFrame:
    """Counts restricted to a vocabulary (semi-join, vocabulary is small) followed by smoothed TF-IDF.
    Documents are all rows of ``df``, including those without any vocabulary word."""
    vocab = vocabulary.select(F.col(vocab_col).alias("term")).distinct()
    counts = bow_counts(df, key, text, (1, 1), 2).join(vocab, "term", "left_semi")
    n_docs = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return counts_tfidf(counts, n_docs, True)


def gram_counts_table(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """(key, gram, count); rows are dealt by key before their grams are listed."""
    rows = df.select(F.col(key).alias("key"), grams.alias("_g"))
    return dealt_by_key(rows, "key", F.greatest(F.size("_g"), F.lit(1))).select("key", F.explode("_g").alias("gram")) \
        .groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))


def keyword_fields(df: DataFrame, col: str, keywords: list[str]) -> DataFrame:
    """Rows whose ``col`` contains any keyword (case-sensitive)."""
    import re
    return df.where(F.col(col).rlike("|".join(re.escape(k) for k in keywords)))
