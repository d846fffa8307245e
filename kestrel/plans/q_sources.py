"""Source and sink queries: files are written from the driver tables into the
shared checkpoint folder, then read back through the operator under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import matching as M
from kestrel.plans import sqlkit as S
from kestrel.plans.q_matching import FIELDS_SQL, TERMS_SQL, business_terms, data_fields
from kestrel.plans.registry import register
from kestrel.sources import files as FS
from kestrel.sources.tables import Tables


@register("scan_csv", "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_retailprice AS price FROM part")
def q_scan_csv(t: Tables):
    """Part rows written as ';'-separated cp1250 text with a header, read back with a
    declared schema whose names replace the header's."""
    path = FS.scratch_path(t.spark, "csv")
    FS.write_csv(t.part.select("p_partkey", "p_name", "p_type", "p_retailprice"), path, ";", "cp1250")
    return FS.scan_csv(t.spark, path, "id long, name string, kind string, price double", ";", "cp1250")


@register("scan_dataset", """SELECT DISTINCT trim(unnest(string_split(m, ','))) AS data_field, e || '.' || a AS business_term
  FROM (SELECT p_type AS e, p_name AS a, string_agg(DISTINCT p_brand || '.' || p_name, ',') AS m FROM part GROUP BY 1, 2)""")
def q_scan_dataset(t: Tables):
    """Named matcher files (business terms, data fields mandatory; validation mappings
    optional, melted on load) written from ``part`` and loaded by name."""
    root = FS.scratch_path(t.spark, "dataset")
    p = t.part
    FS.write_csv(p.select(F.col("p_type").alias("entity"), F.col("p_name").alias("attribute")).distinct(),
                 f"{root}/business_terms.csv", ";")
    FS.write_csv(p.select(F.col("p_brand").alias("data_structure"), F.col("p_name").alias("data_field")).distinct(),
                 f"{root}/data_fields.csv", ";")
    maps = p.groupBy(F.col("p_type").alias("entity"), F.col("p_name").alias("attribute")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "p_brand", "p_name"))), ",").alias("mapping"))
    FS.write_csv(maps, f"{root}/data_mappings.csv", ";")
    FS.load_dataset(t.spark, root, "business_terms", "entity string, attribute string")
    FS.load_dataset(t.spark, root, "data_fields", "data_structure string, data_field string")
    assert FS.load_dataset(t.spark, root, "no_such_file", "x string", mandatory=False) is None
    return FS.load_dataset(t.spark, root, "data_mappings", "entity string, attribute string, mapping string",
                           transform=FS.melt_mappings).distinct()


@register("load_batches", """SELECT l_orderkey, l_linenumber, l_quantity, year(l_shipdate)::INTEGER AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity) AS rn FROM lineitem)
  WHERE rn = 1""")
def q_load_batches(t: Tables):
    """Lines dumped in yearly batches, all batches read back, one row per order (the first line)."""
    path = FS.scratch_path(t.spark, "batches")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate",
                           F.year("l_shipdate").alias("batch"))
    FS.dump_batches(li, path, "batch")
    out = FS.load_batches(t.spark, [path], key=["l_orderkey"], order_by=["l_linenumber", "l_shipdate", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.col("batch").cast("int").alias("batch"))


@register("dump_reload", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS batch FROM orders""")
def q_dump_reload(t: Tables):
    path = FS.scratch_path(t.spark, "dump")
    FS.dump_batches(t.orders.select("o_orderkey", "o_custkey", "o_totalprice",
                                    F.col("o_orderpriority").alias("batch")), path, "batch")
    return t.spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "batch")


def _two_algorithms(t: Tables):
    a = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 3)
    b = M.tfidf_match(data_fields(t), business_terms(t), "key", "key", 3, "word", 1, False)
    return a, b


@register("save_candidates", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, p='a_')}, {S.cosine_cte('a_')}, {S.topn_cte(3, 'a_')},
{S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, 'word', 1, False, p='b_')}, {S.cosine_cte('b_')}, {S.topn_cte(3, 'b_')}
SELECT input, rank, match, score, 'Tfidf-char_wb-3-GRAM-1' AS algorithm FROM a_top
UNION ALL SELECT input, rank, match, score, 'Tfidf-word-1-GRAM-0' FROM b_top""")
def q_save_candidates(t: Tables):
    """Two algorithms saved into one partitioned table; the first is saved twice and
    replaced in place, the second kept."""
    path = FS.scratch_path(t.spark, "candidates")
    a, b = _two_algorithms(t)
    FS.save_candidates(a, path, "Tfidf-char_wb-3-GRAM-1")
    FS.save_candidates(b, path, "Tfidf-word-1-GRAM-0")
    FS.save_candidates(a, path, "Tfidf-char_wb-3-GRAM-1")
    return FS.load_candidates(t.spark, path).select("input", "rank", "match", "score", "algorithm")


@register("model_guard", f"""WITH {S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, p='a_')}, {S.cosine_cte('a_')}, {S.topn_cte(3, 'a_')},
{S.tfidf_ctes(FIELDS_SQL, TERMS_SQL, 'word', 1, False, p='b_')}, {S.cosine_cte('b_')}, {S.topn_cte(3, 'b_')}
SELECT input, rank, match, score, 'char_wb' AS algorithm FROM a_top
UNION ALL SELECT input, rank, match, score, 'word' FROM b_top""")
def q_model_guard(t: Tables):
    """A two-algorithm model is saved; overwriting it with one algorithm is refused."""
    path = FS.scratch_path(t.spark, "model")
    a, b = _two_algorithms(t)
    both = a.withColumn("algorithm", F.lit("char_wb")).unionByName(b.withColumn("algorithm", F.lit("word")))
    FS.save_model(both, path)
    try:
        FS.save_model(a.withColumn("algorithm", F.lit("char_wb")), path)
        raise AssertionError("downgrade was not refused")
    except FS.ModelDowngrade:
        pass
    return FS.load_model(t.spark, path)


@register("flat_export", """SELECT upper(p_type || '_' || replace(p_name, ' ', '_')) AS key, count(*) AS parts,
  round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1""")
def q_flat_export(t: Tables):
    """Fields exported as one ';'-separated table, replaced by a second export, and read back with a
    declared schema."""
    path = FS.scratch_path(t.spark, "export")
    named = t.part.select(F.upper(F.concat(F.col("p_type"), F.lit("_"), F.regexp_replace("p_name", " ", "_"))).alias("key"), "p_retailprice")
    out = named.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    FS.write_csv(out.limit(0), path, ";")
    FS.write_csv(out, path, ";")
    return FS.scan_csv(t.spark, path, "key string, parts long, price double", ";")


@register("run_metrics", """WITH j AS (SELECT l_extendedprice::DOUBLE AS a, (l_quantity * p_retailprice)::DOUBLE AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT avg(abs(a - p)) AS mae, avg((a - p) * (a - p)) AS mse, sum((a - p) * (a - p)) AS sse, var_pop(a) * count(*) AS sst FROM j)
SELECT 'run-1' AS run, 'param' AS kind, name, value FROM (VALUES ('alpha', 0.0::DOUBLE), ('l1_ratio', 0.0::DOUBLE)) v(name, value)
UNION ALL SELECT 'run-1', 'metric', name, round(value, 4) FROM (SELECT unnest(['mae', 'mse', 'rmse', 'r2']) AS name,
  unnest([mae, mse, sqrt(mse), 1 - sse / sst]) AS value FROM m)""")
def q_run_metrics(t: Tables):
    """Parameters and metrics of a regression run appended to a metrics table."""
    from kestrel.operators.evaluation import regression_metrics
    path = FS.scratch_path(t.spark, "metrics")
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    m = regression_metrics(j.select(F.col("l_extendedprice").alias("a"),
                                    (F.col("l_quantity") * F.col("p_retailprice")).alias("p")), "a", "p").first()
    FS.log_metrics(t.spark, path, "run-1", {"alpha": 0.0, "l1_ratio": 0.0}, "param")
    return FS.log_metrics(t.spark, path, "run-1", {k: round(m[k], 4) for k in ("mae", "mse", "rmse", "r2")})
