"""Scorecard and evaluation queries on ``lineitem``.

Binding: one row per line; response = returned line (flag R); samples by ship year
(train up to 1998, valid 1999, test from 2000: an out-of-time split over all rows);
predictors quantity, discount, extended price, line status. Scores for the
evaluation operators without a fitted model: probability = 5 x discount; bid =
order; saved cost = price x tax; lost margin = price x discount.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import evaluation as EV
from kestrel.operators import scorecard as SC
from kestrel.plans.registry import register
from kestrel.sources.tables import Tables

SC_SQL = """sc AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, l_tax, l_linestatus,
  (l_returnflag = 'R')::INTEGER AS response,
  CASE WHEN year(l_shipdate) <= 1998 THEN 'train' WHEN year(l_shipdate) = 1999 THEN 'valid' ELSE 'test' END AS sample
  FROM lineitem)"""


def sc(t: Tables):
    y = F.year("l_shipdate")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("response"),
        F.when(y <= 1998, "train").when(y == 1999, "valid").otherwise("test").alias("sample"))


def _edges_sql(src: str, col: str, bins: int, where: str = "TRUE", group: str | None = None) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return (f"SELECT {g}list_sort(list_distinct(quantile_cont({col}::DOUBLE, [{probs}]))) AS edges "
            f"FROM {src} WHERE {where} AND {col} IS NOT NULL {gb}")


def _bin_sql(x: str) -> str:
    return f"greatest(len(list_filter(edges, lambda e: e < {x})) - 1, 0)"


@register("quantile_bins", f"""WITH {SC_SQL}, e AS ({_edges_sql('sc', 'l_extendedprice', 10)}),
b AS (SELECT l_orderkey, l_linenumber, {_bin_sql('l_extendedprice')} AS bin, edges FROM sc, e)
SELECT l_orderkey, l_linenumber, bin::INTEGER AS l_extendedprice_bin,
  round(edges[bin + 1], 2) AS l_extendedprice_bin_low, round(edges[bin + 2], 2) AS l_extendedprice_bin_upp,
  '(' || round(edges[bin + 1], 2)::VARCHAR || ', ' || round(edges[bin + 2], 2)::VARCHAR || ')' AS l_extendedprice_bin_rng
FROM b""")
def q_quantile_bins(t: Tables):
    b = SC.quantile_bins(sc(t), "l_extendedprice", 10, 2)
    return b.select("l_orderkey", "l_linenumber", *[c for c in b.columns if c.startswith("l_extendedprice_bin")])


@register("histogram_edges", f"""WITH {SC_SQL}, e AS ({_edges_sql('sc', 'l_extendedprice', 10, "sample = 'train'")}),
b AS (SELECT CASE WHEN l_extendedprice < edges[1] OR l_extendedprice > edges[-1] THEN NULL
  ELSE least(len(list_filter(edges, lambda x: x <= l_extendedprice)) - 1, len(edges) - 2) END AS bin
  FROM sc, e WHERE sample = 'test')
SELECT bin::INTEGER AS bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def q_histogram_edges(t: Tables):
    """Test prices counted on the train decile edges (left-closed, last bin closed)."""
    s = sc(t)
    e = SC.quantile_edges(s.where(F.col("sample") == "train"), "l_extendedprice", 10).select("_edges").scalar()
    return SC.histogram_edges(s.where(F.col("sample") == "test"), "l_extendedprice", e)


def _tts_sql(src: str, group: str, event: str = "event") -> str:
    return f"""SELECT coalesce({group}::VARCHAR, 'Total') AS {group},
  sum(CASE WHEN sample = 'train' THEN 1 ELSE 0 END)::BIGINT AS train_obs,
  sum(CASE WHEN sample = 'test' THEN 1 ELSE 0 END)::BIGINT AS test_obs, count(*) AS total_obs,
  coalesce(round(sum(CASE WHEN sample = 'train' THEN 1 ELSE 0 END) / count(*) * 100, 2), 0) AS train_obs_pct,
  sum(CASE WHEN sample = 'train' THEN response ELSE 0 END)::BIGINT AS train_{event},
  sum(CASE WHEN sample = 'test' THEN response ELSE 0 END)::BIGINT AS test_{event},
  sum(response)::BIGINT AS total_{event},
  coalesce(round(sum(CASE WHEN sample = 'train' THEN response ELSE 0 END) / nullif(sum(response), 0) * 100, 2), 0)
    AS train_{event}_pct,
  coalesce(round(sum(CASE WHEN sample = 'train' THEN response ELSE 0 END)
    / nullif(sum(CASE WHEN sample = 'train' THEN 1 ELSE 0 END), 0) * 100, 2), 0) AS er_train_pct,
  coalesce(round(sum(CASE WHEN sample = 'test' THEN response ELSE 0 END)
    / nullif(sum(CASE WHEN sample = 'test' THEN 1 ELSE 0 END), 0) * 100, 2), 0) AS er_test_pct,
  coalesce(round(sum(response) / count(*) * 100, 2), 0) AS er_total_pct
FROM {src} GROUP BY ROLLUP ({group})"""


@register("train_test_stats", f"WITH {SC_SQL} {_tts_sql('sc', 'l_linestatus')}")
def q_train_test_stats(t: Tables):
    return SC.train_test_stats(sc(t), "sample", "l_linestatus", "response")


@register("univariate_continuous", f"""WITH {SC_SQL},
e AS ({_edges_sql('sc', 'l_quantity', 5, 'TRUE', 'sample')}),
b AS (SELECT sc.*, {_bin_sql('l_quantity')} AS l_quantity_bin,
  '(' || round(edges[{_bin_sql('l_quantity')} + 1], 2)::VARCHAR || ', ' ||
  round(edges[{_bin_sql('l_quantity')} + 2], 2)::VARCHAR || ')' AS rng FROM sc JOIN e USING (sample)),
s AS ({_tts_sql('b', 'l_quantity_bin')}),
r AS (SELECT l_quantity_bin::VARCHAR AS l_quantity_bin, max(CASE WHEN sample = 'train' THEN rng END) AS train_rng,
  max(CASE WHEN sample = 'test' THEN rng END) AS test_rng FROM b GROUP BY 1)
SELECT s.*, r.train_rng, r.test_rng FROM s LEFT JOIN r USING (l_quantity_bin)""")
def q_univariate_continuous(t: Tables):
    return SC.univariate_continuous(sc(t), "sample", "l_quantity", "response", 5)


@register("univariate_categorical", f"""WITH {SC_SQL}, s AS ({_tts_sql('sc', 'l_quantity')})
SELECT * FROM s WHERE l_quantity = 'Total' OR total_obs >= 1250""")
def q_univariate_categorical(t: Tables):
    return SC.univariate_categorical(sc(t), "sample", "l_quantity", "response", 1250)


WOE_SQL = """g AS (SELECT l_quantity::VARCHAR AS l_quantity, count(*) AS count, sum(response)::BIGINT AS events,
  (count(*) - sum(response))::BIGINT AS non_events FROM sc WHERE sample = 'train' GROUP BY 1),
w AS (SELECT *, round(greatest(events, 0.5) / (SELECT sum(events) FROM g) * 100, 2) AS events_pct,
  round(greatest(non_events, 0.5) / (SELECT sum(non_events) FROM g) * 100, 2) AS non_events_pct,
  round(events / count * 100, 2) AS event_rate_pct FROM g)"""


@register("woe", f"""WITH {SC_SQL}, {WOE_SQL}
SELECT l_quantity, count, events, non_events, events_pct::DOUBLE AS events_pct, non_events_pct::DOUBLE AS non_events_pct,
  event_rate_pct, round(ln(non_events_pct / events_pct), 4) AS woe FROM w
UNION ALL SELECT 'Total', sum(count)::BIGINT, sum(events)::BIGINT, sum(non_events)::BIGINT,
  round(sum(events_pct)::DOUBLE, 6), round(sum(non_events_pct)::DOUBLE, 6), round(sum(events) / sum(count) * 100, 2), 0.0
FROM w""")
def q_woe(t: Tables):
    out = SC.woe(sc(t).where(F.col("sample") == "train"), "l_quantity", "response")
    return out.withColumn("events_pct", F.round("events_pct", 6)).withColumn("non_events_pct", F.round("non_events_pct", 6))


WOE_JOIN_SQL = """long AS (SELECT 'l_quantity' AS predictor, l_quantity::DOUBLE::VARCHAR AS value, response, sample FROM sc
         UNION ALL SELECT 'l_linestatus', l_linestatus, response, sample FROM sc),
g AS (SELECT predictor, value, count(*) AS n, sum(response) AS e FROM long WHERE sample = 'train' GROUP BY ALL),
w AS (SELECT predictor, value, round(ln(round(greatest(n - e, 0.5) / sum(n - e) OVER (PARTITION BY predictor) * 100, 2)
  / round(greatest(e, 0.5) / sum(e) OVER (PARTITION BY predictor) * 100, 2)), 4) AS woe FROM g),
coded AS (SELECT sc.*, wq.woe AS l_quantity_woe, ws.woe AS l_linestatus_woe FROM sc
  LEFT JOIN w wq ON wq.predictor = 'l_quantity' AND wq.value = l_quantity::DOUBLE::VARCHAR
  LEFT JOIN w ws ON ws.predictor = 'l_linestatus' AND ws.value = l_linestatus)"""


@register("woe_apply", f"""WITH {SC_SQL}, {WOE_JOIN_SQL}
SELECT l_orderkey, l_linenumber, l_quantity_woe, l_linestatus_woe FROM coded""")
def q_woe_apply(t: Tables):
    s = sc(t)
    table = SC.woe_table(s.where(F.col("sample") == "train"), ["l_quantity", "l_linestatus"], "response")
    out = SC.woe_apply(s, table, ["l_quantity", "l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity_woe", "l_linestatus_woe")


def _r12(df):
    """Shares and PSI terms rounded to 12 places (float sums differ in the last bits)."""
    for c in ("percent_sample_1", "percent_sample_2", "psi"):
        df = df.withColumn(c, F.round(c, 12))
    return df


def _psi_sql(counts: str, key: str) -> str:
    return f"""c AS ({counts}),
p AS (SELECT {key}, count_sample_1, count_sample_2,
  CASE WHEN count_sample_1 > 0 THEN count_sample_1 / (SELECT sum(count_sample_1) FROM c) END AS percent_sample_1,
  CASE WHEN count_sample_2 > 0 THEN count_sample_2 / (SELECT sum(count_sample_2) FROM c) END AS percent_sample_2 FROM c),
q AS (SELECT *, (percent_sample_1 - percent_sample_2) * ln(percent_sample_1 / percent_sample_2) AS psi FROM p)
SELECT {key}, count_sample_1, count_sample_2, round(coalesce(percent_sample_1, 0), 12) AS percent_sample_1,
  round(coalesce(percent_sample_2, 0), 12) AS percent_sample_2, round(coalesce(psi, 0), 12) AS psi FROM q
UNION ALL SELECT 'total', sum(count_sample_1)::BIGINT, sum(count_sample_2)::BIGINT,
  round(coalesce(sum(percent_sample_1), 0), 12), round(coalesce(sum(percent_sample_2), 0), 12),
  round(coalesce(sum(psi), 0), 12) FROM q"""


@register("psi_categorical", f"""WITH {SC_SQL}, {_psi_sql('''SELECT coalesce(a.v, b.v) AS l_quantity,
  coalesce(a.n, 0) AS count_sample_1, coalesce(b.n, 0) AS count_sample_2 FROM
  (SELECT l_quantity::VARCHAR AS v, count(*) AS n FROM sc WHERE sample = 'train' GROUP BY 1) a FULL JOIN
  (SELECT l_quantity::VARCHAR AS v, count(*) AS n FROM sc WHERE sample = 'test' GROUP BY 1) b ON a.v = b.v''',
                                                             'l_quantity')}""")
def q_psi_categorical(t: Tables):
    s = sc(t)
    return _r12(SC.psi_categorical(s.where(F.col("sample") == "train"), s.where(F.col("sample") == "test"),
                                   "l_quantity"))


_RNG = "'(' || round(edges[bin + 1], 2)::VARCHAR || ', ' || round(edges[bin + 2], 2)::VARCHAR || ')'"


@register("psi_continuous_joint", f"""WITH {SC_SQL},
u AS (SELECT l_extendedprice, sample FROM sc WHERE sample IN ('train', 'test')),
e AS ({_edges_sql('u', 'l_extendedprice', 10)}),
b AS (SELECT sample, {_bin_sql('l_extendedprice')} AS bin, edges FROM u, e),
r AS (SELECT {_RNG} AS l_extendedprice_bin_rng, sample FROM b),
{_psi_sql('''SELECT l_extendedprice_bin_rng, sum(CASE WHEN sample = 'train' THEN 1 ELSE 0 END)::BIGINT AS count_sample_1,
  sum(CASE WHEN sample = 'test' THEN 1 ELSE 0 END)::BIGINT AS count_sample_2 FROM r GROUP BY 1''',
          'l_extendedprice_bin_rng')}""")
def q_psi_joint(t: Tables):
    s = sc(t)
    return _r12(SC.psi_continuous(s.where(F.col("sample") == "train"), s.where(F.col("sample") == "test"),
                                  "l_extendedprice", 10, "jointly"))


@register("psi_continuous_ref", f"""WITH {SC_SQL},
e AS ({_edges_sql('sc', 'l_extendedprice', 10, "sample = 'train'")}),
b1 AS (SELECT {_bin_sql('l_extendedprice')} AS bin, edges FROM sc, e WHERE sample = 'train'),
c1 AS (SELECT bin, any_value({_RNG}) AS l_extendedprice_bin_rng, count(*) AS count_sample_1 FROM b1 GROUP BY bin),
re AS (SELECT list_transform(edges, lambda x: round(x, 2)) AS edges FROM e),
b2 AS (SELECT CASE WHEN l_extendedprice < edges[1] OR l_extendedprice > edges[-1] THEN NULL
  ELSE least(len(list_filter(edges, lambda x: x <= l_extendedprice)) - 1, len(edges) - 2) END AS bin
  FROM sc, re WHERE sample = 'test'),
c2 AS (SELECT bin, count(*) AS count_sample_2 FROM b2 WHERE bin IS NOT NULL GROUP BY bin),
{_psi_sql('''SELECT l_extendedprice_bin_rng, coalesce(count_sample_1, 0) AS count_sample_1,
  coalesce(count_sample_2, 0) AS count_sample_2 FROM c1 FULL JOIN c2 USING (bin)''', 'l_extendedprice_bin_rng')}""")
def q_psi_ref(t: Tables):
    s = sc(t)
    return _r12(SC.psi_continuous(s.where(F.col("sample") == "train"), s.where(F.col("sample") == "test"),
                                  "l_extendedprice", 10, "reference"))


def _auc_sql(src: str, group: str, score: str, label: str) -> str:
    return f"""SELECT {group}, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT {group}, s, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY s
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {group}, {score}::DOUBLE AS s, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {src}
    WHERE {score} IS NOT NULL GROUP BY ALL)) GROUP BY {group}"""


@register("somers_d", f"""WITH {SC_SQL},
l AS (SELECT sample, response, 'l_quantity' AS predictor, l_quantity::DOUBLE AS value FROM sc
  UNION ALL SELECT sample, response, 'l_discount', l_discount::DOUBLE FROM sc
  UNION ALL SELECT sample, response, 'l_extendedprice', l_extendedprice::DOUBLE FROM sc),
b AS (SELECT * FROM l UNION ALL SELECT 'total', response, predictor, value FROM l),
a AS ({_auc_sql('b', 'predictor, sample', 'value', 'response')})
SELECT predictor, max(CASE WHEN sample = 'train' THEN round(2 * auc - 1, 4) * 100 END) AS train,
  max(CASE WHEN sample = 'test' THEN round(2 * auc - 1, 4) * 100 END) AS test,
  max(CASE WHEN sample = 'total' THEN round(2 * auc - 1, 4) * 100 END) AS total FROM a GROUP BY predictor""")
def q_somers_d(t: Tables):
    return SC.somers_d(sc(t), "sample", ["l_quantity", "l_discount", "l_extendedprice"], "response")


_CORR = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]


@register("correlation_matrix", f"""WITH {SC_SQL} {' UNION ALL '.join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 12) AS corr FROM sc" for a in _CORR for b in _CORR)}""")
def q_correlation(t: Tables):
    return SC.correlation_matrix(sc(t), _CORR).withColumn("corr", F.round("corr", 12))


@register("stratified_split", f"""WITH {SC_SQL}, s AS (SELECT *, md5('42:' || (l_orderkey * 10 + l_linenumber)::VARCHAR) AS h FROM sc),
p AS (SELECT *, (row_number() OVER (PARTITION BY l_linestatus, response ORDER BY h) - 0.5)
        / count(*) OVER (PARTITION BY l_linestatus, response) AS share FROM s)
SELECT l_orderkey, l_linenumber, l_linestatus, response,
       CASE WHEN share < 0.6::DOUBLE THEN 'train' WHEN share < 0.6::DOUBLE + 0.2::DOUBLE THEN 'valid' ELSE 'test' END AS sample FROM p""")
def q_stratified_split(t: Tables):
    """60:20:20 split stratified by (line status, response), ordered by a seeded hash."""
    s = sc(t).withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return SC.stratified_split(s, ["l_linestatus", "response"], "rid", {"train": 0.6, "valid": 0.2, "test": 0.2}) \
        .select("l_orderkey", "l_linenumber", "l_linestatus", "response", "sample")


@register("user_split", """WITH u AS (SELECT DISTINCT o_custkey, md5('42:' || o_custkey::VARCHAR) AS h FROM orders),
held AS (SELECT o_custkey, row_number() OVER (ORDER BY h) AS r FROM u
         WHERE ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5)
SELECT o_orderkey, o_custkey, CASE WHEN r IS NULL THEN 'train' WHEN r <= 100 THEN 'valid' ELSE 'test' END AS split
FROM orders LEFT JOIN held USING (o_custkey)""")
def q_user_split(t: Tables):
    """Half of the customers held out; the first 100 of them (hash order) validate."""
    return SC.user_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 100)


@register("random_split", """SELECT l_orderkey, l_linenumber, CASE WHEN ('0x' || substr(md5('42:' || l_orderkey::VARCHAR || ':'
  || l_linenumber::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.75 THEN 'train' ELSE 'test' END AS part FROM lineitem""")
def q_random_split(t: Tables):
    """75:25 random split of the lines, labelled."""
    a, b = SC.random_split(t.lineitem.select("l_orderkey", "l_linenumber"), [0.75, 0.25], ["l_orderkey", "l_linenumber"], 42)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@register("impute_train_mean", """WITH d AS (SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang, coalesce(quality::DOUBLE, (SELECT avg(quality) FROM d WHERE lang = 'en')) AS quality,
  coalesce(toxic::DOUBLE, (SELECT avg(toxic) FROM d WHERE lang = 'en')) AS toxic FROM d""")
def q_impute(t: Tables):
    """Unlabelled documents get the label means of the English (train) documents."""
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left") \
        .withColumn("quality", F.col("quality").cast("double")).withColumn("toxic", F.col("toxic").cast("double"))
    return SC.impute_train_mean(d, ["quality", "toxic"], "lang", "en")


@register("standardize", f"""WITH {SC_SQL}, m AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
  avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM sc WHERE sample = 'train')
SELECT l_orderkey, l_linenumber, sample, round((l_quantity - mq) / sq, 9) AS l_quantity,
  round((l_extendedprice - mp) / sp, 9) AS l_extendedprice FROM sc, m""")
def q_standardize(t: Tables):
    s = sc(t).select("l_orderkey", "l_linenumber", "sample", "l_quantity", "l_extendedprice")
    out = SC.standardize(s, ["l_quantity", "l_extendedprice"], "sample")
    return out.withColumn("l_quantity", F.round("l_quantity", 9)).withColumn("l_extendedprice", F.round("l_extendedprice", 9))


@register("monotone_fold", f"""WITH {SC_SQL}, e AS ({_edges_sql('sc', 'l_discount', 10)}),
b AS (SELECT response, {_bin_sql('l_discount')} AS bin, edges FROM sc, e),
r AS (SELECT bin, avg(response) AS er, any_value((round(edges[bin + 1], 10) + round(edges[bin + 2], 10)) / 2) AS mid
      FROM b GROUP BY bin),
c AS (SELECT arg_max(mid, (er, -bin)) AS c FROM r)
SELECT l_orderkey, l_linenumber, abs(l_discount - c) AS l_discount_fold FROM sc, c""")
def q_monotone_fold(t: Tables):
    """Discount folded around the mid-point of its decile with the highest return rate."""
    out = SC.monotone_fold(sc(t), "l_discount", "response", 10, "up")
    return out.select("l_orderkey", "l_linenumber", "l_discount_fold")


@register("cost_features", f"""WITH {SC_SQL}, {WOE_JOIN_SQL.replace("sample = 'train'", "sample = 'train' AND value <> 'F' AND value <> '7.0'")}
SELECT l_orderkey, l_linenumber, coalesce(l_quantity_woe, 0) AS quantity_code, coalesce(l_linestatus_woe, 0) AS status_code,
  coalesce(abs(l_discount - 0.05), 0) AS l_discount_c_abs,
  CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS l_tax_flag, coalesce(pow(l_quantity, 2), 0) AS l_quantity_sq FROM coded""")
def q_cost_features(t: Tables):
    """WOE recodes of quantity and status from the training sample (a status and a quantity that it
    leaves out count as 0), then absolute, flag and square."""
    s = sc(t).withColumn("l_discount_c", F.col("l_discount") - 0.05)
    train = s.where(F.col("sample") == "train")
    tables = [SC.woe_table(train.where(F.col(c).cast("string") != out), [c], "response") for c, out in (("l_linestatus", "F"), ("l_quantity", "7.0"))]
    coded = SC.woe_apply(s, tables[0].unionByName(tables[1]), ["l_quantity", "l_linestatus"])
    out = SC.cost_features(coded, {"l_quantity_woe": "quantity_code", "l_linestatus_woe": "status_code"}, ["l_discount_c"], ["l_tax"], ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "quantity_code", "status_code", "l_discount_c_abs", "l_tax_flag", "l_quantity_sq")


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------
SCORED_SQL = SC_SQL + """, sr AS (SELECT l_orderkey AS bid, l_discount * 5 AS prob, response,
  l_extendedprice * l_tax AS saved, l_extendedprice * l_discount AS lost,
  CASE WHEN sample = 'train' THEN 'TRAIN' ELSE 'TEST' END AS sample_id FROM sc),
bids AS (SELECT sample_id, bid, max(lost) AS lost, sum(saved) AS saved, round(sum(prob), 6) AS prob, max(response) AS response
  FROM sr GROUP BY sample_id, bid)"""


def scored_rows(t: Tables):
    s = sc(t)
    return s.select(F.col("l_orderkey").alias("bid"), (F.col("l_discount") * 5).alias("prob"), "response",
                    (F.col("l_extendedprice") * F.col("l_tax")).alias("saved"),
                    (F.col("l_extendedprice") * F.col("l_discount")).alias("lost"),
                    F.when(F.col("sample") == "train", "TRAIN").otherwise("TEST").alias("sample_id"))


def bids(t: Tables):
    """Bid level; the summed probability is rounded to 6 places so threshold ties do not
    depend on the order of a floating-point sum."""
    b = EV.score_rollup(scored_rows(t), "bid", "prob", "response", "lost", "saved", group_cols=["sample_id"])
    return b.withColumn("prob", F.round("prob", 6))


@register("confusion", f"""WITH {SCORED_SQL} SELECT response AS actual,
  CASE WHEN prob > 0.25 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM sr GROUP BY ALL""")
def q_confusion(t: Tables):
    return EV.confusion(scored_rows(t), "response", "prob", 0.25)


@register("class_report", f"""WITH {SCORED_SQL},
c AS (SELECT sum(CASE WHEN response = 1 AND prob > 0.25 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN response = 0 AND prob > 0.25 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN response = 0 AND prob <= 0.25 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN response = 1 AND prob <= 0.25 THEN 1 ELSE 0 END) AS fn FROM sr),
k AS (SELECT tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0,
  (tp + fn) AS s1, (tn + fp) AS s0, tp + fp + tn + fn AS n, (tp + tn) / (tp + fp + tn + fn) AS acc FROM c),
f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0 FROM k)
SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0::BIGINT AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1::BIGINT FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n::BIGINT FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n::BIGINT FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n::BIGINT FROM f""")
def q_class_report(t: Tables):
    return EV.class_report(scored_rows(t), "response", "prob", 0.25)


@register("roc_curve", f"""WITH {SCORED_SQL},
d AS (SELECT prob::DOUBLE AS threshold, sum(response) AS p, sum(1 - response) AS n FROM sr GROUP BY 1)
SELECT threshold, sum(n) OVER w / (SELECT sum(n) FROM d) AS fpr, sum(p) OVER w / (SELECT sum(p) FROM d) AS tpr
FROM d WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_roc_curve(t: Tables):
    return EV.roc_curve(scored_rows(t), "response", "prob")


@register("auroc", f"""WITH {SCORED_SQL}, a AS ({_auc_sql('sr', 'sample_id', 'prob', 'response')})
SELECT sample_id, round(auc, 4) AS auroc, round(2 * round(auc, 4) - 1, 4) AS somers_d FROM a""")
def q_auroc(t: Tables):
    return EV.auroc(scored_rows(t), "response", "prob", ["sample_id"])


@register("score_rollup", f"""WITH {SCORED_SQL} SELECT sample_id, bid, round(lost, 6) AS lost, round(saved, 6) AS saved,
  round(prob, 6) AS prob, response FROM bids""")
def q_score_rollup(t: Tables):
    b = bids(t)
    return b.select("sample_id", "bid", F.round("lost", 6).alias("lost"), F.round("saved", 6).alias("saved"),
                    F.round("prob", 6).alias("prob"), "response")


def _perf_sql(t: float) -> str:
    return f"""p AS (SELECT sample_id, count(*) AS count, sum(response)::BIGINT AS events, sum(saved) AS total_cost,
  sum(CASE WHEN prob > {t} AND response = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN prob > {t} AND response = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN prob <= {t} AND response = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN prob <= {t} AND response = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
  sum(CASE WHEN prob > {t} AND response = 1 THEN saved ELSE 0 END) AS saved_cost,
  sum(CASE WHEN prob > {t} AND response = 0 THEN lost ELSE 0 END) AS lost_margin FROM bids GROUP BY sample_id)"""


@register("model_performance", f"""WITH {SCORED_SQL}, {_perf_sql(0.5)},
a AS (SELECT sample_id, round(auc, 4) AS auroc FROM ({_auc_sql('bids', 'sample_id', 'prob', 'response')})),
r AS (SELECT p.*, auroc, round(2 * auroc - 1, 4) AS somers_d FROM p LEFT JOIN a USING (sample_id)),
al AS (SELECT * FROM r UNION ALL SELECT 'TOTAL', sum(count)::BIGINT, sum(events)::BIGINT, sum(total_cost),
  sum(tp)::BIGINT, sum(fp)::BIGINT, sum(tn)::BIGINT, sum(fn)::BIGINT, sum(saved_cost), sum(lost_margin), avg(auroc),
  round(2 * avg(auroc) - 1, 4) FROM r)
SELECT 0.5::DOUBLE AS threshold, sample_id, count, events, round(events * 100.0 / count, 2) AS event_rate,
  round(total_cost, 2) AS total_cost, tp, fp, tn, fn, round(fp / (tp + 1), 2) AS fp_tp, auroc, somers_d,
  round(saved_cost, 2) AS saved_cost, round(lost_margin, 2) AS lost_margin,
  round(saved_cost - lost_margin, 2) AS net_savings FROM al""")
def q_model_performance(t: Tables):
    return EV.model_performance(bids(t), "sample_id", "prob", "response", "saved", "lost", 0.5)


THRESHOLDS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5]


def _sweep_sql() -> str:
    parts = []
    for th in THRESHOLDS:
        for grp, label in (("sample_id", "sample_id"), ("'TOTAL'", "'TOTAL'")):
            gb = "GROUP BY sample_id" if grp == "sample_id" else ""
            parts.append(f"""SELECT {label} AS sample_id, {th}::DOUBLE AS threshold,
  sum(CASE WHEN prob > {th} AND response = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN prob > {th} AND response = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN prob <= {th} AND response = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN prob <= {th} AND response = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
  round(sum(CASE WHEN prob > {th} AND response = 1 THEN saved ELSE 0 END), 2) AS saved_cost,
  round(sum(CASE WHEN prob > {th} AND response = 0 THEN lost ELSE 0 END), 2) AS lost_margin FROM bids {gb}""")
    return f"""WITH {SCORED_SQL}, s AS ({' UNION ALL '.join(parts)})
SELECT *, round(saved_cost - lost_margin, 2) AS net_savings FROM s"""


@register("threshold_sweep", _sweep_sql())
def q_threshold_sweep(t: Tables):
    return EV.threshold_sweep(bids(t), "sample_id", "prob", "response", "saved", "lost", THRESHOLDS)


@register("threshold_shortlist", _sweep_sql().replace("SELECT *, round(saved_cost - lost_margin, 2) AS net_savings FROM s",
                                                       """, n AS (SELECT *, round(saved_cost - lost_margin, 2) AS net_savings FROM s)
SELECT * FROM n WHERE threshold IN (SELECT threshold FROM n WHERE sample_id = 'TOTAL' AND net_savings > 0)"""))
def q_threshold_shortlist(t: Tables):
    sw = EV.threshold_sweep(bids(t), "sample_id", "prob", "response", "saved", "lost", THRESHOLDS)
    return EV.threshold_shortlist(sw, "sample_id", 0.0)


@register("cost_evaluation", """WITH o AS (SELECT o_orderpriority,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax ELSE 0 END) AS actual,
  sum(l_discount * 5 * l_extendedprice * l_tax) AS estimated
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)
SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) AS count,
  sum(CASE WHEN actual > 0 THEN 1 ELSE 0 END)::BIGINT AS count_actual,
  sum(CASE WHEN estimated > 0 THEN 1 ELSE 0 END)::BIGINT AS count_estimated,
  round(sum(actual), 2) AS sum_actual, round(sum(estimated), 2) AS sum_estimated,
  round(sum(actual) / count(*) * 100, 2) AS mean_actual_pct, round(sum(estimated) / count(*) * 100, 2) AS mean_estimated_pct,
  round((sum(estimated) - sum(actual)) / sum(actual) * 100, 2) AS diff_pct
FROM o GROUP BY ROLLUP (o_orderpriority)""")
def q_cost_evaluation(t: Tables):
    """Per order: actual cost of returned lines vs probability-weighted estimate, by priority."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    o = j.groupBy("o_orderkey", "o_orderpriority").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * F.col("l_tax")).otherwise(0.0))
        .alias("actual"),
        F.sum(F.col("l_discount") * 5 * F.col("l_extendedprice") * F.col("l_tax")).alias("estimated"))
    return EV.cost_evaluation(o, "o_orderpriority", "actual", "estimated")


@register("regression_metrics", """WITH r AS (SELECT l_extendedprice AS actual, l_quantity * p_retailprice AS pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT round(sum(pred), 4) AS sum_pred, round(sum(pred - actual), 4) AS sum_error, avg(abs(pred - actual)) AS mae,
  avg((pred - actual) * (pred - actual)) AS mse, sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
  1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) AS r2 FROM r""")
def q_regression_metrics(t: Tables):
    """Extended price against list price x quantity."""
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")) \
        .select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"))
    out = EV.regression_metrics(j, "actual", "pred")
    return out.withColumn("sum_pred", F.round("sum_pred", 4)).withColumn("sum_error", F.round("sum_error", 4))


@register("logit_fit_stats", f"""WITH {SCORED_SQL}, p AS (SELECT response, 0.05 + prob * 0.8 AS p FROM sr)
SELECT sum(response * ln(p) + (1 - response) * ln(1 - p)) AS llf,
  2 * 1 - 2 * sum(response * ln(p) + (1 - response) * ln(1 - p)) AS aic,
  1 - sum(response * ln(p) + (1 - response) * ln(1 - p)) /
    (count(*) * (avg(response) * ln(avg(response)) + (1 - avg(response)) * ln(1 - avg(response)))) AS prsquared FROM p""")
def q_logit_fit_stats(t: Tables):
    """Fit statistics of the discount-based score (mapped into (0, 1)) as a 1-parameter model."""
    s = scored_rows(t).withColumn("p", 0.05 + F.col("prob") * 0.8)
    return EV.logit_fit_stats(s, "response", "p", 1)
