"""Scalar, join, aggregate, set and window operators bound to the driver tables.

Bindings (the domain of each operator mapped onto the TPC-H-like tables):
items = lineitem ⋈ orders ⋈ part (transaction = order, product = part, category =
part type, sample item = a line sold without discount, event = returned line);
transactions = the E3 roll-up of items; customers' country = nation name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import aggregate as A
from kestrel.operators import relational as R
from kestrel.operators import windows as W
from kestrel.plans.registry import register
from kestrel.sources.tables import Tables

# ---------------------------------------------------------------------------
# shared frames (Spark) and their SQL twins
# ---------------------------------------------------------------------------
ITEMS_SQL = """items AS (SELECT l_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate::DATE AS order_date,
  l_partkey AS product_id, p_type AS category, l_extendedprice AS amount, l_discount = 0 AS is_sample,
  l_returnflag = 'R' AS event
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
TXN_SQL = ITEMS_SQL + """,
txn AS (SELECT transaction_id, customer_id, order_date,
  sum(CASE WHEN NOT is_sample THEN 1 ELSE 0 END)::BIGINT AS products,
  sum(CASE WHEN is_sample THEN 1 ELSE 0 END)::BIGINT AS samples,
  round(sum(amount), 2) AS amount,
  coalesce(list_sort(list(DISTINCT category) FILTER (WHERE NOT is_sample)), []::VARCHAR[]) AS category_product,
  coalesce(list_sort(list(DISTINCT category) FILTER (WHERE is_sample)), []::VARCHAR[]) AS category_sample,
  max(event::INTEGER) AS event
  FROM items GROUP BY transaction_id, customer_id, order_date)"""
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def items(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_type")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
                    F.to_date("o_orderdate").alias("order_date"), F.col("l_partkey").alias("product_id"),
                    F.col("p_type").alias("category"), F.col("l_extendedprice").alias("amount"),
                    (F.col("l_discount") == 0).alias("is_sample"), (F.col("l_returnflag") == "R").alias("event"))


def txn(t: Tables):
    return A.txn_rollup(items(t)).withColumn("amount", F.round("amount", 2))


# ---------------------------------------------------------------------------
# B: projections and scalar features
# ---------------------------------------------------------------------------
@register("wrangle_chain", """SELECT l_orderkey, l_linenumber, l_extendedprice, qty, discount_flag FROM (
  SELECT *, l_quantity AS qty, CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 1 ELSE 0 END AS discount_flag
  FROM lineitem) WHERE qty > 45 AND discount_flag = 1""")
def q_wrangle(t: Tables):
    """rename quantity, flag high discount and tax, keep large flagged lines, sort by price."""
    return R.wrangle_chain(t.lineitem, {"l_quantity": "qty"}, "discount_flag",
                           (F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.04),
                           (F.col("qty") > 45) & (F.col("discount_flag") == 1),
                           [F.col("l_extendedprice").desc()],
                           ["l_orderkey", "l_linenumber", "l_extendedprice", "qty", "discount_flag"])


@register("dotted_name", """SELECT s_suppkey, concat_ws('.', n_name, s_name) AS dotted
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_dotted(t: Tables):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.concat_ws(".", "n_name", "s_name").alias("dotted"))


@register("not_prefix", "SELECT p_partkey, p_type FROM part WHERE NOT starts_with(p_type, 'ECO')")
def q_not_prefix(t: Tables):
    return R.not_prefix(t.part.select("p_partkey", "p_type"), "p_type", "ECO")


@register("date_from_parts", """SELECT o_orderkey,
  make_date(substr(s, 7, 4)::INTEGER, substr(s, 4, 2)::INTEGER, substr(s, 1, 2)::INTEGER) AS trigger_date
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS s FROM orders)""")
def q_date_from_parts(t: Tables):
    """Orders' timestamps written as dd.mm.yyyy hh:mm text, parsed back by position."""
    s = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("s"))
    return s.select("o_orderkey", R.date_from_parts("s").alias("trigger_date"))


@register("ratio_cols", """SELECT l_orderkey, count(*) AS records,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS passed_records,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS failed_records,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) / count(*) AS passed_records_pct,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS failed_records_pct
  FROM lineitem GROUP BY l_orderkey""")
def q_ratio_cols(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("passed_records"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("failed_records"))
    return g.withColumn("passed_records_pct", R.ratio("passed_records", "records")) \
        .withColumn("failed_records_pct", R.ratio("failed_records", "records"))


@register("filter_isin", """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
  WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F'""")
def q_filter_isin(t: Tables):
    return t.lineitem.where(F.col("l_returnflag").isin("R", "A") & (F.col("l_linestatus") == "F")) \
        .select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@register("exclusion_share", f"""WITH {TXN_SQL}
SELECT sum(CASE WHEN k THEN 1 ELSE 0 END) / count(*) AS share_rows,
       sum(CASE WHEN k THEN event ELSE 0 END) / sum(event) AS share_events,
       count(*) AS rows, sum(CASE WHEN k THEN 1 ELSE 0 END)::BIGINT AS rows_kept
FROM (SELECT *, samples < 2 AND products < 7 AS k FROM txn)""")
def q_exclusion_share(t: Tables):
    x = txn(t)
    return R.exclusion_share(x, (F.col("samples") < 2) & (F.col("products") < 7), "event")


@register("bucket_other", f"""WITH {TXN_SQL},
c AS (SELECT transaction_id, n_name FROM txn JOIN customer ON customer_id = c_custkey
      JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT n_name FROM c GROUP BY n_name HAVING count(*) < (SELECT count(*) FROM c) * 0.035)
SELECT transaction_id, CASE WHEN n_name IN (SELECT n_name FROM r) THEN 'OT' ELSE n_name END AS country_id FROM c""")
def q_bucket_other(t: Tables):
    """Countries with fewer than 3.5 % of the transactions merged into OT."""
    c = txn(t).join(t.customer, F.col("customer_id") == F.col("c_custkey")) \
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("transaction_id", "n_name")
    return R.rare_to_other(c, "n_name", 0.035, out="country_id").select("transaction_id", "country_id")


# Amount band edges and labels.
BAND_EDGES = [750, 1000, 1250, 1750]
BAND_LABELS = ["<0.75K", "<1.00K", "<1.25K", "<1.75K", ">1.75K"]


@register("amount_band", """SELECT p_partkey, CASE WHEN p_retailprice < 750 THEN '<0.75K'
  WHEN p_retailprice < 1000 THEN '<1.00K' WHEN p_retailprice < 1250 THEN '<1.25K'
  WHEN p_retailprice < 1750 THEN '<1.75K' ELSE '>1.75K' END AS amount_grp FROM part""")
def q_amount_band(t: Tables):
    return t.part.select("p_partkey", R.bands("p_retailprice", BAND_EDGES, BAND_LABELS).alias("amount_grp"))


@register("recode", f"""WITH {TXN_SQL}
SELECT transaction_id, CASE WHEN products IN (3, 4, 5) THEN 4 ELSE products END AS products_adj,
       CASE WHEN samples = 0 THEN 1 ELSE 0 END AS flg_zero_samples FROM txn""")
def q_recode(t: Tables):
    return txn(t).select("transaction_id", R.recode_values("products", [3, 4, 5], 4).alias("products_adj"),
                         R.zero_flag("samples").alias("flg_zero_samples"))


@register("array_size", f"""WITH {TXN_SQL}
SELECT transaction_id, len(category_product)::INTEGER AS categories_product,
       len(category_sample)::INTEGER AS categories_sample FROM txn""")
def q_array_size(t: Tables):
    return txn(t).select("transaction_id", F.size("category_product").alias("categories_product"),
                         F.size("category_sample").alias("categories_sample"))


@register("array_flags", f"""WITH {TXN_SQL}
SELECT transaction_id, {', '.join(f"list_contains(category_product, '{c}') AS {c.lower()}_in_product, "
                                 f"list_contains(category_sample, '{c}') AS {c.lower()}_in_sample"
                                 for c in CATEGORIES)} FROM txn""")
def q_array_flags(t: Tables):
    x = txn(t)
    cols = []
    for c in CATEGORIES:
        cols += R.array_flags("category_product", [c], "product") + R.array_flags("category_sample", [c], "sample")
    return x.select("transaction_id", *cols)


@register("array_overlap", f"""WITH {TXN_SQL}
SELECT transaction_id, coalesce(list_has_any(category_sample, category_product), false) AS smpl_cat_in_prod_cat,
       list_sort(list_intersect(category_sample, category_product)) AS shared FROM txn""")
def q_array_overlap(t: Tables):
    return txn(t).select("transaction_id",
                         R.array_overlap("category_sample", "category_product").alias("smpl_cat_in_prod_cat"),
                         F.array_sort(F.array_intersect("category_sample", "category_product")).alias("shared"))


@register("array_string", f"""WITH {TXN_SQL}
SELECT transaction_id,
  '[' || array_to_string(list_transform(category_product, lambda x: '''' || x || ''''), ', ') || ']' AS category_product_str,
  '[' || array_to_string(list_transform(category_sample, lambda x: '''' || x || ''''), ', ') || ']' AS category_sample_str
FROM txn""")
def q_array_string(t: Tables):
    return txn(t).select("transaction_id", R.array_string("category_product").alias("category_product_str"),
                         R.array_string("category_sample").alias("category_sample_str"))


@register("date_parts", """SELECT l_orderkey, l_linenumber, monthname(o_orderdate) AS order_month,
  dayname(o_orderdate) AS order_day, month(o_orderdate)::INTEGER AS order_month_id,
  (isodow(o_orderdate) - 1)::INTEGER AS order_day_id, year(o_orderdate)::INTEGER AS order_year,
  date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS ship_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_date_parts(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", *R.date_parts("o_orderdate", "order"),
                    F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("ship_days"))


@register("null_default", """SELECT doc_id, coalesce(quality, 9999) AS quality, coalesce(toxic, 0) AS toxic,
  coalesce(lang, 'NA') AS lang FROM documents LEFT JOIN labels USING (doc_id)""")
def q_null_default(t: Tables):
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(9999)).alias("quality"),
                    F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("lang", F.lit("NA")).alias("lang"))


@register("boxcox", """SELECT o_orderkey, round(ln(o_totalprice), 9) AS bc_0, round((pow(o_totalprice, 0.5) - 1) / 0.5, 9) AS bc_half,
  round(pow(((pow(o_totalprice, 0.5) - 1) / 0.5) * 0.5 + 1, 2.0), 6) AS inv_half FROM orders""")
def q_boxcox(t: Tables):
    o = t.orders
    bc = R.boxcox("o_totalprice", 0.5)
    return o.select("o_orderkey", F.round(R.boxcox("o_totalprice", 0), 9).alias("bc_0"), F.round(bc, 9).alias("bc_half"),
                    F.round(R.inv_boxcox(bc, 0.5), 6).alias("inv_half"))


@register("boxcox_lambda", """WITH y AS (SELECT o_orderpriority, o_totalprice::DOUBLE AS y, round(i * 0.01::DOUBLE - 2.0::DOUBLE, 6) AS lmbda
  FROM orders, range(401) g(i) WHERE o_totalprice > 0),
a AS (SELECT o_orderpriority, lmbda, count(*) AS n, sum(ln(y)) AS sl,
  var_pop(CASE WHEN lmbda = 0 THEN ln(y) ELSE (pow(y, lmbda) - 1) / lmbda END) AS v FROM y GROUP BY ALL),
l AS (SELECT *, -(n / 2.0::DOUBLE) * ln(v) + (lmbda - 1) * sl AS llf FROM a)
SELECT o_orderpriority, max_by(lmbda, llf) AS lmbda, round(max(llf), 3) AS llf FROM l GROUP BY o_orderpriority""")
def q_boxcox_lambda(t: Tables):
    """Box-Cox lambda of order totals per priority (maximum likelihood on a 0.01 grid)."""
    return R.boxcox_lambda(t.orders, "o_totalprice", ["o_orderpriority"]).withColumn("llf", F.round("llf", 3))


@register("unpivot", """SELECT l_orderkey, l_linenumber, variable, value FROM (
  UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount,
                  l_tax::DOUBLE AS l_tax FROM lineitem)
  ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value)""")
def q_unpivot(t: Tables):
    return R.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@register("category_order", """SELECT category, (row_number() OVER (ORDER BY d, k) - 1) AS ord FROM (
  SELECT '#' || o_orderpriority || '#' AS category, min(o_orderdate) AS d,
         arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1)""")
def q_category_order(t: Tables):
    """Priorities ordered by their first appearance in (date, order key) order."""
    o = t.orders.select("o_orderpriority", F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"))
    return R.category_order(o, "o_orderpriority", ["d", "k"], "ord", prefix="#")


# ---------------------------------------------------------------------------
# C: joins
# ---------------------------------------------------------------------------
@register("left_lookup", """SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_left_lookup(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = R.left_lookup(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"])
    return R.left_lookup(j, n, ["c_nationkey"]).select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")


@register("outer_dist", """WITH a AS (SELECT l_returnflag AS v, count(*) AS n1 FROM lineitem WHERE year(l_shipdate) < 1999 GROUP BY 1),
b AS (SELECT l_returnflag AS v, count(*) AS n2 FROM lineitem WHERE year(l_shipdate) >= 1999 GROUP BY 1)
SELECT coalesce(a.v, b.v) AS v, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM a FULL OUTER JOIN b ON a.v = b.v""")
def q_outer_dist(t: Tables):
    li = t.lineitem
    a = li.where(F.year("l_shipdate") < 1999).groupBy(F.col("l_returnflag").alias("v")).agg(F.count(F.lit(1)).alias("n1"))
    b = li.where(F.year("l_shipdate") >= 1999).groupBy(F.col("l_returnflag").alias("v")).agg(F.count(F.lit(1)).alias("n2"))
    j = a.join(b, "v", "full")
    return j.select("v", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))


@register("semi_mapped", """SELECT o_orderkey, o_custkey FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def q_semi(t: Tables):
    m = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return R.semi_mapped(t.orders.select("o_orderkey", "o_custkey"), m, ["o_custkey"])


@register("anti_unmapped", """SELECT o_orderkey, o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def q_anti(t: Tables):
    m = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return R.anti_unmapped(t.orders.select("o_orderkey", "o_custkey"), m, ["o_custkey"])


CAMPAIGNS_SQL = """camp AS (SELECT p_partkey AS sample_id, p_size AS campaign_id,
  DATE '1995-01-01' + INTERVAL (p_size * 45) DAY AS start_date,
  DATE '1995-01-01' + INTERVAL (p_size * 45 + 364) DAY AS end_date FROM part)"""


def campaigns(t: Tables):
    """One campaign per part: sample = part, one year starting size*45 days after 1995-01-01."""
    p = t.part
    start = F.date_add(F.to_date(F.lit("1995-01-01")), F.col("p_size") * 45)
    return p.select(F.col("p_partkey").alias("sample_id"), F.col("p_size").alias("campaign_id"),
                    start.alias("start_date"), F.date_add(start, 364).alias("end_date"))


@register("campaign_match", f"""WITH {ITEMS_SQL}, {CAMPAIGNS_SQL}
SELECT transaction_id, product_id, campaign_id, order_date FROM items JOIN camp
  ON product_id = sample_id AND order_date BETWEEN start_date AND end_date::DATE
  WHERE customer_id IS NOT NULL AND is_sample""")
def q_campaign_match(t: Tables):
    it = items(t).where(F.col("customer_id").isNotNull() & F.col("is_sample"))
    j = R.interval_match(it, campaigns(t), "product_id", "sample_id", "order_date", "start_date", "end_date")
    return j.select("transaction_id", "product_id", "campaign_id", "order_date")


def watched_txn(t: Tables):
    """Transactions with their watched products: every part of the order."""
    it = items(t)
    return it.groupBy("transaction_id", "customer_id", "order_date").agg(
        F.array_sort(F.collect_set("product_id")).alias("watched"))


@register("conversion", f"""WITH {ITEMS_SQL},
w AS (SELECT DISTINCT transaction_id, customer_id, order_date, product_id FROM items),
j AS (SELECT w.transaction_id, i.order_date AS conv_date, i.transaction_id AS conv_txn FROM w JOIN items i
      ON w.customer_id = i.customer_id AND w.product_id = i.product_id
      WHERE i.order_date > w.order_date AND i.order_date <= w.order_date + INTERVAL 120 DAY)
SELECT transaction_id, min(conv_date) AS converted_date,
       arg_min(conv_txn, (conv_date, conv_txn)) AS converted_txn_id FROM j GROUP BY transaction_id""")
def q_conversion(t: Tables):
    return R.conversion(watched_txn(t), items(t).select("transaction_id", "customer_id", "order_date", "product_id"))


@register("min_orders_semi", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998 GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 2)
  AND year(o_orderdate) = 1998""")
def q_min_orders(t: Tables):
    """Customers with at least two orders in the watched period (1998), their orders."""
    o = t.orders.where(F.year("o_orderdate") == 1998).select("o_orderkey", "o_custkey")
    return R.min_orders_semi(o, "o_custkey", 2, "o_orderkey")


# ---------------------------------------------------------------------------
# E: aggregations
# ---------------------------------------------------------------------------
@register("group_mean", """SELECT l_returnflag, l_linestatus, avg(l_quantity) AS avg_qty,
  avg(l_extendedprice) AS avg_price FROM lineitem GROUP BY ALL""")
def q_group_mean(t: Tables):
    return A.group_stats(t.lineitem, ["l_returnflag", "l_linestatus"],
                         {"avg_qty": F.avg("l_quantity"), "avg_price": F.avg("l_extendedprice")})


PURCHASES_SQL = """pur AS (SELECT o_custkey AS user_id, p_brand AS master_product_id, p_type AS subcategory,
  p_size AS type, p_name || ' ' || p_brand AS item_id, o_orderdate::DATE AS order_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def purchases(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_partkey")
    j = li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("master_product_id"),
                    F.col("p_type").alias("subcategory"), F.col("p_size").alias("type"),
                    F.concat_ws(" ", "p_name", "p_brand").alias("item_id"), F.to_date("o_orderdate").alias("order_date"))


@register("interactions_2stage", f"""WITH {PURCHASES_SQL},
a AS (SELECT user_id, master_product_id, subcategory, type, count(*) AS purchases, max(upper(item_id)) AS item_id,
      min(order_date) AS first_order, max(order_date) AS last_order FROM pur GROUP BY ALL)
SELECT user_id, item_id, subcategory, type, sum(purchases)::BIGINT AS purchases, min(first_order) AS first_order,
       max(last_order) AS last_order FROM a GROUP BY user_id, item_id, subcategory, type""")
def q_interactions(t: Tables):
    return A.interactions_2stage(purchases(t))


@register("txn_rollup", f"WITH {TXN_SQL} SELECT * FROM txn")
def q_txn_rollup(t: Tables):
    return txn(t)


DQ_SQL = """dq AS (SELECT o_custkey AS id, o_orderdate::DATE AS trigger_date,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) / count(*) AS passed_records_pct,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS passed_records
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
st AS (SELECT id, max(round(passed_records_pct, 1)) AS max_passed_records_pct, count(*) AS count,
       max(passed_records) AS max_passed_records, min(trigger_date) AS start_date, max(trigger_date) AS end_date
       FROM dq GROUP BY id HAVING count(*) > 8)"""


def dq_results(t: Tables):
    """Rule results: one per customer (rule) and order date; passed = lines not returned."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("trigger_date")).agg(
        F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("passed_records"),
        F.count(F.lit(1)).alias("records"))
    return g.withColumn("passed_records_pct", F.round(R.ratio("passed_records", "records"), 1))


@register("rule_stats", f"WITH {DQ_SQL} SELECT * FROM st")
def q_rule_stats(t: Tables):
    return A.rule_stats(dq_results(t), "id", "passed_records_pct", "passed_records", "trigger_date", 8)


@register("clean_rule_share", f"""WITH {DQ_SQL},
per AS (SELECT max_passed_records_pct, count(*) AS count FROM st GROUP BY 1)
SELECT max_passed_records_pct, count, (SELECT count(*) FROM st) AS entities, count / (SELECT count(*) FROM st) AS share
FROM per ORDER BY count DESC, max_passed_records_pct DESC LIMIT 1""")
def q_clean_rule_share(t: Tables):
    st = A.rule_stats(dq_results(t), "id", "passed_records_pct", "passed_records", "trigger_date", 8)
    return A.clean_rule_share(st, "max_passed_records_pct")


@register("pivot_topn", """WITH c AS (SELECT c_mktsegment, count(c_custkey) AS count FROM customer GROUP BY 1
  ORDER BY count DESC, c_mktsegment LIMIT 3) SELECT c_mktsegment, count, count / sum(count) OVER () AS pct FROM c""")
def q_pivot_topn(t: Tables):
    return A.pivot_topn(t.customer, ["c_mktsegment"], "c_custkey", 3)


@register("category_summary", """WITH l AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION ALL SELECT 'l_quantity', l_quantity::VARCHAR FROM lineitem),
c AS (SELECT variable, value, count(*) AS count FROM l GROUP BY ALL),
r AS (SELECT *, count / sum(count) OVER (PARTITION BY variable) AS pct,
      row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) AS rank FROM c)
SELECT variable, value, count, pct, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def q_category_summary(t: Tables):
    return A.category_summary(t.lineitem, ["l_returnflag", "l_linestatus", "l_quantity"], 5)


@register("missing_summary", """SELECT lang, variable, missing FROM (
  SELECT lang, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS quality,
         sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END)::BIGINT AS toxic
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
  UNPIVOT (missing FOR variable IN (quality, toxic))""")
def q_missing(t: Tables):
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return A.missing_summary(j, "lang", ["quality", "toxic"])


_PCTS = list(range(0, 6)) + [25, 50, 75] + list(range(95, 101))


def _pct_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        for p in _PCTS:
            parts.append(f"SELECT '{c}' AS variable, 'p{p}' AS percentile, "
                         f"round(quantile_cont({c}, {p / 100}), 2) AS value FROM lineitem")
    return " UNION ALL ".join(parts)


@register("outlier_percentiles", _pct_sql(["l_quantity", "l_extendedprice", "l_discount"]))
def q_outlier_percentiles(t: Tables):
    return A.outlier_percentiles(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


CLUSTER_SQL = """cl AS (SELECT n_regionkey AS cluster, c_mktsegment,
  CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS bal_sign, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def clustered(t: Tables):
    """Cluster id = the customer's region key; variables of customers."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_regionkey").alias("cluster"), "c_mktsegment",
                    F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos").alias("bal_sign"), "c_acctbal")


@register("cluster_categorical", f"""WITH {CLUSTER_SQL},
l AS (SELECT cluster::VARCHAR AS cluster, 'c_mktsegment' AS variable, c_mktsegment AS value FROM cl
      UNION ALL SELECT cluster::VARCHAR, 'bal_sign', bal_sign FROM cl),
p AS (SELECT variable, value, cluster, count(*) AS count FROM l GROUP BY ALL),
p2 AS (SELECT * FROM p UNION ALL SELECT variable, value, 'SAMPLE', sum(count)::BIGINT FROM p GROUP BY variable, value),
o AS (SELECT variable, value, cluster, count, count / sum(count) OVER (PARTITION BY variable, cluster) * 100 AS pct
      FROM p2)
SELECT variable, value, cluster, count, round(pct, 9) AS pct FROM o
UNION ALL SELECT 'Total', 'Total', cluster, sum(count)::BIGINT, round(sum(pct), 9) FROM o
  WHERE variable = 'c_mktsegment' GROUP BY cluster""")
def q_cluster_categorical(t: Tables):
    return A.cluster_categorical(clustered(t), "cluster", ["c_mktsegment", "bal_sign"]).withColumn("pct", F.round("pct", 9))


@register("cluster_continuous", f"""WITH {CLUSTER_SQL}
SELECT 'c_acctbal' AS variable, cluster, min(c_acctbal) AS min, quantile_cont(c_acctbal, 0.25) AS q1,
  quantile_cont(c_acctbal, 0.5) AS med, avg(c_acctbal) AS avg, quantile_cont(c_acctbal, 0.75) AS q3,
  max(c_acctbal) AS max FROM cl GROUP BY cluster""")
def q_cluster_continuous(t: Tables):
    return A.cluster_continuous(clustered(t), "cluster", ["c_acctbal"])


@register("cluster_top5_other", """WITH b AS (SELECT o_orderpriority AS cluster, o_orderstatus, n_name FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT cluster, 'o_orderstatus' AS variable, o_orderstatus AS value FROM b UNION ALL
  SELECT cluster, 'n_name', n_name FROM b),
f AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, value) AS r
      FROM l GROUP BY variable, value),
g AS (SELECT l.cluster, l.variable, CASE WHEN f.r <= 5 THEN l.value ELSE 'Other' END AS value
      FROM l JOIN f ON l.variable = f.variable AND l.value = f.value)
SELECT variable, value, cluster, count(*) AS count FROM g GROUP BY variable, value, cluster
UNION ALL SELECT variable, value, NULL, count(*) FROM g GROUP BY variable, value""")
def q_cluster_top5(t: Tables):
    """Order status and customer nation by order priority (cluster); top 5 values of each, else Other."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(F.col("o_orderpriority").alias("cluster"), "o_orderstatus", "n_name")
    return A.cluster_top5_other(o, "cluster", ["o_orderstatus", "n_name"])


@register("rollup_total", """SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) AS obs,
  round(sum(o_totalprice), 2) AS total_price, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS events,
  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS event_rate
  FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def q_rollup_total(t: Tables):
    o = t.orders.withColumn("ev", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    out = A.rollup_total(o, "o_orderpriority", "obs", {"total_price": "o_totalprice", "events": "ev"},
                         {"event_rate": ("events", "obs")})
    return out.withColumn("total_price", F.round("total_price", 2))


@register("dataset_report", f"""WITH {PURCHASES_SQL}
SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  min(order_date) AS first_date, max(order_date) AS last_date,
  count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS density FROM pur""")
def q_dataset_report(t: Tables):
    return A.dataset_report(purchases(t), "user_id", "item_id", "order_date")


@register("totals_distribution", """WITH tot AS (SELECT o_custkey, sum(l_quantity) AS total FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
d AS (SELECT total, count(*) AS keys FROM tot GROUP BY total)
(SELECT 'head' AS "end", total, keys FROM d ORDER BY keys DESC, total LIMIT 5)
UNION ALL (SELECT 'tail', total, keys FROM d ORDER BY keys, total DESC LIMIT 5)""")
def q_totals_distribution(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return A.totals_distribution(j, "o_custkey", "l_quantity", 5)


@register("histogram", """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)::INTEGER AS bin, lo, hi FROM orders, r)
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS high, count(*) AS n
FROM b GROUP BY bin, lo, hi""")
def q_histogram(t: Tables):
    return A.histogram(t.orders, "o_totalprice", 20).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@register("topk", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_topk(t: Tables):
    return A.topk(t.orders.select("o_orderkey", "o_totalprice"),
                  [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 10)


# ---------------------------------------------------------------------------
# G: set operations
# ---------------------------------------------------------------------------
@register("union_samples", """SELECT l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) <= 1998 THEN 'train'
  WHEN year(l_shipdate) = 1999 THEN 'valid' ELSE 'test' END AS sample FROM lineitem""")
def q_union_samples(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"))
    return R.union_samples({"train": li.where(F.col("y") <= 1998), "valid": li.where(F.col("y") == 1999),
                            "test": li.where(F.col("y") >= 2000)}).drop("y")


@register("except_strings", """SELECT DISTINCT p_name FROM part EXCEPT SELECT p_name FROM part WHERE p_size > 45""")
def q_except(t: Tables):
    return R.except_strings(t.part, t.part.where(F.col("p_size") > 45), "p_name")


@register("intersect_strings", """SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey
  INTERSECT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def q_intersect(t: Tables):
    a = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    b = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return R.intersect_strings(a, b, "n_name")


@register("dedup_subset", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1""")
def q_dedup(t: Tables):
    """Latest order of each customer."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.dedup_subset(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ascending=False)


# ---------------------------------------------------------------------------
# F: windows
# ---------------------------------------------------------------------------
ORD_SQL = "ord AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, o_totalprice FROM orders)"


def ords(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")


@register("disjoint_windows", f"""WITH {ORD_SQL}
SELECT o_orderkey, o_custkey, d, o_totalprice FROM (SELECT *, lead(d) OVER (PARTITION BY o_custkey
  ORDER BY d, o_orderkey) AS nx FROM ord) WHERE nx IS NULL OR date_diff('day', d, nx) >= 120""")
def q_disjoint(t: Tables):
    return W.disjoint_windows(ords(t), "o_custkey", "d", "o_orderkey", 120)


@register("cut_last_order", f"WITH {ORD_SQL} SELECT * FROM ord WHERE d <= DATE '2000-12-31'")
def q_cut_last(t: Tables):
    return W.cut_last_order(ords(t), "d", "2000-12-31")


@register("rfm", f"""WITH {ORD_SQL}
SELECT o_orderkey, o_custkey, d, o_totalprice,
  count(*) OVER w - 1 AS frequency,
  round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS monetary,
  date_diff('day', lag(d) OVER w, d)::INTEGER AS recency
FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_rfm(t: Tables):
    return W.rfm(ords(t), "o_custkey", "d", "o_orderkey", "o_totalprice").withColumn("monetary", F.round("monetary", 2))


@register("rfm_asof", f"""WITH {ORD_SQL},
p AS (SELECT (l_orderkey * 10 + l_linenumber) AS probe_id, o_custkey, l_shipdate::DATE AS d
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT probe_id, p.o_custkey, p.d,
  date_diff('day', (SELECT max(h.d) FROM ord h WHERE h.o_custkey = p.o_custkey AND h.d < p.d), p.d)::INTEGER AS recency,
  (SELECT count(*) FROM ord h WHERE h.o_custkey = p.o_custkey AND h.d < p.d) AS frequency,
  round(coalesce((SELECT sum(o_totalprice) FROM ord h WHERE h.o_custkey = p.o_custkey AND h.d < p.d), 0), 2) AS monetary
FROM p""")
def q_rfm_asof(t: Tables):
    """Each shipped line against its customer's order history strictly before the ship date."""
    p = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("probe_id"), "o_custkey",
        F.to_date("l_shipdate").alias("d"))
    out = W.rfm_asof(ords(t), p, "o_custkey", "d", "o_totalprice", "probe_id")
    return out.withColumn("monetary", F.round("monetary", 2))


@register("avg_rank_pct", """SELECT o_orderkey, o_orderpriority, o_totalprice,
  (rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2) AS avg_rank,
  (rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2)
    / count(*) OVER (PARTITION BY o_orderpriority) AS pct_rank
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)""")
def q_avg_rank(t: Tables):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return W.avg_rank_pct(o, ["o_orderpriority"], "o_totalprice").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "avg_rank", "pct_rank")


@register("item_popularity", """WITH p AS (SELECT l_partkey, sum(l_quantity) AS popularity FROM lineitem GROUP BY 1)
SELECT l_partkey, popularity, rank() OVER w + (count(*) OVER (PARTITION BY popularity) - 1) / 2 AS avg_rank,
  (rank() OVER w + (count(*) OVER (PARTITION BY popularity) - 1) / 2) / count(*) OVER () AS pct_rank
FROM p WINDOW w AS (ORDER BY popularity DESC)""")
def q_item_popularity(t: Tables):
    return W.item_popularity(t.lineitem, "l_partkey", "l_quantity").select(
        "l_partkey", "popularity", "avg_rank", "pct_rank")


@register("running_sum", """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""")
def q_running_sum(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = W.running_sum(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", "o_custkey", F.round("running", 2).alias("running"))


MONTHLY_SQL = """ms AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS ts,
  round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"""


def monthly(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("series_id"),
                            F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts")) \
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


@register("lag_pairs", f"""WITH {MONTHLY_SQL}
SELECT series_id, ts, y, {', '.join(f'lag(y, {k}) OVER w AS lag_{k}' for k in range(1, 7))}
FROM ms WINDOW w AS (PARTITION BY series_id ORDER BY ts)""")
def q_lag_pairs(t: Tables):
    return W.lag_pairs(monthly(t), "series_id", "ts", "y", list(range(1, 7)))


@register("index_ids", """SELECT o_custkey, (dense_rank() OVER (ORDER BY o_custkey) - 1) AS user_idx
  FROM (SELECT DISTINCT o_custkey FROM orders)""")
def q_index_ids(t: Tables):
    return W.index_ids(t.orders, "o_custkey", "user_idx")


@register("merge_intervals", """WITH iv AS (SELECT o_custkey, o_orderdate::DATE AS s, o_orderdate::DATE + 30 AS e FROM orders),
f AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
      FROM iv),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM f)
SELECT o_custkey, min(s) AS s, max(e) AS e FROM g GROUP BY o_custkey, isl""")
def q_merge_intervals(t: Tables):
    """Each order keeps a customer active for 30 days; merged active spells per customer."""
    iv = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("s"),
                         F.date_add(F.to_date("o_orderdate"), 30).alias("e"))
    return W.merge_intervals(iv, "o_custkey", "s", "e")


@register("longest_run", """WITH m AS (SELECT DISTINCT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS v
  FROM orders),
r AS (SELECT o_custkey, v, v - row_number() OVER (PARTITION BY o_custkey ORDER BY v) AS g FROM m),
runs AS (SELECT o_custkey, min(v) AS start, max(v) AS "end", count(*) AS length FROM r GROUP BY o_custkey, g)
SELECT o_custkey, arg_max(start, (length, -start)) AS start, arg_max("end", (length, -start)) AS "end",
  max(length) AS length FROM runs GROUP BY o_custkey""")
def q_longest_run(t: Tables):
    """Longest streak of consecutive months with an order, per customer."""
    m = t.orders.select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("v"))
    return W.longest_run(m, "o_custkey", "v")
