"""URL filters: host-suffix and path-prefix expressions against rules.

Each distinct URL is expanded into its expressions (every host suffix of whole labels with
every path prefix of a length that some rule has). Expressions meet rules in an equi-join on
a short prefix of their SHA-256; the full digest then confirms, and the longest fitting rule
decides. Only built-in functions are used.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule
(unless a rule is empty too); among rules of equal length ``block`` wins, then the smaller
text; equal rules count once; repeated pages each get a row; no rules or an empty table give
the default verdict or nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 4  # bytes of the digest in the equi-join


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(" ", host, path).cast("binary"), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) with their text, digest and short digest, equal ones once."""
    r = rules.select("action", F.lower("host").alias("rule_host"), "path")
    return r.dropna().dropDuplicates(["rule_host", "path", "action"]) \
        .withColumn("digest", _digest(F.col("rule_host"), F.col("path"))) \
        .select("action", F.concat("rule_host", "path").alias("rule"), F.length("path").alias("size"), "digest",
                F.substring("digest", 1, 2 * SHORT).alias("short"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page row."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    table = rule_table(rules)
    sizes = F.array(*[F.lit(r["size"]) for r in table.select("size").distinct().orderBy("size").collect()]) \
        .cast("array<int>")  # distinct path lengths of rules
    host, path = host_and_path(F.col("url"))
    urls = source.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = urls.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes)) \
        .select("url", _digest(F.col("h"), F.col("p")).alias("digest"))
    spread = spread.withColumn("short", F.substring("digest", 1, 2 * SHORT))
    met = spread.alias("s").join(table.alias("r"), F.col("s.short") == F.col("r.short")) \
        .filter(F.col("s.digest") == F.col("r.digest"))
    # longest rule, then block before allow, then the smaller text
    best = met.groupBy("s.url").agg(F.min(F.struct(
        (-F.length("rule")).alias("size"), (F.col("action") != "block").alias("milder"), "rule", "action")).alias("b"))
    decided = best.select("url", F.col("b.rule").alias("rule"), F.col("b.action").alias("verdict"))
    joined = source.alias("a").join(decided.alias("b"), F.col("a.url") == F.col("b.url"), "left") \
        .select("page_id", F.col("a.url").alias("url"), "rule", "verdict")
    return joined.select("page_id", host.alias("host"), path.alias("path"), "rule",
                         F.coalesce("verdict", F.lit(default)).alias("verdict"))
