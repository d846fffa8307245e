"""Exact token counts: a histogram of encoded lengths and suffix sums over it.

Documents are aggregated by encoded length, which is all that totals, quantiles and totals
under a context limit depend on. Suffix sums run inside buckets of lengths and, one row a
bucket, over the buckets, so no single task orders all distinct lengths.

Defined cases: a null or empty text has length 0; repeated rows count each time; an empty
table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.staging import text_batches
from kestrel.llm.textarrays import slices
from kestrel.llm.tokens import library_encoder, worker_encoder

BUCKET_BITS = 10


def token_lengths(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text; no special tokens are added."""
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(library_encoder, tokenizer)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(encode(texts)[1]))],
                                                 names=["doc_id", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """One row per distinct length, taken as a context limit.

    Returns (n_tokens, n_docs, docs_ge, tokens_ge, total_docs, total_tokens, truncated_tokens,
    share_le): documents and tokens of this length or more, and the tokens that remain when
    every document is cut to ``n_tokens``; ``share_le`` is the share of documents that fit.
    """
    counts = lengths.filter(F.col(n_tokens).isNotNull()).groupBy(F.col(n_tokens).cast("long").alias("n_tokens")) \
        .agg(F.count(F.lit(1)).alias("n_docs")).withColumn("tokens", F.col("n_docs") * F.col("n_tokens")) \
        .withColumn("bucket", F.shiftright("n_tokens", BUCKET_BITS))
    down = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = counts.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "bucket", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(down), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc())
    joined = counts.join(above, "bucket") \
        .withColumn("docs_ge", F.col("docs_above") + F.sum("n_docs").over(inside)) \
        .withColumn("tokens_ge", F.col("tokens_above") + F.sum("tokens").over(inside))
    fits = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return joined.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_tokens"),
        (fits / F.col("total_docs")).alias("share_le"))


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_tokens_kept, docs_cut) for any context limits, in one pass over the histogram.

    The suffix sums at the smallest distinct length over a limit answer it.
    """
    def one(limit: int):
        over = F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "docs_ge", "tokens_ge"))
        first, total = F.min(over), F.coalesce(F.max("total_tokens"), F.lit(0))
        cut = F.coalesce(first["docs_ge"], F.lit(0))
        return F.struct(F.lit(int(limit)).cast("long").alias("limit"),
                        (total - F.coalesce(first["tokens_ge"], F.lit(0)) + cut * limit).alias("n_tokens_kept"),
                        cut.alias("docs_cut"))

    return histogram.agg(F.array(*[one(x) for x in limits]).alias("a")).select(F.inline("a"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents fits."""
    picked = [F.struct(F.lit(float(s)).alias("share"),
                       F.min(F.when(F.col("share_le") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return histogram.agg(F.array(*picked).alias("q")).select(F.inline("q"))
