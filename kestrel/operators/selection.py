"""Values at given ranks by digit selection: histograms over the ordered bits of the value.

A double maps to a 64-bit integer of the same order. Round by round, the rows are counted by the next digit
of that integer, and each wanted rank picks the digit it falls into; the next round counts only
rows whose digits so far were picked. All ranks, groups and columns go through the same rounds.
Nothing is sorted, sampled or collected; a histogram has one row per digit that occurs, added up
in the map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kestrel.session import cut_lineage, small_side

DIGITS = (44, 22, 0)  # lowest bit of each digit; the first has 20 bits (sign, exponent, 8 of the fraction)


def ordered_bits(value: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles, NaN last; both zeros are one value."""
    plain = np.where(np.isnan(value), np.nan, value + 0.0).view(np.int64)
    return plain ^ ((plain >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name`` = the ordered bits of the double column ``value``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = ordered_bits(batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64))
            yield batch.append_column(name, pa.array(bits))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def values_at_ranks(df: DataFrame, value: str, group_cols: list[str], wanted) -> DataFrame:
    """(group columns, targets...) with ``v``: the value at each wanted rank.

    ``wanted(n)`` gives an array of structs with a field ``rank`` (0-based) for a column n, the size of the
    group; the other fields are passed on. Rows whose value or group is null are left out.
    """
    g = group_cols
    some = df.where(F.col(value).isNotNull())
    for c in g:
        some = some.where(F.col(c).isNotNull())
    bits = with_bits(some.select(*g, F.col(value).cast("double").alias("_v")), "_v", "_key")
    names = [f"_d{i}" for i in range(len(DIGITS))]
    top = F.shiftright("_key", DIGITS[0]).alias("_d0")
    rest = [(F.shiftright("_key", low).bitwiseAND((1 << (up - low)) - 1)).alias(n) for up, low, n in zip(DIGITS, DIGITS[1:], names[1:])]
    rows = cut_lineage(bits.select(*g, "_v", top, *rest))
    picked = None
    for i, name in enumerate(names):
        prefix = [*g, *names[:i]]
        if picked is not None:
            rows = rows.join(small_side(picked.select(*prefix).distinct()), prefix, "left_semi")
        last = i == len(names) - 1
        counts = rows.groupBy(*prefix, name).agg(F.count(F.lit(1)).alias("_c"), *([F.min("_v").alias("v")] if last else []))
        inside = Window.partitionBy(*prefix)
        before = inside.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        if picked is None:
            asked = counts.withColumn("_n", F.sum("_c").over(inside)).withColumn("_t", F.explode(wanted(F.col("_n")))).withColumn("_rank", F.col("_t.rank"))
        else:
            asked = counts.join(picked, prefix)
        hit = (F.col("_rank") >= F.col("_b")) & (F.col("_rank") < F.col("_b") + F.col("_c"))
        found = asked.where(hit).withColumn("_rank", F.col("_rank") - F.col("_b")).select(*prefix, name, "_t", "_rank", *(["v"] if last else []))
        picked = found if last else cut_lineage(found)
    return picked.select(*g, "_t.*", "v")
