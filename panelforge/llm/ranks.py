"""Running totals and row numbers over tables of any size, without one task per group.

Rows are cut into buckets by the first hex digits of a hash (or any short sortable key). A window
runs inside each bucket; bucket totals, a few thousand times fewer than rows, are summed up in turn
and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(rows: DataFrame, value: Column, bucket: str, order: list[str], within: list[str], total: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over the rows before this one in (bucket, order) order.

    ``within``: columns whose groups are summed on their own (may be empty). Bucket sums are joined
    back null-safely. Rows that tie in everything keep some order among themselves.
    """
    keys = [*within, bucket]
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_sum"))
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1) if within else W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_part", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    match = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        match = one if match is None else match & one
    out = rows.join(sums, match)
    return out.withColumn(total, F.col("_part") + F.col("_base")).drop("_v", "_part", "_base", *[f"_k{i}" for i in range(len(keys))])
