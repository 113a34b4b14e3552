"""Joins, set operations, top-k and sampling that the workloads share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import safe_div


def reconcile(totals: DataFrame, members: DataFrame, keys: list[str], value: str = "pd") -> DataFrame:
    """Totals beside the sum of their members, with absolute and relative difference."""
    summed = members.groupBy(*keys).agg(F.sum(value).alias("member_sum"))
    out = totals.select(*keys, F.col(value).alias("total")).join(summed, keys, "left")
    return out.withColumn("diff", F.abs(F.col("total") - F.col("member_sum"))).withColumn("pct", safe_div(F.col("diff") * 100, F.abs("total")))


def complete(reference: DataFrame, found: DataFrame, keys: list[str], sources: list[str], source: str = "source") -> DataFrame:
    """Every reference row for every source (a literal list), found columns null where nothing was found."""
    grid = reference.withColumn(source, F.explode(F.array(*[F.lit(s) for s in sources])))
    return grid.join(found, [*keys, source], "left")


def missing_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right, keys, "left_anti")


def wide_by_source(rows: DataFrame, keys: list[str], values: list[str], sources: list[str], source: str = "source") -> DataFrame:
    """One row a key with each source's values beside each other, by conditional aggregation."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(source) == s, F.col(v))).alias(f"{s}_{v}") for s in sources for v in values])


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def first_known(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first non-null value of each column by key, which may come from several rows.

    An aggregate that combines before the shuffle, so that a large group never meets in one task. Nulls of
    the order come first.
    """
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order, with their rank from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """n rows by a seeded hash of the key, of the table or of each group: the same rows on every run."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    if by is None:
        return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")
    return top_k(df.withColumn("_h", h), by, ["_h", *keys], n, "_rank").drop("_h", "_rank")


def top_groups(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys of the largest sums; a key of nulls only comes last."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc_nulls_last("total"), key).limit(n)


def above_quantile(df: DataFrame, value: str, q: float, flag: str) -> DataFrame:
    """``flag``: the value is at or over the table's q-quantile (linear between rows)."""
    cut = df.agg(F.percentile(value, F.lit(q)).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn(flag, F.col(value) >= F.col("_cut")).drop("_cut")
