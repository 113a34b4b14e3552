"""Column profiles, anomaly and duplicate counts, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import _c, utc_time
from panelforge.functions.text import changes_on_trim, is_blank


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, rows, non_null, nulls, blanks, missing_pct, distinct_values, distinct_with_null), a row a column."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    one = df.agg(F.count("*").alias("rows"), *[
        F.struct(F.count(c).alias("n"), F.count_if(is_blank(F.col(c).cast("string"))).alias("b"), F.count_distinct(F.col(c)).alias("d")).alias(f"p{k}")
        for k, c in enumerate(columns)
    ])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"p{k}").alias("p")) for k, c in enumerate(columns)])
    rows = one.select("rows", F.explode(parts).alias("x"))
    n, b, d = F.col("x.p.n"), F.col("x.p.b"), F.col("x.p.d")
    missing = (F.col("rows") - n + b) * 100.0 / F.nullif(F.col("rows"), F.lit(0))
    return rows.select("x.column", "x.dtype", "rows", n.alias("non_null"), (F.col("rows") - n).alias("nulls"), b.alias("blanks"), missing.alias("missing_pct"), d.alias("distinct_values"), (d + (n < F.col("rows")).cast("long")).alias("distinct_with_null"))


def examples(df: DataFrame) -> DataFrame:
    """(column, example): the smallest non-null value of each column as text."""
    one = df.agg(*[F.min(F.col(c).cast("string")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "example")


def duplicate_counts(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(check, rows, distinct_rows, duplicates): rows beyond the first of each key; null equals null."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_distinct(F.struct(*cols)).alias(name) for name, cols in keys.items()])
    return one.unpivot(["rows"], list(keys), "check", "distinct_rows").withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def anomaly_checks(df: DataFrame, texts: list[str], early: str | None = None, late: str | None = None) -> DataFrame:
    """(check, found): texts that trimming changes, blanks, unreadable times, spans that end before they begin."""
    checks: dict[str, Column] = {}
    for c in texts:
        checks[f"trim_changes:{c}"] = changes_on_trim(c)
        checks[f"blank:{c}"] = is_blank(c)
    for c in (early, late):
        if c:
            checks[f"unreadable:{c}"] = _c(c).isNotNull() & utc_time(_c(c).cast("string")).isNull()
    if early and late:
        checks["late_before_early"] = F.coalesce(utc_time(_c(late).cast("string")) < utc_time(_c(early).cast("string")), F.lit(False))
    one = df.agg(*[F.count_if(x).alias(n) for n, x in checks.items()])
    return one.unpivot([], [f"`{n}`" for n in checks], "check", "found")


def coordinate_profile(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Missing, out of range, zero and repeated coordinates, and the bounds; null pairs repeat each other."""
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    outside = ~missing & ((F.abs(lat) > 90) | (F.abs(lon) > 180))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(missing).alias("missing"), F.count_if(outside).alias("out_of_range"),
        F.count_if((F.col(lat) == 0) & (F.col(lon) == 0)).alias("zero"),
        (F.count("*") - F.count_distinct(F.struct(lat, lon))).alias("repeated"),
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Value counts, null kept."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
