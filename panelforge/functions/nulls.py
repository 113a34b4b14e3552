"""Null and number semantics as column expressions.

Each function states the case it decides; Spark's ANSI mode raises on division by zero and on bad
casts, so nothing here divides or casts without a guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum0(x: Column | str) -> Column:
    """Sum in which a group of nulls only is 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def sum_or_null(x: Column | str) -> Column:
    """Sum in which a group of nulls only is null."""
    return F.sum(_c(x))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return _c(a) / F.nullif(_c(b), F.lit(0).cast("double"))


def is_close(a: Column | str, b: Column | str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|; null on either side is false."""
    return F.coalesce(F.abs(_c(a) - _c(b)) <= atol + rtol * F.abs(_c(b)), F.lit(False))


def clip(x: Column | str, low: float | None = 0.0, high: float | None = None) -> Column:
    """Bound x; null stays null."""
    out = _c(x)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def scrub(x: Column | str, default: float = 0.0) -> Column:
    """NaN, infinite and null become ``default``."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def number(x: Column | str) -> Column:
    """A number, or null where the text is none."""
    return _c(x).cast("string").try_cast("double")


def whole(x: Column | str) -> Column:
    return number(x).try_cast("int")


def utc_time(x: Column | str) -> Column:
    """A timestamp out of text with or without an offset, or null."""
    return F.try_to_timestamp(_c(x))


def row_max(*xs: Column | str) -> Column:
    return F.greatest(*[_c(x) for x in xs])


def row_mean(*xs: Column | str) -> Column:
    return sum((_c(x) for x in xs[1:]), _c(xs[0])) / F.lit(float(len(xs)))


def row_any(*xs: Column | str) -> Column:
    out = F.coalesce(_c(xs[0]), F.lit(False))
    for x in xs[1:]:
        out = out | F.coalesce(_c(x), F.lit(False))
    return out


def fill_typed(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls become the column's default, flags included."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def null_out(df: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    """The columns become null where ``when`` holds; a null condition leaves them."""
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def clean_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate among the columns, whatever the case."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def drop_constant(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value (nulls do not count), in one pass."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 1]
