"""Calendar features, hours and distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import _c

EARTH_KM = 6371.0088


def hour_ending_time(date: Column | str, he: Column | str) -> Column:
    """The hour's start: date plus (hour ending - 1) hours, without a zone."""
    return _c(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (_c(he) - 1).cast("int"))


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "month": F.month(t),
        "quarter": F.quarter(t), "day_of_year": F.dayofyear(t), "year": F.year(t), "day_name": F.date_format(t, "EEEE"),
    })


def cyclical(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday, day of year and month; needs the columns of ``calendar``."""
    turns = {"hour": F.col("hour") / 24, "dow": F.col("day_of_week") / 7, "doy": (F.col("day_of_year") - 1) / 366, "month": (F.col("month") - 1) / 12}
    return df.withColumns({f"{k}_{n}": f(2 * math.pi * x) for k, x in turns.items() for n, f in (("sin", F.sin), ("cos", F.cos))})


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle kilometres; null where a coordinate is."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would pass over a null


def interval_fix(df: DataFrame, low: str, mid: str, high: str) -> DataFrame:
    """Make quantile columns ordered around the middle one, and add the width."""
    df = df.withColumns({low: F.least(low, mid), high: F.greatest(high, mid)})
    return df.withColumn("width", F.col(high) - F.col(low))
