"""Grouped hourly panels: roll-up, spine, lags, rolling and expanding features, boundary mask.

All windows are partitioned by the series (and so spread over the cluster); none runs over a whole
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import safe_div, scrub, sum_or_null

ROLLING_HOURS = (168, 672)


def hourly(rows: DataFrame, keys: list[str], ts: str, value: str, out: str = "pd") -> DataFrame:
    """Sum of ``value`` by keys and hour; an hour of nulls only is null."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("ts")
    return rows.groupBy(*keys, hour).agg(sum_or_null(value).alias(out))


def spine(panel: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The panel with a row for every hour between the table's first and last; missing hours have nulls.

    The hours come from one aggregate row, exploded for each series.
    """
    span = panel.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(ts))
    series = panel.select(*keys).distinct().withColumn("_all", F.lit(1))
    grid = series.join(F.broadcast(hours.groupBy(F.lit(1).alias("_all")).agg(F.collect_list(ts).alias("_hours"))), "_all")
    return grid.select(*keys, F.explode("_hours").alias(ts)).join(panel, [*keys, ts], "left")


def _series(keys: list[str], ts: str) -> W:
    return W.partitionBy(*keys).orderBy(ts)


def lags(panel: DataFrame, keys: list[str], hours: tuple[int, ...] = (24, 168), value: str = "pd", ts: str = "ts", by: str = "row") -> DataFrame:
    """``lag_{n}h_pd``: the value n rows before (by="row") or exactly n hours before (by="time", null on a gap)."""
    if by == "row":
        return panel.withColumns({f"lag_{n}h_{value}": F.lag(value, n).over(_series(keys, ts)) for n in hours})
    for n in hours:
        frame = F.expr(f"first({value}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {ts} RANGE BETWEEN INTERVAL '{n}' HOUR PRECEDING AND INTERVAL '{n}' HOUR PRECEDING)")
        panel = panel.withColumn(f"lag_{n}h_{value}", frame)
    return panel


def rolling(panel: DataFrame, keys: list[str], hours: tuple[int, ...] = ROLLING_HOURS, value: str = "pd", ts: str = "ts") -> DataFrame:
    """Mean and sample deviation of the n rows before each row, null under max(24, n / 4) values."""
    out = {}
    for n in hours:
        frame = _series(keys, ts).rowsBetween(-n, -1)
        enough = F.count(value).over(frame) >= max(24, min(n // 4, n))
        out[f"rolling_{n // 24}d_mean_{value}"] = F.when(enough, F.avg(value).over(frame))
        out[f"rolling_{n // 24}d_std_{value}"] = F.when(enough, F.stddev_samp(value).over(frame))
    return panel.withColumns(out)


def expanding_mean(panel: DataFrame, keys: list[str], out: str, value: str = "pd", ts: str = "ts", count_nulls: bool = False) -> DataFrame:
    """Mean of the group's earlier rows. ``count_nulls``: divide by all earlier rows, null where the row's own value is."""
    w = _series(keys, ts)
    if not count_nulls:
        return panel.withColumn(out, F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1)))
    total = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    return panel.withColumn(out, F.when(F.col(value).isNotNull(), total / F.nullif((F.row_number().over(w) - 1).cast("double"), F.lit(0.0))))


def zone_context(panel: DataFrame, zone: list[str], member: list[str], hours: tuple[int, ...] = (24, 168), value: str = "pd", ts: str = "ts", positional: bool = False) -> DataFrame:
    """``zone_total_pd`` and its lags.

    By default totals are lagged by the zone's hours. ``positional`` lags over member rows instead,
    which can reach the current hour; it exists for comparison only.
    """
    if positional:
        total = panel.withColumn(f"zone_total_{value}", F.coalesce(F.sum(value).over(W.partitionBy(*zone, ts)), F.lit(0.0)))
        w = W.partitionBy(*zone).orderBy(ts, *member)
        return total.withColumns({f"zone_total_{value}_lag_{n}h": F.lag(f"zone_total_{value}", n).over(w) for n in hours})
    totals = panel.groupBy(*zone, ts).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(f"zone_total_{value}"))
    w = W.partitionBy(*zone).orderBy(ts)
    totals = totals.withColumns({f"zone_total_{value}_lag_{n}h": F.lag(f"zone_total_{value}", n).over(w) for n in hours})
    return panel.join(totals, [*zone, ts], "left")


def boundary_mask(features: DataFrame, boundary: Column, value: str = "pd", ts: str = "ts") -> DataFrame:
    """Hide what was not known at ``boundary``: lags whose source hour lies after it, rolling columns of later rows.

    Zone lags are masked like the others.
    """
    out = {}
    for c in features.columns:
        name = c.removeprefix("zone_total_pd_")
        if name.startswith("lag_") and "h" in name:
            n = int(name[4 : name.index("h")])
            out[c] = F.when(F.col(ts) - F.expr(f"interval {n} hours") <= boundary, F.col(c))
        elif c.startswith("rolling_"):
            out[c] = F.when(F.col(ts) <= boundary, F.col(c))
    return features.withColumns(out) if out else features


def profile_24h(panel: DataFrame, keys: list[str], value: str = "pd", he: str = "he") -> DataFrame:
    """Mean by hour ending as 24 columns h1..h24."""
    wide = panel.groupBy(*keys).pivot(he, list(range(1, 25))).agg(F.avg(value))
    return wide.select(*keys, *[F.col(str(h)).alias(f"h{h}") for h in range(1, 25)])


def interpolate(points: DataFrame, keys: list[str], position: str, value: str, out: str) -> DataFrame:
    """Linear between the nearest known values before and after, the nearest one at the ends, 0 without any."""
    back = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*keys).orderBy(position).rowsBetween(W.currentRow, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(position).cast("double"))
    x0, y0 = F.last(at, True).over(back), F.last(value, True).over(back)
    x1, y1 = F.first(at, True).over(ahead), F.first(value, True).over(ahead)
    between = y0 + (y1 - y0) * safe_div(F.col(position).cast("double") - x0, x1 - x0)
    return points.withColumn(out, F.coalesce(F.col(value), between, y0, y1, F.lit(0.0)))


def zscore(points: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(x - mean) / population deviation within the group; a flat group is 0."""
    w = W.partitionBy(*keys)
    return points.withColumn(out, scrub(safe_div(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))))


def sequences(panel: DataFrame, keys: list[str], length: int, value: str = "pd", ts: str = "ts") -> DataFrame:
    """(keys, ts, sequence, target): the ``length`` values before each row, where there are so many.

    Missing values are interpolated first, by the rows' places: linear between the nearest known ones, the
    nearest at the ends, 0 without any; the target stays as it is.
    """
    w = _series(keys, ts)
    rows = panel.withColumn("_at", F.row_number().over(w))
    filled = interpolate(rows.select(*keys, "_at", value), keys, "_at", value, "_filled").select(*keys, "_at", "_filled")
    rows = rows.join(filled, [*keys, "_at"]).withColumn("sequence", F.collect_list("_filled").over(w.rowsBetween(-length, -1)))
    return rows.where(F.size("sequence") == length).select(*keys, ts, "sequence", F.col(value).alias("target"))


def running_sum(panel: DataFrame, keys: list[str], value: str = "pd", ts: str = "ts") -> DataFrame:
    """Running sum and count of rows before, and the group's largest value."""
    w = _series(keys, ts)
    return panel.withColumns({
        "cum": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), "seen": F.row_number().over(w) - 1, "top": F.max(value).over(W.partitionBy(*keys)),
    })
