"""Baselines, shares, allocation, horizons and folds."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import safe_div, scrub, sum0
from panelforge.operators import panel as P

# Feature sets of the models.
CALENDAR = ["hour", "day_of_week", "is_weekend", "month", "quarter", "day_of_year"]
SERIES = ["lag_24h_pd", "lag_168h_pd", "rolling_7d_mean_pd", "rolling_28d_mean_pd", "rolling_7d_std_pd", "rolling_28d_std_pd"]
MEMBER_FEATURES = [*CALENDAR, *SERIES, "historical_avg_bus_he_dow_pd", "zone_total_pd_lag_24h", "zone_total_pd_lag_168h"]
ZONE_FEATURES = [*CALENDAR, *SERIES, "historical_avg_zone_he_dow_pd"]
CYCLICAL = [f"{k}_{f}" for k in ("hour", "dow", "doy", "month") for f in ("sin", "cos")]
CLUSTER = ["kmeans_cluster", "cluster_confidence", "cluster_avg_load"]


def member_features(panel: DataFrame, member: str, zone: str) -> DataFrame:
    """Calendar, lags, rolling, expanding mean and zone context of an hourly panel."""
    from panelforge.functions.dates import calendar

    out = calendar(panel).withColumn("he", F.hour("ts") + 1)
    out = P.rolling(P.lags(out, [member]), [member])
    out = P.expanding_mean(out, [member, "he", "day_of_week"], "historical_avg_bus_he_dow_pd")
    return P.zone_context(out, [zone], [member])


def zone_features(panel: DataFrame, zone: str) -> DataFrame:
    from panelforge.functions.dates import calendar

    out = calendar(panel.groupBy(zone, "ts").agg(sum0("pd").alias("pd"))).withColumn("he", F.hour("ts") + 1)
    out = P.rolling(P.lags(out, [zone]), [zone])
    return P.expanding_mean(out, [zone, "he", "day_of_week"], "historical_avg_zone_he_dow_pd")


def group_mean(train: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg(value).alias(out))


def with_train_mean(rows: DataFrame, train: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Replace ``out`` by the mean of the training window."""
    return rows.drop(out).join(group_mean(train, keys, value, out), keys, "left")


def shares(panel: DataFrame, zone: str, member: str, value: str = "pd") -> DataFrame:
    """Mean share of a member in its zone by hour ending and weekday; shares of a slot add up to 1."""
    total = F.sum(value).over(W.partitionBy(zone, "ts"))
    rows = panel.withColumn("_share", safe_div(F.col(value), total))
    mean = rows.groupBy(zone, member, "he", "day_of_week").agg(F.avg("_share").alias("_mean"))
    slot = F.sum("_mean").over(W.partitionBy(zone, "he", "day_of_week"))
    return mean.select(zone, member, "he", "day_of_week", safe_div("_mean", slot).alias("share"))


def with_shares(rows: DataFrame, share: DataFrame, zone: str, member: str) -> DataFrame:
    """Attach shares; a slot without one takes the member's mean share over all slots, else 0."""
    back = share.groupBy(zone, member).agg(F.avg("share").alias("_back"))
    out = rows.join(share, [zone, member, "he", "day_of_week"], "left").join(back, [zone, member], "left")
    return out.withColumn("share", F.coalesce("share", "_back", F.lit(0.0))).drop("_back")


def allocate(rows: DataFrame, zone_forecast: DataFrame, zone: str, out: str = "predicted_pd") -> DataFrame:
    """Member forecast: the zone's forecast (zone, ts, zone_pred) times the member's share, not negative."""
    joined = rows.join(zone_forecast, [zone, "ts"], "left")
    return joined.withColumn(out, F.greatest(F.lit(0.0), scrub(F.col("zone_pred") * F.col("share"))))


def baselines(features: DataFrame, keep: list[str], yearly: str | None = None) -> DataFrame:
    """Wide baseline predictions: last week's hour, the historical mean, last year's hour where there is one."""
    cols = {"prediction_lag_168h": F.col("lag_168h_pd"), "prediction_historical_avg": F.col("historical_avg_bus_he_dow_pd")}
    if yearly and yearly in features.columns:
        cols["prediction_lag_8760h"] = F.col(yearly)
    return features.select(*keep, *[c.alias(n) for n, c in cols.items()])


def long_predictions(wide: DataFrame, keep: list[str]) -> DataFrame:
    """One row a model; "prediction_x" becomes "baseline_x"."""
    names = [c for c in wide.columns if c.startswith("prediction_")]
    long = wide.unpivot(keep, names, "model", "predicted_pd")
    return long.withColumn("model", F.regexp_replace("model", "^prediction_", "baseline_"))


def horizons(created: Column, ts: str = "ts") -> list[tuple[str, Column, Column]]:
    """(name, first, last day) of the overlapping horizons after a creation time."""
    first = F.to_date(created) + F.expr("interval 1 day")
    first = F.to_date(first)
    return [("next_day", first, first), ("next_week", first, F.date_add(first, 6)), ("next_month", first, F.last_day(first))]


def with_horizons(rows: DataFrame, created: Column, ts: str = "ts", names: list[str] | None = None) -> DataFrame:
    """Each row once for every horizon that holds its day: one pass, no union of scans."""
    day = F.to_date(ts)
    hits = [F.when((day >= a) & (day <= b), F.lit(n)) for n, a, b in horizons(created) if names is None or n in names]
    return rows.withColumn("horizon", F.explode(F.array_compact(F.array(*hits))))


def fold_table(spark: SparkSession, first: date, train_days: int, validate_days: int, folds: int, step: int | None = None) -> DataFrame:
    """Walk-forward folds: growing training windows, each followed by its validation window."""
    rows = []
    for k in range(folds):
        end = first + timedelta(days=train_days - 1 + k * (step or validate_days))
        rows.append((k + 1, first, end, end + timedelta(days=1), end + timedelta(days=validate_days), datetime(end.year, end.month, end.day, 23)))
    return spark.createDataFrame(rows, "fold int, train_start date, train_end date, validate_start date, validate_end date, created_at timestamp_ntz")


def rolling_origins(spark: SparkSession, first: date, last: date, every: str = "day") -> DataFrame:
    """Forecast origins, daily or monthly, each at 23:00 of the day before."""
    step = {"day": "1 day", "month": "1 month"}[every]
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step}"))).alias("target_date")).withColumn(
        "created_at", F.col("target_date").cast("timestamp_ntz") - F.expr("interval 1 hour")
    )


def residual_quantiles(train: DataFrame, keys: list[str], actual: str, predicted: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Empirical residual quantiles around a point forecast, by group (an interval without a quantile model)."""
    r = F.col(actual) - F.col(predicted)
    return train.groupBy(*keys).agg(F.percentile(r, F.lit(low)).alias("r_low"), F.percentile(r, F.lit(0.5)).alias("r_mid"), F.percentile(r, F.lit(high)).alias("r_high"))
