"""Forecast errors and match summaries, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import safe_div, sum0


def error_columns(actual: str = "actual_pd", predicted: str = "predicted_pd", keep_unpredicted: bool = False) -> list[Column]:
    """rows, mae, rmse, wmape over rows that have both values; empty gives nulls.

    ``keep_unpredicted``: the WMAPE's denominator keeps rows without a prediction.
    """
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    e = F.when(both, F.col(actual) - F.col(predicted))
    base = F.sum(F.abs(F.col(actual))) if keep_unpredicted else F.sum(F.when(both, F.abs(F.col(actual))))
    return [
        F.count_if(both).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), safe_div(F.sum(F.abs(e)), base).alias("wmape"),
    ]


def metrics(predictions: DataFrame, by: list[str], drop_null_keys: bool = False, **options) -> DataFrame:
    """Errors by group; null keys form a group unless dropped."""
    if drop_null_keys:
        for k in by:
            predictions = predictions.where(F.col(k).isNotNull())
    return predictions.groupBy(*by).agg(*error_columns(**options))


def to_zone(predictions: DataFrame, keys: list[str], actual: str = "actual_pd", predicted: str = "predicted_pd") -> DataFrame:
    """Member predictions summed to zones: a zone of nulls only sums to 0; ``coverage`` tells the share predicted."""
    return predictions.groupBy(*keys).agg(
        sum0(actual).alias(actual), sum0(predicted).alias(predicted), F.avg(F.col(predicted).isNotNull().cast("double")).alias("coverage")
    )


def error_distribution(predictions: DataFrame, member: str, by: list[str], actual: str = "actual_pd", predicted: str = "predicted_pd") -> DataFrame:
    """Per-member MAE, then its distribution over members."""
    one = predictions.groupBy(*by, member).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))
    return one.groupBy(*by).agg(
        F.count("mae").alias("members"), F.avg("mae").alias("mean_mae"), F.percentile("mae", F.lit(0.5)).alias("median_mae"),
        F.stddev_samp("mae").alias("std_mae"), F.min("mae").alias("min_mae"), F.max("mae").alias("max_mae"),
    )


def stability(scores: DataFrame, model: str, metric: str) -> DataFrame:
    """Mean, sample deviation and best of a metric over folds or horizons."""
    return scores.groupBy(model).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("best"))


def best_rows(scores: DataFrame, by: list[str], model: str, metric: str) -> DataFrame:
    """The model of the smallest metric in each group; ties to the first name."""
    return scores.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min(F.struct(metric, model)).alias("_b")).select(*by, F.col(f"_b.{model}").alias(model), F.col(f"_b.{metric}").alias(metric))


def variant_summary(matches: DataFrame, by: list[str], right: str = "right_id", voltage: str = "voltage_score", km: str = "distance_km", ambiguous: str = "ambiguous") -> DataFrame:
    """Matched, unmatched, duplicate claims, voltage rates, distances and ambiguity of match variants."""
    hit = F.col(right).isNotNull()
    rate = lambda cond: safe_div(F.count_if(hit & cond).cast("double"), F.count_if(hit).cast("double"))
    return matches.groupBy(*by).agg(
        F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"),
        (F.count_if(hit) - F.count_distinct(F.when(hit, F.col(right)))).alias("duplicates"),
        rate(F.col(voltage) < 0.65).alias("voltage_conflict_rate"), rate(F.col(voltage) >= 1.0).alias("voltage_exact_rate"),
        F.percentile(F.when(hit, F.col(km)), F.lit(0.5)).alias("median_km"), F.percentile(F.when(hit, F.col(km)), F.lit(0.9)).alias("p90_km"),
        F.count_if(F.col(ambiguous)).alias("ambiguous_rows"),
    )


def reviewed_precision(review: DataFrame, by: list[str], label: str = "manual_label") -> DataFrame:
    """Share of label 1 among labels 1 and 0; label -1 and null are not scored; null keys form a group."""
    scored = F.col(label).isin(0, 1)
    return review.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(scored).alias("scored"), F.avg(F.when(scored, (F.col(label) == 1).cast("double"))).alias("precision"))
