"""Model queries: forecasts, clusters, supervised matching. Their results are beyond SQL; tests check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import forecast as FC
from panelforge.operators import matching as M
from panelforge.operators import metrics as ME
from panelforge.operators import ml
from panelforge.operators import panel as P
from panelforge.plans import match_queries as MQ
from panelforge.plans.panel_queries import _t, boundary, keyed, panel

NUMERIC, CATEGORICAL = FC.MEMBER_FEATURES, ["bus", "zone"]


def features(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): features as known at the boundary; test rows carry training means."""
    rows = FC.member_features(panel(s, d), "bus", "zone")
    train, test = rows.where(F.col("ts") <= boundary()), rows.where(F.col("ts") > boundary())
    test = FC.with_train_mean(P.boundary_mask(test, boundary()), train, ["bus", "he", "day_of_week"], "pd", "historical_avg_bus_he_dow_pd")
    return train, test


def _forecast(s: SparkSession, d: str, kind: str, settings: dict | None = None) -> DataFrame:
    train, test = features(s, d)
    model = ml.fit_regressor(train, kind, NUMERIC, CATEGORICAL, "pd", settings)
    out = ml.predict(model, test, NUMERIC, CATEGORICAL)
    return out.select("bus", "zone", "ts", F.lit(kind).alias("model"), F.col("pd").alias("actual_pd"), "predicted_pd")


def ridge_forecast(s, d):
    return _forecast(s, d, "ridge")


def elastic_net_forecast(s, d):
    return _forecast(s, d, "elastic_net")


def rf_forecast(s, d):
    return _forecast(s, d, "random_forest")


def gbt_forecast(s, d):
    return _forecast(s, d, "hist_gbt")


def forecast_errors(s, d):
    """Errors of a model at member and zone level over the overlapping horizons."""
    rows = FC.with_horizons(ridge_forecast(s, d), boundary())
    member = ME.metrics(rows, ["model", "horizon"]).withColumn("level", F.lit("member"))
    zone = ME.metrics(ME.to_zone(rows, ["model", "horizon", "zone", "ts"]), ["model", "horizon"]).withColumn("level", F.lit("zone"))
    return member.unionByName(zone)


def _profiles(s: SparkSession, d: str) -> DataFrame:
    rows = keyed(s, d).groupBy("bus", "he").agg(F.avg("pd").alias("m"))
    return P.zscore(P.interpolate(rows, ["bus"], "he", "m", "f"), ["bus"], "f", "z").groupBy("bus").pivot("he", list(range(1, 25))).agg(F.first("z")).toDF("bus", *[f"h{k}" for k in range(1, 25)])


def kmeans_profiles(s, d):
    out, _ = ml.kmeans(_profiles(s, d), [f"h{k}" for k in range(1, 25)], "bus", 4)
    members = keyed(s, d).groupBy("bus").agg(F.min("zone").alias("zone"), F.avg("pd").alias("average_pd"))
    return ml.attach_clusters(members, out, "bus")


def cluster_summary(s, d):
    out, _ = ml.kmeans(_profiles(s, d), [f"h{k}" for k in range(1, 25)], "bus", 4)
    members = keyed(s, d).groupBy("bus").agg(F.min("zone").alias("zone"), F.avg("pd").alias("average_pd"))
    return ml.cluster_summary(out, members, "bus", "zone", "average_pd")


def gmm_profiles(s, d):
    out, _ = ml.gaussian_mixture(_profiles(s, d), [f"h{k}" for k in range(1, 25)], "bus", 2)
    return out


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Candidates with the label a reviewer would give: the part itself is the match."""
    rows = M.supervised_features(MQ.flagged(s, d, kept=True))
    return rows.withColumns({"manual_label": (F.col("left_id") == F.col("right_id")).cast("int"), "key": F.concat_ws("|", "left_id", "dataset", "right_id")})


def logistic_match(s, d):
    """Supervised re-ranking: the logistic probability picks the candidate of each reference row and source."""
    rows = _labelled(s, d)
    model = ml.fit_classifier(ml.with_folds(rows, "key", "manual_label", 4).where(F.col("fold") > 0), M.SUPERVISED, "manual_label")
    scored = ml.classify(model, rows, M.SUPERVISED)
    best = M.ranked(scored.drop("rank", "best", "second", "margin", "low_score", "close_margin", "ambiguous"), "probability_1", 1)
    return best.select("left_id", "dataset", F.when(F.col("probability_1") >= 0.5, F.col("right_id")).alias("right_id"), "probability_1")


def classifier_quality(s, d):
    rows = ml.with_folds(_labelled(s, d), "key", "manual_label", 4)
    model = ml.fit_classifier(rows.where(F.col("fold") > 0), M.SUPERVISED, "manual_label")
    return ml.classifier_metrics(ml.classify(model, rows.where(F.col("fold") == 0), M.SUPERVISED), "manual_label")


def embedding_clusters(s, d):
    """Clusters of whole vectors, those of the commonest length."""
    e = _t(s, d, "embeddings").where(F.col("embedding").isNotNull()).withColumn("n", F.size("embedding"))
    n = e.agg(F.mode("n", True).alias("n")).first()["n"] or 0
    rows = e.where(F.col("n") == n).select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(n)])
    return ml.kmeans(rows, [f"x{k}" for k in range(n)], "vec_id", 5)[0]


QUERIES = {f.__name__: f for f in (ridge_forecast, elastic_net_forecast, rf_forecast, gbt_forecast, forecast_errors, kmeans_profiles, cluster_summary, gmm_profiles, logistic_match, classifier_quality, embedding_clusters)}
SQL: dict[str, str] = {}
