"""Model selection: walk-forward folds over models, with errors by level, run times, scope and a log of what was skipped."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import forecast as FC
from panelforge.operators import metrics as ME
from panelforge.operators import ml
from panelforge.operators import panel as P
from panelforge.operators.relational import union_all
from panelforge.sources.io import between
from panelforge.sources.shared import checkpointed

KEEP = ["bus", "zone", "ts", "actual_pd", "predicted_pd"]

# What the published selection retained and deferred, in short.
RETAINED = [
    ("baseline_lag_168h", "weekly pattern that any model must beat"),
    ("baseline_historical_avg", "stable reference of low complexity"),
    ("hist_gbt", "direct member model over calendar, lags, zone and cluster features"),
    ("gbt_180", "second booster, near the first in prototypes"),
    ("random_forest", "check against boosting over weeks and months"),
    ("zone_allocated", "zone forecast dealt out by shares"),
]
DEFERRED = [
    ("linear models", "baselines that are easy to read but miss nonlinear structure"),
    ("further boosters", "no better than the retained ones in prototypes"),
    ("sequence networks", "need more tuning and compute"),
    ("Gaussian mixtures as features", "kept for interpretation; k-means is the cluster feature"),
    ("quantile models", "an uncertainty layer after point forecasts"),
]
NOTES = [
    ("graph and space", "neighbouring zones' lags and residual smoothing could be added once topology is known"),
    ("sequence models", "window builders are here; networks are not"),
]


@dataclass(frozen=True)
class Fold:
    name: str
    train_start: date
    train_end: date
    validate_start: date
    validate_end: date

    def boundary(self):
        return F.lit(f"{self.train_end} 23:00:00").cast("timestamp_ntz")


def windows(panel: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """Rows of the training and of the validation days, both ends included."""
    day = lambda a, b: between(panel, "ts", F.lit(f"{a} 00:00:00").cast("timestamp_ntz"), F.lit(f"{b} 23:59:59").cast("timestamp_ntz"))
    return day(fold.train_start, fold.train_end), day(fold.validate_start, fold.validate_end)


def member_frames(panel: DataFrame, fold: Fold, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) member features as known at the fold's boundary; test rows carry training means; clusters are optional."""
    rows = FC.member_features(panel, "bus", "zone")
    if clusters is not None:
        rows = ml.attach_clusters(rows, clusters, "bus")
    train, test = windows(rows, fold)
    return train, FC.with_train_mean(P.boundary_mask(test, fold.boundary()), train, ["bus", "he", "day_of_week"], "pd", "historical_avg_bus_he_dow_pd")


def baselines(test: DataFrame) -> DataFrame:
    """(KEEP, model): last week's hour and the historical mean."""
    wide = FC.baselines(test.withColumn("actual_pd", F.col("pd")), ["bus", "zone", "ts", "actual_pd"])
    return FC.long_predictions(wide, ["bus", "zone", "ts", "actual_pd"]).select(*KEEP, "model")


def direct(train: DataFrame, test: DataFrame, kind: str, settings: dict | None = None) -> DataFrame:
    """(KEEP): a member model's predictions, with cluster features where the frames have them."""
    extra = [c for c in ("kmeans_confidence",) if c in train.columns]
    groups = ["bus", "zone", *[c for c in ("kmeans_cluster",) if c in train.columns]]
    model = ml.fit_regressor(train, kind, FC.MEMBER_FEATURES + extra, groups, "pd", settings)
    return ml.predict(model, test, FC.MEMBER_FEATURES + extra, groups).withColumn("actual_pd", F.col("pd")).select(*KEEP)


def zone_allocated(panel: DataFrame, train: DataFrame, test: DataFrame, fold: Fold, kind: str = "hist_gbt", settings: dict | None = None) -> DataFrame:
    """(KEEP): a model of the zones' totals, dealt out to members by their training shares."""
    rows = FC.zone_features(panel, "zone")
    known, ahead = windows(rows, fold)
    ahead = FC.with_train_mean(P.boundary_mask(ahead, fold.boundary()), known, ["zone", "he", "day_of_week"], "pd", "historical_avg_zone_he_dow_pd")
    model = ml.fit_regressor(known, kind, FC.ZONE_FEATURES, ["zone"], "pd", settings)
    forecast = ml.predict(model, ahead, FC.ZONE_FEATURES, ["zone"], "zone_pred").select("zone", "ts", "zone_pred")
    slots = FC.with_shares(test.drop("share"), FC.shares(train, "zone", "bus"), "zone", "bus")
    return FC.allocate(slots, forecast, "zone").withColumn("actual_pd", F.col("pd")).select(*KEEP)


def clusters_of(train: DataFrame, k: int = 4) -> DataFrame:
    """(bus, kmeans_cluster, kmeans_confidence) from the training days' daily profiles."""
    hours = [f"h{n}" for n in range(1, 25)]
    z = P.zscore(P.interpolate(train.groupBy("bus", "he").agg(F.avg("pd").alias("m")), ["bus"], "he", "m", "f"), ["bus"], "f", "z")
    wide = z.groupBy("bus").pivot("he", list(range(1, 25))).agg(F.first("z")).toDF("bus", *hours)
    return ml.kmeans(wide, hours, "bus", k, (ml.SEED,))[0]


def attempt(log: list[tuple], variant: str, run: Callable[[], DataFrame]) -> DataFrame | None:
    """One variant's rows, written at once, with its wall clock in the log; a variant that fails is logged and skipped."""
    began = time.time()
    try:
        out = checkpointed(run())
        log.append((variant, "ok", round(time.time() - began, 3), None))
        return out
    except (PySparkException, ValueError, KeyError) as e:
        log.append((variant, "skipped", round(time.time() - began, 3), f"{type(e).__name__}: {e}"[:300]))
        return None


@dataclass
class Selection:
    predictions: DataFrame  # fold, model, KEEP
    runtime: DataFrame  # fold, model, status, seconds, error
    scope: DataFrame  # fold, part, rows, members
    clusters: DataFrame  # fold, bus, kmeans_cluster

    def errors(self, *by: str) -> DataFrame:
        return ME.metrics(self.predictions, ["fold", "model", *by])

    def with_runtime(self) -> DataFrame:
        """Member errors of each fold and model beside the seconds it took; baselines are not fitted and have none."""
        return runtime_join(self.errors(), self.runtime)

    def levels(self, boundary_of: dict[str, Fold]) -> DataFrame:
        """Member and zone errors over the overlapping horizons."""
        rows = union_all(*[FC.with_horizons(self.predictions.where(F.col("fold") == n), f.boundary()) for n, f in boundary_of.items()])
        member = ME.metrics(rows, ["fold", "model", "horizon"]).withColumn("level", F.lit("member"))
        zone = ME.metrics(ME.to_zone(rows, ["fold", "model", "horizon", "zone", "ts"]), ["fold", "model", "horizon"]).withColumn("level", F.lit("zone"))
        return member.unionByName(zone)

    def by_cluster(self) -> DataFrame:
        """Mean absolute error of each model, one column a cluster."""
        rows = self.predictions.join(self.clusters.select("fold", "bus", F.col("kmeans_cluster").cast("string").alias("cluster")), ["fold", "bus"])
        return cluster_pivot(rows, "model", "cluster")


def runtime_join(errors: DataFrame, runtime: DataFrame) -> DataFrame:
    return errors.join(runtime.where(F.col("status") == "ok").select("fold", "model", "seconds"), ["fold", "model"], "left")


def cluster_pivot(rows: DataFrame, model: str, cluster: str, actual: str = "actual_pd", predicted: str = "predicted_pd") -> DataFrame:
    """A row a model, a column a cluster: the mean absolute error."""
    error = rows.withColumn("_e", F.abs(F.col(actual) - F.col(predicted)))
    return error.groupBy(model).pivot(cluster).agg(F.avg("_e"))


def select_models(panel: DataFrame, folds: list[Fold], models: dict[str, tuple[str, dict | None]], zone_model: tuple[str, dict | None] | None = ("hist_gbt", None), clusters: int = 0) -> Selection:
    """Every fold and model: baselines, direct member models, a zone model with allocation.

    The driver loops over folds and models only; a fold's features are computed once. ``panel``: (bus,
    zone, ts, pd). ``clusters``: a number of k-means clusters of the training days to attach, 0 for none.
    """
    spark, log, parts, scope, groups = panel.sparkSession, [], [], [], []
    for fold in folds:
        own: list[tuple] = []
        known, _ = windows(panel.withColumn("he", F.hour("ts") + 1), fold)
        found = checkpointed(clusters_of(known, clusters)) if clusters else None
        train, test = (checkpointed(x) for x in member_frames(panel, fold, found))
        labelled = found if found is not None else train.select("bus").distinct().withColumn("kmeans_cluster", F.lit("disabled"))
        groups.append(labelled.select(F.lit(fold.name).alias("fold"), "bus", F.col("kmeans_cluster").cast("string").alias("kmeans_cluster")))
        for part, rows in (("train", train), ("validation", test)):
            scope.append(rows.agg(F.lit(fold.name).alias("fold"), F.lit(part).alias("part"), F.count("*").alias("rows"), F.count_distinct("bus").alias("members")))
        made = {"baselines": baselines(test)}
        for name, (kind, settings) in models.items():
            made[name] = attempt(own, name, lambda kind=kind, settings=settings: direct(train, test, kind, settings).withColumn("model", F.lit(name)))
        if zone_model:
            made["zone_allocated"] = attempt(own, "zone_allocated", lambda: zone_allocated(panel, train, test, fold, *zone_model).withColumn("model", F.lit("zone_allocated")))
        parts += [rows.select(F.lit(fold.name).alias("fold"), "model", *KEEP) for rows in made.values() if rows is not None]
        log += [(fold.name, *row) for row in own]
    runtime = spark.createDataFrame(log, "fold string, model string, status string, seconds double, error string")
    return Selection(union_all(*parts), runtime, union_all(*scope), union_all(*groups))


def rationale(spark: SparkSession) -> DataFrame:
    """(kind, subject, reason): retained and deferred models, and notes."""
    rows = [("retained", *r) for r in RETAINED] + [("deferred", *r) for r in DEFERRED] + [("note", *r) for r in NOTES]
    return spark.createDataFrame(rows, "kind string, subject string, reason string")
