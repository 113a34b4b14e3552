"""Operational forecasts: train, save, load and predict by configuration, and the command line.

    python -m panelforge.plans.operational run --data FOLDER --config FILE.json --out FOLDER
"""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import forecast as FC
from panelforge.operators import metrics as ME
from panelforge.operators import ml
from panelforge.operators import panel as P
from panelforge.operators.relational import top_groups
from panelforge.sources import io
from panelforge.sources.io import RunConfig

NUMERIC, CATEGORICAL = FC.MEMBER_FEATURES, ["bus", "zone"]


def chosen(panel: DataFrame, config: RunConfig) -> DataFrame:
    """Rows of the named members, else of the largest, else all."""
    if config.members:
        return panel.where(F.col("bus").isin(config.members))
    if config.top_members:
        return panel.join(F.broadcast(top_groups(panel, "bus", "pd", config.top_members).select("bus")), "bus", "left_semi")
    return panel


def boundary(config: RunConfig):
    return F.lit(f"{config.train_end} 23:00:00").cast("timestamp_ntz")


def frames(panel: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    rows = FC.member_features(chosen(panel, config), "bus", "zone")
    train = io.between(rows, "ts", F.lit(config.train_start).cast("timestamp_ntz"), boundary(config))
    test = P.boundary_mask(rows.where(F.col("ts") > boundary(config)), boundary(config))
    test = FC.with_train_mean(test, train, ["bus", "he", "day_of_week"], "pd", "historical_avg_bus_he_dow_pd")
    return train, FC.with_horizons(test, boundary(config), names=[config.horizon])


def train(panel: DataFrame, config: RunConfig, out: str) -> PipelineModel:
    """Fit and save the model with a description of the run."""
    began, spark = time.time(), panel.sparkSession
    rows, _ = frames(panel, config)
    model = ml.fit_regressor(rows, config.model, NUMERIC, CATEGORICAL, "pd", config.settings or None)
    model.write().overwrite().save(f"{out}/model")
    io.write_json(spark, asdict(config) | {"train_rows": rows.count(), "seconds": round(time.time() - began, 3), "features": NUMERIC + CATEGORICAL}, f"{out}/metadata")
    return model


def predict(panel: DataFrame, config: RunConfig, out: str, train_if_missing: bool = False) -> DataFrame:
    """Predictions of the horizon, with the saved model; written beside it with their errors."""
    spark = panel.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{out}/model")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there and not train_if_missing:
        raise FileNotFoundError(f"no model in {out}; train first")
    model = PipelineModel.load(f"{out}/model") if there else train(panel, config, out)
    _, rows = frames(panel, config)
    made = ml.predict(model, rows, NUMERIC, CATEGORICAL)
    made = made.select("bus", "zone", "ts", F.to_date("ts").alias("date"), (F.hour("ts") + 1).alias("he"), F.col("pd").alias("actual_pd"), "predicted_pd", F.lit(config.model).alias("model"), "horizon", F.lit(config.name).alias("run_name"))
    io.write_table(made, f"{out}/predictions")
    done = spark.read.parquet(f"{out}/predictions")
    io.write_text(spark, io.report(config.name, {"errors": ME.metrics(done, ["model", "horizon"]), "errors by zone": ME.metrics(done, ["zone"])}), f"{out}/report")
    return done


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train and apply an hourly forecast.")
    parser.add_argument("action", choices=["train", "predict", "run"])
    parser.add_argument("--data", required=True, help="folder with events.parquet, or panel.parquet (bus, zone, ts, pd)")
    parser.add_argument("--config", help="JSON settings")
    parser.add_argument("--out", required=True)
    parser.add_argument("--train-if-missing", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from panelforge.plans.panel_queries import panel as panel_of

    config = RunConfig.load(spark, a.config) if a.config else RunConfig()
    rows = panel_of(spark, a.data)
    if a.action in ("train", "run"):
        train(rows, config, a.out)
    if a.action in ("predict", "run"):
        predict(rows, config, a.out, a.train_if_missing)


if __name__ == "__main__":
    main()
