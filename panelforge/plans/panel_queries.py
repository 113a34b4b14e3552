"""Queries over an hourly panel made of ``events``: member user_id % 12, zone member % 4, pd = sum(value)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import dates as D
from panelforge.functions.nulls import clean_names, row_max, row_mean, scrub, sum0
from panelforge.operators import forecast as FC
from panelforge.operators import metrics as M
from panelforge.operators import panel as P
from panelforge.operators import profiling as PR
from panelforge.operators import relational as R
from panelforge.sources import io


def boundary():
    """The forecasts' creation time."""
    return F.lit("2024-01-21 23:00:00").cast("timestamp_ntz")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_table(spark, d, name)


def panel(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select((F.col("user_id") % 12).alias("bus"), "ts", "value")
    return P.hourly(e, ["bus"], "ts", "value").withColumn("zone", F.col("bus") % 4)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).withColumns({"he": F.hour("ts") + 1, "day_of_week": F.weekday("ts")})


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


PANEL = "panel AS (SELECT user_id % 12 AS bus, (user_id % 12) % 4 AS zone, date_trunc('hour', ts) AS ts, sum(value) AS pd FROM events GROUP BY ALL)"
KEYED = PANEL + ", keyed AS (SELECT *, (hour(ts) + 1)::INTEGER AS he, (isodow(ts) - 1)::INTEGER AS day_of_week FROM panel)"
W_BUS = "(PARTITION BY bus ORDER BY ts"
PRED = PANEL + f""", lagged AS (SELECT *, lag(pd, 168) OVER {W_BUS}) AS lag_168 FROM panel),
pred AS (SELECT bus, zone, ts, pd AS actual_pd, CASE WHEN ts - INTERVAL 168 HOUR <= TIMESTAMP '2024-01-21 23:00:00' THEN lag_168 END AS predicted_pd FROM lagged WHERE ts > TIMESTAMP '2024-01-21 23:00:00')"""
ERRORS = """count(*) FILTER (actual_pd IS NOT NULL AND predicted_pd IS NOT NULL) AS rows, round(avg(abs(actual_pd - predicted_pd)), 6) AS mae,
 round(sqrt(avg((actual_pd - predicted_pd) ** 2)), 6) AS rmse, round(sum(abs(actual_pd - predicted_pd)) / nullif(sum(abs(actual_pd)) FILTER (predicted_pd IS NOT NULL), 0), 6) AS wmape"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    feats = P.boundary_mask(P.lags(panel(spark, d), ["bus"], (168,)), boundary())
    return feats.where(F.col("ts") > boundary()).select("bus", "zone", "ts", F.col("pd").alias("actual_pd"), F.col("lag_168h_pd").alias("predicted_pd"))


def lifted(df: DataFrame, *cols: str) -> DataFrame:
    """A little added before rounding: means of two-decimal values often end in an exact half."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in cols})


def _errors(df: DataFrame) -> DataFrame:
    return r6(df, "mae", "rmse", "wmape")


def panel_hourly(s, d):
    return r6(panel(s, d), "pd")


def panel_spine_nulls(s, d):
    rows = P.spine(panel(s, d).select("bus", "ts", "pd"), ["bus"])
    return rows.groupBy("bus").agg(F.count("*").alias("hours"), F.count("pd").alias("known"), F.round(sum0("pd"), 6).alias("total"))


def zero_and_null_sums(s, d):
    rows = P.spine(panel(s, d).select("bus", "ts", "pd"), ["bus"])
    return rows.groupBy("bus", F.hour("ts").alias("h"), F.dayofmonth("ts").alias("dom")).agg(F.round(sum0("pd"), 6).alias("zero_sum"), F.round(F.sum("pd"), 6).alias("null_sum"))


def he_to_timestamp(s, d):
    rows = keyed(s, d).withColumn("date", F.to_date("ts")).drop("ts")
    return r6(rows.withColumn("ts", D.hour_ending_time("date", "he")).select("bus", "date", "he", "ts", "pd"), "pd")


def scan_date_range_ids(s, d):
    e = io.between(_t(s, d, "events"), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"))
    return e.where(F.col("user_id").isin(3, 5, 7, 11)).select("event_id", "user_id", "ts", "value")


def head_sample(s, d):
    return io.head(_t(s, d, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], 500)


def value_range(s, d):
    return io.value_range(_t(s, d, "events"), "ts")


def file_inventory(s, d):
    return io.inventory(s, f"{d}/events.parquet").agg(F.sum("rows").cast("long").alias("rows"))


def calendar_features(s, d):
    return D.calendar(panel(s, d).select("bus", "ts"))


def cyclical_features(s, d):
    rows = D.cyclical(D.calendar(panel(s, d).select("bus", "ts")))
    return r6(rows.select("bus", "ts", *FC.CYCLICAL), *FC.CYCLICAL)


def lag_rows(s, d):
    return r6(P.lags(panel(s, d), ["bus"]), "pd", "lag_24h_pd", "lag_168h_pd")


def lag_time(s, d):
    return r6(P.lags(panel(s, d), ["bus"], by="time"), "pd", "lag_24h_pd", "lag_168h_pd")


def rolling_features(s, d):
    names = [f"rolling_{n}d_{f}_pd" for n in (7, 28) for f in ("mean", "std")]
    return lifted(P.rolling(panel(s, d), ["bus"]).select("bus", "ts", *names), *names)


def expanding_mean_correct(s, d):
    return r6(P.expanding_mean(keyed(s, d), ["bus", "he", "day_of_week"], "hist").select("bus", "ts", "hist"), "hist")


def expanding_mean_parity(s, d):
    rows = P.spine(panel(s, d).select("bus", "ts", "pd"), ["bus"]).withColumns({"he": F.hour("ts") + 1, "day_of_week": F.weekday("ts")})
    return r6(P.expanding_mean(rows, ["bus", "he", "day_of_week"], "hist", count_nulls=True).select("bus", "ts", "hist"), "hist")


def zone_lag_correct(s, d):
    names = ["zone_total_pd", "zone_total_pd_lag_24h", "zone_total_pd_lag_168h"]
    return r6(P.zone_context(panel(s, d), ["zone"], ["bus"]).select("bus", "ts", *names), *names)


def zone_lag_parity(s, d):
    names = ["zone_total_pd", "zone_total_pd_lag_24h", "zone_total_pd_lag_168h"]
    return r6(P.zone_context(panel(s, d), ["zone"], ["bus"], positional=True).select("bus", "ts", *names), *names)


def boundary_mask(s, d):
    rows = P.zone_context(P.rolling(P.lags(panel(s, d), ["bus"]), ["bus"]), ["zone"], ["bus"])
    rows = P.boundary_mask(rows, boundary())
    names = ["lag_24h_pd", "lag_168h_pd", "rolling_7d_mean_pd", "zone_total_pd_lag_24h"]
    return lifted(rows.select("bus", "ts", *names), *names)


def running_totals(s, d):
    return r6(P.running_sum(panel(s, d), ["bus"]).select("bus", "ts", "cum", "seen", "top"), "cum", "top")


def zone_reconciliation(s, d):
    p = panel(s, d)
    zone = _t(s, d, "events").groupBy(((F.col("user_id") % 12) % 4).alias("zone"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("pd"))
    rows = R.reconcile(zone, p, ["zone", "ts"])
    return rows.select("zone", "ts", F.round("total", 6).alias("total"), F.round("member_sum", 6).alias("member_sum"), F.round("diff", 6).alias("diff"))


def bus_share(s, d):
    return r6(FC.shares(keyed(s, d), "zone", "bus"), "share")


def share_fallback(s, d):
    p = keyed(s, d)
    share = FC.shares(p.where(F.col("ts") <= F.lit("2024-01-08").cast("timestamp_ntz")), "zone", "bus")
    return r6(FC.with_shares(p.where(F.col("ts") > F.lit("2024-01-08").cast("timestamp_ntz")), share, "zone", "bus").select("bus", "ts", "share"), "share")


def zone_allocation(s, d):
    p = keyed(s, d)
    train, test = p.where(F.col("ts") <= boundary()), p.where(F.col("ts") > boundary())
    zone = train.groupBy("zone", "ts", "he", "day_of_week").agg(F.sum("pd").alias("z"))
    mean = FC.group_mean(zone, ["zone", "he", "day_of_week"], "z", "zone_pred")
    forecast = test.select("zone", "ts", "he", "day_of_week").distinct().join(mean, ["zone", "he", "day_of_week"], "left").select("zone", "ts", "zone_pred")
    rows = FC.with_shares(test, FC.shares(train, "zone", "bus"), "zone", "bus")
    return r6(FC.allocate(rows, forecast, "zone").select("bus", "ts", "predicted_pd"), "predicted_pd")


def train_mean_override(s, d):
    p = keyed(s, d)
    train = p.where(F.col("ts") <= boundary())
    rows = FC.with_train_mean(p.where(F.col("ts") > boundary()), train, ["bus", "he", "day_of_week"], "pd", "hist")
    return r6(rows.select("bus", "ts", "hist"), "hist")


def baselines_long(s, d):
    rows = P.expanding_mean(P.lags(keyed(s, d), ["bus"], (168,)), ["bus", "he", "day_of_week"], "historical_avg_bus_he_dow_pd")
    return r6(FC.long_predictions(FC.baselines(rows, ["bus", "ts"]), ["bus", "ts"]), "predicted_pd")


def horizons(s, d):
    rows = FC.with_horizons(predictions(s, d), boundary())
    return r6(rows.groupBy("horizon").agg(F.count("*").alias("rows"), F.sum("actual_pd").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "total")


def metrics_zone(s, d):
    return _errors(M.metrics(predictions(s, d), ["zone"]))


def metrics_zone_parity(s, d):
    return _errors(M.metrics(M.to_zone(predictions(s, d), ["zone", "ts"]), ["zone"]))


def metrics_zone_coverage(s, d):
    return r6(M.to_zone(predictions(s, d), ["zone", "ts"]).groupBy("zone").agg(F.avg("coverage").alias("coverage"), F.count("*").alias("hours")), "coverage")


def metrics_keep_unpredicted(s, d):
    return r6(M.metrics(predictions(s, d), ["zone"], keep_unpredicted=True).select("zone", "wmape"), "wmape")


def error_distribution(s, d):
    return r6(M.error_distribution(predictions(s, d), "bus", ["zone"]), "mean_mae", "median_mae", "std_mae", "min_mae", "max_mae")


def model_stability(s, d):
    rows = P.expanding_mean(P.lags(keyed(s, d), ["bus"], (168,)), ["bus", "he", "day_of_week"], "historical_avg_bus_he_dow_pd")
    long = FC.long_predictions(FC.baselines(rows, ["bus", "ts", "pd"]), ["bus", "ts", "pd"]).withColumn("week", F.floor((F.dayofmonth("ts") - 1) / 7))
    return r6(M.stability(M.metrics(long, ["model", "week"], actual="pd"), "model", "mae"), "mean", "std", "best")


def best_model(s, d):
    rows = P.expanding_mean(P.lags(keyed(s, d), ["bus"], (168,)), ["bus", "he", "day_of_week"], "historical_avg_bus_he_dow_pd")
    long = FC.long_predictions(FC.baselines(rows, ["bus", "ts", "pd"]), ["bus", "ts", "pd"])
    return r6(M.best_rows(M.metrics(long, ["bus", "model"], actual="pd"), ["bus"], "model", "mae"), "mae")


def he_profile_pivot(s, d):
    names = [f"h{k}" for k in range(1, 25)]
    return r6(P.profile_24h(keyed(s, d), ["bus"]), *names)


def _gappy_profile(s, d):
    rows = keyed(s, d).groupBy("bus", "he").agg(F.avg("pd").alias("m"))
    return rows.withColumn("m", F.when((F.col("he") + F.col("bus")) % 5 != 0, F.col("m")))


def profile_interpolate(s, d):
    return r6(P.interpolate(_gappy_profile(s, d), ["bus"], "he", "m", "filled"), "m", "filled")


def profile_zscore(s, d):
    return r6(P.zscore(keyed(s, d).groupBy("bus", "he").agg(F.avg("pd").alias("m")), ["bus"], "m", "z"), "m", "z")


def month_year_pivot(s, d):
    """Means by month, one column for each year that the table holds."""
    rows = _t(s, d, "lineitem").select(F.month("l_shipdate").alias("month"), F.concat(F.lit("y"), F.year("l_shipdate")).alias("year"), "l_quantity")
    out = rows.where(F.col("year").isNotNull()).groupBy("month").pivot("year").agg(F.avg("l_quantity"))
    return r6(out, *out.columns[1:])


def month_year_long(s, d):
    """The same in long form, whatever years there are."""
    rows = _t(s, d, "lineitem").groupBy(F.month("l_shipdate").alias("month"), F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("mean"))
    return r6(rows, "mean")


def topn_groups(s, d):
    return r6(R.top_groups(_t(s, d, "events"), "user_id", "value", 25), "total")


def mode_zone(s, d):
    return _t(s, d, "events").groupBy((F.col("user_id") % 12).alias("bus")).agg(F.mode("event_type", True).alias("main_type"))


def column_profile(s, d):
    rows = _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return r6(PR.column_profile(rows).drop("dtype"), "missing_pct")


def column_examples(s, d):
    return PR.examples(_t(s, d, "nation"))


def anomaly_checks(s, d):
    rows = _t(s, d, "part").select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit(" "), F.col("p_name"))).when(F.col("p_size") % 11 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") % 5 == 0, "nonsense").otherwise("2024-01-02 00:00:00").alias("early"), F.when(F.col("p_size") % 3 == 0, "2024-01-01 00:00:00").otherwise("2024-01-03 00:00:00").alias("late"))
    return PR.anomaly_checks(rows, ["name"], "early", "late")


def duplicate_counts(s, d):
    return PR.duplicate_counts(_t(s, d, "lineitem"), {"order": ["l_orderkey"], "order_part": ["l_orderkey", "l_partkey"], "row": ["l_orderkey", "l_linenumber"]})


def frequencies(s, d):
    return PR.frequencies(_t(s, d, "events"), "event_type")


def named_aggregates(s, d):
    return r6(_t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_q"), F.max("l_quantity").alias("max_q"), F.sum("l_tax").alias("sum_tax")), "mean_q", "sum_tax")


def quantile_flag(s, d):
    return R.above_quantile(panel(s, d), "pd", 0.9, "peak").groupBy("bus").agg(F.count_if("peak").alias("peaks"), F.count("*").alias("hours"))


def abs_sort_top(s, d):
    return r6(_t(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(30), "c_acctbal")


def top_k_per_group(s, d):
    return R.top_k(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


def first_known_value(s, d):
    rows = _t(s, d, "events").select((F.col("user_id") % 12).alias("bus"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("b"))
    return r6(R.first_known(rows, ["bus"], ["event_id"], ["a", "b"]), "b")


def hash_sample_strata(s, d):
    return R.hash_sample(_t(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 20, by=["o_orderstatus"])


def union_padded(s, d):
    a = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), "c_mktsegment")
    b = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return R.union_all(a, b).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 4).alias("total"))


def row_reductions(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", row_max("l_discount", "l_tax").alias("top"), row_mean("l_discount", "l_tax").alias("mean"), scrub("l_tax").alias("tax"))
    return r6(rows, "top", "mean", "tax")


def clean_column_names(s, d):
    return clean_names(_t(s, d, "region").toDF(" R_RegionKey ", "R_NAME "))


def safe_numbers(s, d):
    from panelforge.functions.nulls import clip, is_close, number, safe_div

    rows = _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("raw"), "value")
    return r6(rows.select("event_id", number("raw").alias("n"), safe_div(F.col("value"), (F.col("event_id") % 3).cast("double")).alias("q"), clip(F.col("value") - 50, 0.0, 10.0).alias("c"), is_close(F.col("value"), F.round("value", 3)).alias("close")), "q", "c")


def sequence_windows(s, d):
    rows = P.sequences(panel(s, d), ["bus"], 24)
    return rows.select("bus", "ts", F.size("sequence").alias("n"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("sequence", 1), 6).alias("oldest"), F.round("target", 6).alias("target"))


def fold_table(s, d):
    return FC.fold_table(s, date(2024, 1, 1), 14, 4, 4)


def rolling_origins(s, d):
    return FC.rolling_origins(s, date(2024, 1, 1), date(2024, 1, 30))


def quantile_band(s, d):
    p = predictions(s, d)
    band = FC.residual_quantiles(p.where(F.dayofmonth("ts") <= 26), ["zone"], "actual_pd", "predicted_pd")
    rows = p.where(F.dayofmonth("ts") > 26).join(band, "zone").withColumns({k: F.col("predicted_pd") + F.col(f"r_{n}") for k, n in (("p10", "low"), ("p50", "mid"), ("p90", "high"))})
    rows = D.interval_fix(rows, "p10", "p50", "p90").withColumn("covered", F.col("actual_pd").between(F.col("p10"), F.col("p90")))
    return r6(rows.groupBy("zone").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("width").alias("width")), "coverage", "width")


def walk_forward(s, d):
    """Baseline errors of every fold in one pass: rows meet the folds that validate them."""
    folds = F.broadcast(FC.fold_table(s, date(2024, 1, 1), 14, 4, 4))
    rows = panel(s, d)
    feats = P.lags(rows, ["bus"], (168,)).join(folds, (F.to_date("ts") >= F.col("validate_start")) & (F.to_date("ts") <= F.col("validate_end")))
    feats = P.boundary_mask(feats, F.col("created_at"))
    return _errors(M.metrics(feats, ["fold", "zone"], actual="pd", predicted="lag_168h_pd"))


def prediction_schema(s, d):
    p = predictions(s, d)
    return r6(p.select(F.lit("baseline_lag_168h").alias("model_name"), boundary().alias("forecast_created_at"), F.to_date("ts").alias("target_date"), (F.hour("ts") + 1).alias("he"), F.col("bus").alias("bus_id"), F.col("zone").alias("zone_id"), F.col("predicted_pd").alias("predict_pd")), "predict_pd")


ROLL = {n: f"(PARTITION BY bus ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (168, 672)}
TIME = lambda n: f"any_value(pd) OVER (PARTITION BY bus ORDER BY ts RANGE BETWEEN INTERVAL {n} HOUR PRECEDING AND INTERVAL {n} HOUR PRECEDING)"
SPINE = PANEL + ", hours AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM panel), spine AS (SELECT b.bus, h.ts, p.pd FROM (SELECT DISTINCT bus FROM panel) b CROSS JOIN hours h LEFT JOIN panel p ON p.bus = b.bus AND p.ts = h.ts)"
SLOT = "PARTITION BY bus, he, day_of_week ORDER BY ts"
ZTOT = PANEL + ", tot AS (SELECT zone, ts, sum(pd) AS t FROM panel GROUP BY ALL), zl AS (SELECT *, lag(t, 24) OVER (PARTITION BY zone ORDER BY ts) AS l24, lag(t, 168) OVER (PARTITION BY zone ORDER BY ts) AS l168 FROM tot)"
SHARE = lambda src: f"m AS (SELECT zone, bus, he, day_of_week, avg(pd / nullif(t, 0)) AS mean FROM (SELECT *, sum(pd) OVER (PARTITION BY zone, ts) AS t FROM {src}) GROUP BY ALL), sh AS (SELECT zone, bus, he, day_of_week, mean / nullif(sum(mean) OVER (PARTITION BY zone, he, day_of_week), 0) AS share FROM m)"
LONG = KEYED + f""", base AS (SELECT bus, zone, ts, pd, lag(pd, 168) OVER {W_BUS}) AS a, avg(pd) OVER ({SLOT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM keyed),
long AS (SELECT bus, ts, pd, 'baseline_lag_168h' AS model, a AS p FROM base UNION ALL SELECT bus, ts, pd, 'baseline_historical_avg', b FROM base)"""
CAL = "hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, (isodow(ts) > 5)::INTEGER AS is_weekend, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter, dayofyear(ts)::INTEGER AS day_of_year, year(ts)::INTEGER AS year, dayname(ts) AS day_name"

SQL: dict[str, str] = {
    "panel_hourly": f"WITH {PANEL} SELECT bus, zone, ts, round(pd, 6) AS pd FROM panel",
    "panel_spine_nulls": f"WITH {SPINE} SELECT bus, count(*) AS hours, count(pd) AS known, round(coalesce(sum(pd), 0), 6) AS total FROM spine GROUP BY bus",
    "zero_and_null_sums": f"WITH {SPINE} SELECT bus, hour(ts)::INTEGER AS h, day(ts)::INTEGER AS dom, round(coalesce(sum(pd), 0), 6) AS zero_sum, round(sum(pd), 6) AS null_sum FROM spine GROUP BY ALL",
    "he_to_timestamp": f"WITH {KEYED} SELECT bus, ts::DATE AS date, he, ts, round(pd, 6) AS pd FROM keyed",
    "scan_date_range_ids": "SELECT event_id, user_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND user_id IN (3, 5, 7, 11)",
    "head_sample": "SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id LIMIT 500",
    "value_range": "SELECT min(ts) AS low, max(ts) AS high FROM events",
    "file_inventory": "SELECT count(*) AS rows FROM events",
    "calendar_features": f"WITH {PANEL} SELECT bus, ts, {CAL} FROM panel",
    "cyclical_features": f"WITH {PANEL} SELECT bus, ts, " + ", ".join(f"round({f}(2 * pi() * {x}), 6) AS {k}_{f}" for k, x in (("hour", "hour(ts) / 24"), ("dow", "(isodow(ts) - 1) / 7"), ("doy", "(dayofyear(ts) - 1) / 366"), ("month", "(month(ts) - 1) / 12")) for f in ("sin", "cos")) + " FROM panel",
    "lag_rows": f"WITH {PANEL} SELECT bus, zone, ts, round(pd, 6) AS pd, round(lag(pd, 24) OVER {W_BUS}), 6) AS lag_24h_pd, round(lag(pd, 168) OVER {W_BUS}), 6) AS lag_168h_pd FROM panel",
    "lag_time": f"WITH {PANEL} SELECT bus, zone, ts, round(pd, 6) AS pd, round({TIME(24)}, 6) AS lag_24h_pd, round({TIME(168)}, 6) AS lag_168h_pd FROM panel",
    "rolling_features": f"WITH {PANEL} SELECT bus, ts, " + ", ".join(f"round(CASE WHEN count(pd) OVER {ROLL[n]} >= {m} THEN {f}(pd) OVER {ROLL[n]} END + 1e-9, 6) AS rolling_{n // 24}d_{k}_pd" for n, m in ((168, 42), (672, 168)) for k, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM panel",
    "expanding_mean_correct": f"WITH {KEYED} SELECT bus, ts, round(avg(pd) OVER ({SLOT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS hist FROM keyed",
    "expanding_mean_parity": f"WITH {SPINE}, k AS (SELECT *, hour(ts) + 1 AS he, isodow(ts) - 1 AS day_of_week FROM spine) SELECT bus, ts, round(CASE WHEN pd IS NOT NULL THEN (sum(pd) OVER ({SLOT} ROWS UNBOUNDED PRECEDING) - pd) / nullif(row_number() OVER ({SLOT}) - 1, 0) END, 6) AS hist FROM k",
    "zone_lag_correct": f"WITH {ZTOT} SELECT bus, p.ts, round(t, 6) AS zone_total_pd, round(l24, 6) AS zone_total_pd_lag_24h, round(l168, 6) AS zone_total_pd_lag_168h FROM panel p JOIN zl ON p.zone = zl.zone AND p.ts = zl.ts",
    "zone_lag_parity": f"WITH {PANEL}, t AS (SELECT *, sum(pd) OVER (PARTITION BY zone, ts) AS t FROM panel) SELECT bus, ts, round(t, 6) AS zone_total_pd, round(lag(t, 24) OVER (PARTITION BY zone ORDER BY ts, bus), 6) AS zone_total_pd_lag_24h, round(lag(t, 168) OVER (PARTITION BY zone ORDER BY ts, bus), 6) AS zone_total_pd_lag_168h FROM t",
    "boundary_mask": f"WITH {ZTOT}, f AS (SELECT p.bus, p.ts, lag(pd, 24) OVER (PARTITION BY bus ORDER BY p.ts) AS a, lag(pd, 168) OVER (PARTITION BY bus ORDER BY p.ts) AS b, CASE WHEN count(pd) OVER (PARTITION BY bus ORDER BY p.ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) >= 42 THEN avg(pd) OVER (PARTITION BY bus ORDER BY p.ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) END AS r, l24 FROM panel p JOIN zl ON p.zone = zl.zone AND p.ts = zl.ts), x AS (SELECT *, TIMESTAMP '2024-01-21 23:00:00' AS e FROM f) SELECT bus, ts, round(CASE WHEN ts - INTERVAL 24 HOUR <= e THEN a END + 1e-9, 6) AS lag_24h_pd, round(CASE WHEN ts - INTERVAL 168 HOUR <= e THEN b END + 1e-9, 6) AS lag_168h_pd, round(CASE WHEN ts <= e THEN r END + 1e-9, 6) AS rolling_7d_mean_pd, round(CASE WHEN ts - INTERVAL 24 HOUR <= e THEN l24 END + 1e-9, 6) AS zone_total_pd_lag_24h FROM x",
    "running_totals": f"WITH {PANEL} SELECT bus, ts, round(sum(pd) OVER {W_BUS} ROWS UNBOUNDED PRECEDING), 6) AS cum, (row_number() OVER {W_BUS}) - 1)::INTEGER AS seen, round(max(pd) OVER (PARTITION BY bus), 6) AS top FROM panel",
    "zone_reconciliation": f"WITH {PANEL}, z AS (SELECT (user_id % 12) % 4 AS zone, date_trunc('hour', ts) AS ts, sum(value) AS total FROM events GROUP BY ALL), b AS (SELECT zone, ts, sum(pd) AS member_sum FROM panel GROUP BY ALL) SELECT z.zone, z.ts, round(total, 6) AS total, round(member_sum, 6) AS member_sum, round(abs(total - member_sum), 6) AS diff FROM z LEFT JOIN b ON z.zone = b.zone AND z.ts = b.ts",
    "bus_share": f"WITH {KEYED}, {SHARE('keyed')} SELECT zone, bus, he, day_of_week, round(share, 6) AS share FROM sh",
    "share_fallback": f"WITH {KEYED}, tr AS (SELECT * FROM keyed WHERE ts <= TIMESTAMP '2024-01-08'), {SHARE('tr')}, bk AS (SELECT zone, bus, avg(share) AS b FROM sh GROUP BY ALL) SELECT k.bus, k.ts, round(coalesce(sh.share, bk.b, 0), 6) AS share FROM keyed k LEFT JOIN sh USING (zone, bus, he, day_of_week) LEFT JOIN bk USING (zone, bus) WHERE k.ts > TIMESTAMP '2024-01-08'",
    "zone_allocation": f"WITH {KEYED}, tr AS (SELECT * FROM keyed WHERE ts <= TIMESTAMP '2024-01-21 23:00:00'), {SHARE('tr')}, bk AS (SELECT zone, bus, avg(share) AS b FROM sh GROUP BY ALL), zt AS (SELECT zone, ts, he, day_of_week, sum(pd) AS z FROM tr GROUP BY ALL), zm AS (SELECT zone, he, day_of_week, avg(z) AS zp FROM zt GROUP BY ALL) SELECT k.bus, k.ts, round(greatest(0, coalesce(zp * coalesce(sh.share, bk.b, 0), 0)), 6) AS predicted_pd FROM keyed k LEFT JOIN sh USING (zone, bus, he, day_of_week) LEFT JOIN bk USING (zone, bus) LEFT JOIN zm USING (zone, he, day_of_week) WHERE k.ts > TIMESTAMP '2024-01-21 23:00:00'",
    "train_mean_override": f"WITH {KEYED}, m AS (SELECT bus, he, day_of_week, avg(pd) AS h FROM keyed WHERE ts <= TIMESTAMP '2024-01-21 23:00:00' GROUP BY ALL) SELECT k.bus, k.ts, round(h, 6) AS hist FROM keyed k LEFT JOIN m USING (bus, he, day_of_week) WHERE k.ts > TIMESTAMP '2024-01-21 23:00:00'",
    "baselines_long": f"WITH {LONG} SELECT bus, ts, model, round(p, 6) AS predicted_pd FROM long",
    "horizons": f"WITH {PRED}, h AS (SELECT * FROM (VALUES ('next_day', DATE '2024-01-22', DATE '2024-01-22'), ('next_week', DATE '2024-01-22', DATE '2024-01-28'), ('next_month', DATE '2024-01-22', DATE '2024-01-31')) t(horizon, a, b)) SELECT horizon, count(*) AS rows, round(sum(actual_pd), 6) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM pred JOIN h ON ts::DATE BETWEEN a AND b GROUP BY horizon",
    "metrics_zone": f"WITH {PRED} SELECT zone, {ERRORS} FROM pred GROUP BY zone",
    "metrics_zone_parity": f"WITH {PRED}, z AS (SELECT zone, ts, coalesce(sum(actual_pd), 0) AS actual_pd, coalesce(sum(predicted_pd), 0) AS predicted_pd FROM pred GROUP BY ALL) SELECT zone, {ERRORS} FROM z GROUP BY zone",
    "metrics_zone_coverage": f"WITH {PRED}, z AS (SELECT zone, ts, avg((predicted_pd IS NOT NULL)::INT) AS c FROM pred GROUP BY ALL) SELECT zone, round(avg(c), 6) AS coverage, count(*) AS hours FROM z GROUP BY zone",
    "metrics_keep_unpredicted": f"WITH {PRED} SELECT zone, round(sum(abs(actual_pd - predicted_pd)) / nullif(sum(abs(actual_pd)), 0), 6) AS wmape FROM pred GROUP BY zone",
    "error_distribution": f"WITH {PRED}, m AS (SELECT zone, bus, avg(abs(actual_pd - predicted_pd)) AS mae FROM pred GROUP BY ALL) SELECT zone, count(mae) AS members, round(avg(mae), 6) AS mean_mae, round(quantile_cont(mae, 0.5), 6) AS median_mae, round(stddev_samp(mae), 6) AS std_mae, round(min(mae), 6) AS min_mae, round(max(mae), 6) AS max_mae FROM m GROUP BY zone",
    "model_stability": f"WITH {LONG}, w AS (SELECT model, floor((day(ts) - 1) / 7) AS week, avg(abs(pd - p)) AS mae FROM long GROUP BY ALL) SELECT model, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS std, round(min(mae), 6) AS best FROM w GROUP BY model",
    "best_model": f"WITH {LONG}, w AS (SELECT bus, model, avg(abs(pd - p)) AS mae FROM long GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bus ORDER BY mae, model) AS k FROM w WHERE mae IS NOT NULL) SELECT bus, model, round(mae, 6) AS mae FROM r WHERE k = 1",
    "he_profile_pivot": f"WITH {KEYED} SELECT bus, " + ", ".join(f"round(avg(pd) FILTER (he = {k}), 6) AS h{k}" for k in range(1, 25)) + " FROM keyed GROUP BY bus",
    "profile_interpolate": f"WITH {KEYED}, g AS (SELECT bus, he, CASE WHEN (he + bus) % 5 <> 0 THEN avg(pd) END AS m FROM keyed GROUP BY bus, he), n AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN he END) OVER (PARTITION BY bus ORDER BY he ROWS UNBOUNDED PRECEDING) AS x0, min(CASE WHEN m IS NOT NULL THEN he END) OVER (PARTITION BY bus ORDER BY he ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM g) SELECT n.bus, n.he, round(n.m, 6) AS m, round(coalesce(n.m, a.m + (b.m - a.m) * (n.he - x0)::DOUBLE / nullif(x1 - x0, 0), a.m, b.m, 0), 6) AS filled FROM n LEFT JOIN g a ON a.bus = n.bus AND a.he = x0 LEFT JOIN g b ON b.bus = n.bus AND b.he = x1",
    "profile_zscore": f"WITH {KEYED}, g AS (SELECT bus, he, avg(pd) AS m FROM keyed GROUP BY ALL) SELECT bus, he, round(m, 6) AS m, round(coalesce((m - avg(m) OVER (PARTITION BY bus)) / nullif(stddev_pop(m) OVER (PARTITION BY bus), 0), 0), 6) AS z FROM g",
    "month_year_pivot": "SELECT month(l_shipdate)::INTEGER AS month, " + ", ".join(f"round(avg(l_quantity) FILTER (year(l_shipdate) = {y}), 6) AS y{y}" for y in range(1995, 2002)) + " FROM lineitem GROUP BY 1",
    "month_year_long": "SELECT month(l_shipdate)::INTEGER AS month, year(l_shipdate)::INTEGER AS year, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL",
    "topn_groups": "SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY user_id ORDER BY sum(value) DESC NULLS LAST, user_id LIMIT 25",
    "mode_zone": "WITH c AS (SELECT user_id % 12 AS bus, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT bus, arg_min(event_type, (-n, event_type)) AS main_type FROM c GROUP BY bus",
    "column_profile": "WITH o AS (SELECT o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b, o_orderstatus AS c, nullif(o_orderpriority, '5-LOW') AS d FROM orders), u AS (SELECT 'o_orderkey' AS col, a AS v FROM o UNION ALL SELECT 'o_custkey', b FROM o UNION ALL SELECT 'o_orderstatus', c FROM o UNION ALL SELECT 'o_orderpriority', d FROM o) SELECT col AS \"column\", count(*) AS rows, count(v) AS non_null, count(*) - count(v) AS nulls, count(*) FILTER (trim(v) = '') AS blanks, round((count(*) - count(v) + count(*) FILTER (trim(v) = '')) * 100.0 / count(*), 6)::DOUBLE AS missing_pct, count(DISTINCT v) AS distinct_values, count(DISTINCT v) + (count(v) < count(*))::INT AS distinct_with_null FROM u GROUP BY col",
    "column_examples": "SELECT 'n_nationkey' AS \"column\", min(n_nationkey::VARCHAR) AS example FROM nation UNION ALL SELECT 'n_name', min(n_name) FROM nation UNION ALL SELECT 'n_regionkey', min(n_regionkey::VARCHAR) FROM nation",
    "anomaly_checks": "WITH r AS (SELECT CASE WHEN p_size % 7 = 0 THEN ' ' || p_name WHEN p_size % 11 = 0 THEN '  ' ELSE p_name END AS n, p_size % 5 = 0 AS bad, p_size % 3 = 0 AS back FROM part) SELECT 'trim_changes:name' AS \"check\", count(*) FILTER (trim(n) <> n) AS found FROM r UNION ALL SELECT 'blank:name', count(*) FILTER (trim(n) = '') FROM r UNION ALL SELECT 'unreadable:early', count(*) FILTER (bad) FROM r UNION ALL SELECT 'unreadable:late', 0 FROM r GROUP BY 1 UNION ALL SELECT 'late_before_early', count(*) FILTER (back AND NOT bad) FROM r",
    "duplicate_counts": "SELECT 'order' AS \"check\", count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_rows, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem UNION ALL SELECT 'order_part', count(*), count(DISTINCT (l_orderkey, l_partkey)), count(*) - count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem UNION ALL SELECT 'row', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
    "frequencies": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "named_aggregates": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_q, max(l_quantity) AS max_q, round(sum(l_tax), 6) AS sum_tax FROM lineitem GROUP BY 1",
    "quantile_flag": f"WITH {PANEL} SELECT bus, count(*) FILTER (pd >= (SELECT quantile_cont(pd, 0.9) FROM panel)) AS peaks, count(*) AS hours FROM panel GROUP BY bus",
    "abs_sort_top": "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 30",
    "top_k_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3",
    "first_known_value": "SELECT user_id % 12 AS bus, arg_min(event_type, event_id) FILTER (event_id % 3 = 0) AS a, round(arg_min(value, event_id) FILTER (event_id % 4 = 0), 6) AS b FROM events GROUP BY 1",
    "hash_sample_strata": "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 20",
    "union_padded": "WITH u AS (SELECT c_mktsegment, c_acctbal AS bal FROM customer UNION ALL SELECT NULL, s_acctbal FROM supplier) SELECT c_mktsegment, count(*) AS n, round(sum(bal), 4) AS total FROM u GROUP BY 1",
    "row_reductions": "SELECT l_orderkey, l_linenumber, round(greatest(l_discount, l_tax), 6) AS top, round((l_discount + l_tax) / 2, 6) AS mean, round(coalesce(l_tax, 0), 6) AS tax FROM lineitem",
    "clean_column_names": "SELECT r_regionkey, r_name FROM region",
    "safe_numbers": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id::DOUBLE END AS n, round(value / nullif(event_id % 3, 0), 6) AS q, round(least(10, greatest(0, value - 50)), 6) AS c, abs(value - round(value, 3)) <= 1e-8 + 1e-5 * abs(round(value, 3)) AS close FROM events",
    "sequence_windows": f"WITH {PANEL}, s AS (SELECT bus, ts, pd, list(pd) OVER (PARTITION BY bus ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS q FROM panel) SELECT bus, ts, len(q)::INTEGER AS n, round(list_sum(q), 6) AS total, round(q[1], 6) AS oldest, round(pd, 6) AS target FROM s WHERE len(q) = 24",
    "rolling_origins": "SELECT d::DATE AS target_date, d::TIMESTAMP - INTERVAL 1 HOUR AS created_at FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(d)",
    "fold_table": "SELECT (k + 1)::INTEGER AS fold, DATE '2024-01-01' AS train_start, (DATE '2024-01-14' + INTERVAL (4 * k) DAY)::DATE AS train_end, (DATE '2024-01-15' + INTERVAL (4 * k) DAY)::DATE AS validate_start, (DATE '2024-01-18' + INTERVAL (4 * k) DAY)::DATE AS validate_end, TIMESTAMP '2024-01-14 23:00:00' + INTERVAL (4 * k) DAY AS created_at FROM range(4) t(k)",
    "quantile_band": f"WITH {PRED}, b AS (SELECT zone, quantile_cont(actual_pd - predicted_pd, 0.1) AS l, quantile_cont(actual_pd - predicted_pd, 0.5) AS m, quantile_cont(actual_pd - predicted_pd, 0.9) AS h FROM pred WHERE day(ts) <= 26 GROUP BY zone), r AS (SELECT zone, actual_pd, least(predicted_pd + l, predicted_pd + m) AS lo, greatest(predicted_pd + h, predicted_pd + m) AS hi FROM pred JOIN b USING (zone) WHERE day(ts) > 26) SELECT zone, round(avg((actual_pd BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM r GROUP BY zone",
    "walk_forward": f"WITH {PANEL}, l AS (SELECT *, lag(pd, 168) OVER {W_BUS}) AS g FROM panel), f AS (SELECT k + 1 AS fold, DATE '2024-01-15' + INTERVAL (4 * k) DAY AS a, TIMESTAMP '2024-01-14 23:00:00' + INTERVAL (4 * k) DAY AS e FROM range(4) t(k)), p AS (SELECT fold::INTEGER AS fold, zone, pd AS actual_pd, CASE WHEN ts - INTERVAL 168 HOUR <= e THEN g END AS predicted_pd FROM l JOIN f ON ts >= a AND ts < a + INTERVAL 4 DAY) SELECT fold, zone, {ERRORS} FROM p GROUP BY ALL",
    "prediction_schema": f"WITH {PRED} SELECT 'baseline_lag_168h' AS model_name, TIMESTAMP '2024-01-21 23:00:00' AS forecast_created_at, ts::DATE AS target_date, (hour(ts) + 1)::INTEGER AS he, bus AS bus_id, zone AS zone_id, round(predicted_pd, 6) AS predict_pd FROM pred",
}
QUERIES = {n: globals()[n] for n in SQL}
