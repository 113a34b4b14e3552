"""Queries over readers and sinks, null rules, score formulas, claims and model selection."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import nulls as N
from panelforge.functions import similarity as S
from panelforge.operators import geo as G
from panelforge.operators import graph as GR
from panelforge.operators import ml
from panelforge.operators import selection as SEL
from panelforge.plans.match_queries import BAND, DIST, EDGE, edges, nodes
from panelforge.plans.panel_queries import ERRORS, PRED, _t, panel, predictions, r6
from panelforge.sources import io
from panelforge.sources.shared import shared_dir


def _new(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"


# readers and sinks: written to the shared folder and read back under fixed schemas

def csv_customers(s, d):
    at = _new(s, "csv")
    io.write_csv(_t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), at)
    return io.read_csv(s, at, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")


def _node_file(s: SparkSession, d: str) -> str:
    at, text, number = _new(s, "nodes"), F.lit("x"), F.lit(1.0)
    name = F.concat(F.lit("Bus "), F.col("s_suppkey") % 40)
    rows = _t(s, d, "supplier").select(F.lit("1").alias("MDB_ID"), name.alias("NAME"), (F.col("s_nationkey") % 4 * 100.0 + 69).alias("BASKV"), F.col("s_suppkey").cast("string").alias("IDE"), text.alias("AREA_NAME"), text.alias("ZONE_NAME"), (number * F.col("s_suppkey") / 8).alias("LAT"), F.when(F.col("s_suppkey") % 5 != 0, -number).alias("LON"))
    io.write_csv(rows, at)
    return at


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return GR.standard_nodes(io.read_csv(s, _node_file(s, d), io.NODE_SCHEMAS["left"]).withColumn("row", F.col("IDE").cast("long")), "row")


def csv_nodes(s, d):
    """A node table of the published layout, standardised: the id holds the row number."""
    return _nodes(s, d).select("id", "row", "name", "kv", "lat", "lon", "norm", "band")


def csv_branches(s, d):
    """Branch ends by raw, then by normalised name; of equal names the last row counts."""
    at, text, none = _new(s, "branches"), F.lit("b"), F.lit(None).cast("double")
    ends = [F.concat(F.lit("Bus "), F.col("s_suppkey") % 40), F.concat(F.lit("BUS-"), F.col("s_suppkey") % 60)]
    known = {"MDB_ID": F.col("s_suppkey").cast("string"), "FROM_BUS": ends[0], "TO_BUS": ends[1]}
    columns = [c.split() for c in io.BRANCH_SCHEMAS["left"].split(", ")]
    io.write_csv(_t(s, d, "supplier").select(*[known.get(c, text if kind == "string" else none).alias(c) for c, kind in columns]), at)
    rows = io.read_csv(s, at, io.BRANCH_SCHEMAS["left"]).select("MDB_ID", "FROM_BUS", "TO_BUS")
    return GR.resolve_endpoints(rows, _nodes(s, d), ("FROM_BUS", "TO_BUS")).select(F.col("MDB_ID").cast("long").alias("branch"), "src", "dst")


def _year_folder(s: SparkSession, d: str) -> str:
    at = _new(s, "panel")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = _t(s, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("bus_unique_id"), F.col("l_returnflag").alias("bus_type"), F.lit(138.0).alias("base_kv"), F.col("l_linestatus").alias("zone_name"),
        F.col("l_quantity").alias("pd"), F.lit(None).cast("double").alias("pg"), day.alias("date"), (F.col("l_linenumber") * 3).alias("he"), F.year("l_shipdate").alias("_y"),
    )
    rows = rows.persist()
    for y in (1996, 1997, 1998):
        io.write_table(rows.where(F.col("_y") == y).drop("_y"), f"{at}/bus_load_{y}.parquet")
    rows.unpersist()
    return at


def yearly_members(s, d):
    """A date window and some members out of yearly files; years without a file are passed over."""
    rows = io.read_level(s, _year_folder(s, d), "bus", "1996-11-15", "1999-02-01", ids=["1", "2", "3", "5"])
    return rows.select("id", "bus_unique_id", "zone_name", "pd", "date", "he", "timestamp")


def yearly_totals(s, d):
    """The whole window without a member list: sums by zone."""
    rows = io.read_level(s, _year_folder(s, d), "bus", "1996-01-01", "1998-12-31")
    return r6(rows.groupBy("zone_name").agg(F.count("*").alias("rows"), F.sum("pd").alias("pd")), "pd")


def footer_inventory(s, d):
    parts = [io.inventory(s, f"{d}/{t}.parquet", t).groupBy("kind").agg(F.sum("rows").cast("long").alias("rows"), F.max("columns").cast("long").alias("columns")) for t in ("orders", "lineitem", "documents")]
    return GR.union_all(*parts)


def report_lines(s, d):
    """A run's report, written as text and read back."""
    at = _new(s, "report")
    io.write_text(s, io.report("run", {"regions": _t(s, d, "region").orderBy("r_regionkey")}), at)
    return s.read.text(at).select(F.col("value").alias("line"))


def json_settings(s, d):
    """Settings written as JSON and read back."""
    at = _new(s, "settings")
    io.RunConfig(name="x", members=[3, 5], clusters=2).save(s, at)
    c = io.RunConfig.load(s, at)
    return s.createDataFrame([(c.name, c.model, c.horizon, json.dumps(c.members), c.clusters)], "name string, model string, horizon string, members string, clusters long")


def found_review_file(s, d):
    """The reviewed file under its misspelt name, a folder below."""
    at = _new(s, "review")
    io.write_csv(_t(s, d, "region").select("r_name"), f"{at}/sub/bus_mapping_manual_reveiwed_extended.csv")
    return io.read_csv(s, io.find_review_file(s, at), "r_name string")


# null rules

def typed_fill(s, d):
    rows = _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.when(F.col("toxic") == 1, True).alias("flag"), F.when(F.col("quality") == 1, F.lit("high")).alias("label"))
    return N.fill_typed(rows, {"quality": 0, "flag": True, "label": "low"})


def null_columns(s, d):
    rows = _t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return N.null_out(rows, F.nullif("o_orderstatus", F.lit("P")) == "F", ["o_orderstatus", "o_orderpriority"])


def dropped_rows(s, d):
    rows = _t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("a"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("b"))
    any_ = rows.dropna("any", subset=["a", "b"]).select("p_partkey", F.lit("any").alias("rule"))
    return any_.unionByName(rows.dropna("all", subset=["a", "b"]).select("p_partkey", F.lit("all").alias("rule")))


def text_predicates(s, d):
    return _t(s, d, "lineitem").where("l_returnflag == 'R' and l_quantity > 40 and l_linenumber in (1, 2)").select("l_orderkey", "l_linenumber", "l_quantity")


def row_flags(s, d):
    rows = _t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size") > 20).alias("a"), (F.col("p_size") % 7 == 0).alias("b"))
    return rows.withColumn("any_flag", N.row_any("a", "b")).select("p_partkey", "any_flag")


def varying_columns(s, d):
    rows = _t(s, d, "part").select("p_size", "p_brand", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"))
    return s.createDataFrame([(c,) for c in N.drop_constant(rows, rows.columns)], "column string")


# scores

def score_formulas(s, d):
    """The weighted scores and their parts on made-up inputs."""
    x = lambda a, m: (F.col("p_partkey") * a % m).cast("double")
    rows = _t(s, d, "part").select(
        "p_partkey", (x(7, 101) / 100).alias("voltage_score"), (x(11, 101) / 100).alias("name_score"), (x(13, 101) / 100).alias("profile_similarity"), (x(17, 101) / 100).alias("neighbour_similarity"),
        F.when(F.col("p_partkey") % 9 != 0, x(3, 90)).alias("km"), x(5, 8).alias("da"), x(3, 7).alias("db"), (F.col("p_partkey") % 4).alias("support"),
    )
    rows = rows.withColumns({"distance_score": S.distance_score("km", 20.0), "degree_similarity": S.degree_similarity("da", "db")})
    rows = rows.withColumn("topology_score", S.weighted_score(rows, S.TOPOLOGY))
    rows = rows.withColumn("composite", S.weighted_score(rows, S.COMPOSITE))
    consistency, spread = S.propagation_score("composite", F.col("voltage_score"), F.col("name_score"), F.col("support"))
    rows = rows.withColumns({"conflict": S.evidence_conflict("voltage_score", "km", "name_score", "topology_score"), "consistency": consistency, "spread": spread, "profile": S.profile_similarity([F.col("da"), F.col("db"), F.lit(0.0), F.lit(1.0)], [F.col("db"), F.col("da"), F.lit(2.0), F.lit(0.0)])})
    names = ["distance_score", "degree_similarity", "topology_score", "composite", "consistency", "spread", "profile"]
    return r6(rows.select("p_partkey", "conflict", *names), *names)


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Scored pairs: the nearest right nodes with made-up name and topology scores."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = G.nearest_join(l, r, 6).withColumn("distance_rank", F.row_number().over(W.partitionBy("left_id").orderBy("distance_km", "right_id")))
    pairs = GR.attribute_features(pairs, l, r, fuzzy=False).drop("name_score")
    x = lambda a, b: ((F.col("left_id") * a + F.col("right_id") * b) % 101 / 100).cast("double")
    return GR.composite(pairs.withColumns({"name_score": x(7, 3), "topology_score": x(5, 11)}))


def claim_ranks(s, d):
    return r6(_claims(s, d).select("left_id", "right_id", "rank", "composite", "gap", "conflict", "ambiguous", "label"), "composite", "gap")


def claims_one_to_one(s, d):
    return r6(GR.one_to_one(_claims(s, d)).select("left_id", "right_id", "composite", "ambiguous", "label", "lost"), "composite")


def claim_seeds(s, d):
    return r6(GR.seeds(_claims(s, d), rule={"score": 0.6, "gap": 0.02, "voltage": 0.65, "km": 60.0}), "score")


def neighbour_support(s, d):
    """Support of near pairs by a given mapping: every third node is mapped to itself."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = G.nearest_join(l, r, 4).withColumn("composite", (F.col("left_id") + F.col("right_id")) % 101 / 100.0)
    accepted = l.where(F.col("id") % 3 == 0).select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    out = GR.support(pairs, accepted, edges(s, d, 1), edges(s, d, 0))
    return r6(out.select("left_id", "right_id", "support", "consistency", "spread_score"), "consistency", "spread_score")


def variant_counts(s, d):
    """The summary of the nearest-candidate variant."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = G.nearest_join(l, r, 1).withColumn("distance_rank", F.lit(1))
    rows = GR.nearest_only(GR.attribute_features(pairs, l, r, fuzzy=False)).withColumn("variant", F.lit(GR.NEAREST))
    return r6(GR.summary(rows, ["variant"]), "voltage_exact_rate", "voltage_conflict_rate", "median_km", "p90_km", "ambiguity_rate")


def match_lines(s, d):
    """Plot data: the line between each left node and its nearest right node."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    return r6(GR.match_lines(G.nearest_join(l, r, 1), l, r), "left_lat", "left_lon", "right_lat", "right_lon")


# clusters, run times, selection

def _rule_clusters(s: SparkSession, d: str) -> DataFrame:
    return panel(s, d).where("bus < 9").groupBy("bus").agg((F.col("bus") % 3).alias("kmeans_cluster"), F.lit(0.5).alias("kmeans_confidence"))


def cluster_attach(s, d):
    return ml.attach_clusters(panel(s, d).select("bus").distinct(), _rule_clusters(s, d), "bus")


def cluster_members(s, d):
    members = panel(s, d).groupBy("bus").agg(F.min("zone").alias("zone"), F.avg("pd").alias("average_pd"))
    return r6(ml.cluster_summary(_rule_clusters(s, d), members, "bus", "zone", "average_pd"), "mean_load")


def clusters_off(s, d):
    return r6(ml.no_clusters(panel(s, d), "bus", "zone", "pd"), "average_pd")


def model_cluster_errors(s, d):
    """A row a model, a column a cluster."""
    rows = predictions(s, d).withColumns({"model": F.concat(F.lit("m"), F.col("bus") % 2), "cluster": F.concat(F.lit("c"), F.col("bus") % 3)})
    return r6(SEL.cluster_pivot(rows, "model", "cluster"), "c0", "c1", "c2")


def runtime_rows(s, d):
    """Errors beside the seconds of a log; a model without a row, or one that was skipped, has none."""
    rows = predictions(s, d).withColumns({"fold": F.lit("f"), "model": F.concat(F.lit("m"), F.col("bus") % 3)})
    log = s.createDataFrame([("f", "m0", "ok", 1.5, None), ("f", "m1", "skipped", 0.5, "E")], "fold string, model string, status string, seconds double, error string")
    return r6(SEL.runtime_join(SEL.ME.metrics(rows, ["fold", "model"]), log), "mae", "rmse", "wmape")


def rationale(s, d):
    """How many subjects of each kind the published choice names."""
    return SEL.rationale(s).groupBy("kind").agg(F.count("*").alias("subjects"))


FOLDS = [SEL.Fold("first", date(2024, 1, 1), date(2024, 1, 14), date(2024, 1, 15), date(2024, 1, 21)), SEL.Fold("holdout", date(2024, 1, 1), date(2024, 1, 21), date(2024, 1, 22), date(2024, 1, 30))]


def _selection(s: SparkSession, d: str) -> SEL.Selection:
    return SEL.select_models(panel(s, d), FOLDS, {"ridge": ("ridge", None), "elastic_net": ("elastic_net", None), "missing": ("no such model", None)}, ("ridge", None), clusters=3)


def selection_errors(s, d):
    """Walk-forward folds over baselines, member models and a zone model with allocation."""
    return _selection(s, d).with_runtime().drop("seconds")


def selection_levels(s, d):
    return _selection(s, d).levels({f.name: f for f in FOLDS})


def selection_clusters(s, d):
    return _selection(s, d).by_cluster()


def selection_log(s, d):
    """What ran and what was skipped, with the scope of each fold."""
    made = _selection(s, d)
    return made.scope.join(made.runtime.groupBy("fold").agg(F.count_if(F.col("status") == "ok").alias("ran"), F.count_if(F.col("status") == "skipped").alias("skipped")), "fold")


def zone_model_forecast(s, d):
    """A zone model's forecast dealt out to members by their shares."""
    rows, fold = panel(s, d), FOLDS[1]
    train, test = SEL.member_frames(rows, fold)
    return SEL.zone_allocated(rows, train, test, fold, "ridge")


X = lambda a, m: f"((p_partkey * {a}) % {m})::DOUBLE"
FORM = f"""f0 AS (SELECT p_partkey, {X(7, 101)} / 100 AS v, {X(11, 101)} / 100 AS n, {X(13, 101)} / 100 AS p, {X(17, 101)} / 100 AS q, CASE WHEN p_partkey % 9 <> 0 THEN {X(3, 90)} END AS km, {X(5, 8)} AS da, {X(3, 7)} AS db, p_partkey % 4 AS sup FROM part),
f1 AS (SELECT *, coalesce(exp(-km / 20), 0) AS ds, 1 - abs(da - db) / greatest(1, da, db) AS deg FROM f0), f2 AS (SELECT *, 0.45::DOUBLE * p + 0.35::DOUBLE * q + 0.2::DOUBLE * deg AS t FROM f1),
f3 AS (SELECT *, 0.3::DOUBLE * ds + 0.25::DOUBLE * v + 0.25::DOUBLE * n + 0.2::DOUBLE * t AS c, 0.65::DOUBLE * v + 0.35::DOUBLE * n AS cons FROM f2)"""
CLAIM = f"""WITH {DIST}, k AS (SELECT left_id, right_id, km, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS dr FROM dist),
p AS (SELECT k.*, exp(-km / 20) AS ds, CASE WHEN l.kv = r.kv THEN 1.0 WHEN {BAND('l.kv')} = {BAND('r.kv')} THEN 0.65 ELSE 0.0 END::DOUBLE AS v, ((left_id * 7 + right_id * 3) % 101 / 100)::DOUBLE AS n, ((left_id * 5 + right_id * 11) % 101 / 100)::DOUBLE AS t FROM k JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id WHERE dr <= 6),
c AS (SELECT *, 0.3::DOUBLE * ds + 0.25::DOUBLE * v + 0.25::DOUBLE * n + 0.2::DOUBLE * t AS c, v < 0.65::DOUBLE OR km > 50 OR (n < 0.25::DOUBLE AND t < 0.45::DOUBLE) AS conflict FROM p),
r AS (SELECT *, row_number() OVER w AS rank, lead(c) OVER w AS nx FROM c WINDOW w AS (PARTITION BY left_id ORDER BY c DESC, v DESC, n DESC, dr, right_id)),
g AS (SELECT *, CASE WHEN rank = 1 THEN c - coalesce(nx, 0) END AS gap FROM r),
a AS (SELECT *, rank = 1 AND (gap < 0.05::DOUBLE OR conflict) AS amb FROM g),
z AS (SELECT *, CASE WHEN amb THEN 'ambiguous' WHEN c >= 0.85::DOUBLE AND gap >= 0.05::DOUBLE THEN 'high' WHEN c >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS label FROM a)"""
EDGE0 = EDGE.replace("e AS (", "e0 AS (", 1).replace("l_linenumber % 2 = 1", "l_linenumber % 2 = 0")
YEARS = "SELECT l_orderkey AS id, l_suppkey::VARCHAR AS bus_unique_id, l_linestatus AS zone_name, l_quantity AS pd, strftime(l_shipdate, '%Y-%m-%d') AS date, (l_linenumber * 3)::INTEGER AS he, date_trunc('day', l_shipdate) + to_hours(l_linenumber * 3 - 1) AS \"timestamp\" FROM lineitem"

SQL: dict[str, str] = {
    "csv_customers": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "csv_nodes": f"WITH x AS (SELECT '1_' || s_suppkey AS id, s_suppkey AS row, 'Bus ' || (s_suppkey % 40) AS name, s_nationkey % 4 * 100.0::DOUBLE + 69 AS kv, s_suppkey / 8.0::DOUBLE AS lat, CASE WHEN s_suppkey % 5 <> 0 THEN -1.0 END::DOUBLE AS lon FROM supplier) SELECT id, row, name, kv, lat, lon, lower(name) AS norm, {BAND('kv')} AS band FROM x",
    "csv_branches": "WITH n AS (SELECT s_suppkey % 40 AS k, '1_' || max(s_suppkey) AS id FROM supplier GROUP BY 1) SELECT s_suppkey AS branch, a.id AS src, b.id AS dst FROM supplier LEFT JOIN n a ON a.k = s_suppkey % 40 LEFT JOIN n b ON b.k = s_suppkey % 60",
    "yearly_members": f"SELECT * FROM ({YEARS}) WHERE date BETWEEN '1996-11-15' AND '1998-12-31' AND bus_unique_id IN ('1', '2', '3', '5')",
    "yearly_totals": f"SELECT zone_name, count(*) AS rows, round(sum(pd), 6) AS pd FROM ({YEARS}) WHERE date BETWEEN '1996-01-01' AND '1998-12-31' GROUP BY 1",
    "footer_inventory": "SELECT 'orders' AS kind, count(*) AS rows, 6::BIGINT AS columns FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'documents', count(*), 5 FROM documents",
    "report_lines": "SELECT unnest(['# run', '', '## regions', '', '| r_regionkey | r_name |', '| --- | --- |', '']) AS line UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
    "json_settings": "SELECT 'x' AS name, 'random_forest' AS model, 'next_week' AS horizon, '[3, 5]' AS members, 2::BIGINT AS clusters",
    "found_review_file": "SELECT r_name FROM region",
    "typed_fill": "SELECT doc_id, coalesce(quality, 0) AS quality, true AS flag, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "null_columns": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders",
    "dropped_rows": "SELECT p_partkey, 'any' AS rule FROM part WHERE p_size % 6 = 0 UNION ALL SELECT p_partkey, 'all' FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0",
    "text_predicates": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_linenumber <= 2",
    "row_flags": "SELECT p_partkey, coalesce(p_size % 2 = 0 AND p_size > 20, false) OR p_size % 7 = 0 AS any_flag FROM part",
    "varying_columns": "SELECT unnest(['p_size', 'p_brand']) AS \"column\"",
    "score_formulas": f"WITH {FORM} SELECT p_partkey, v < 0.65::DOUBLE OR coalesce(km > 50, false) OR (n < 0.25::DOUBLE AND t < 0.45::DOUBLE) AS conflict, round(ds, 6) AS distance_score, round(deg, 6) AS degree_similarity, round(t, 6) AS topology_score, round(c, 6) AS composite, round(cons, 6) AS consistency, round(greatest(0, least(1, 0.72::DOUBLE * c + 0.28::DOUBLE * cons + CASE WHEN sup >= 2 THEN 0.1 WHEN sup = 1 THEN 0.05 ELSE 0 END::DOUBLE)), 6) AS spread, round(2 * least(da, db) / (2 * greatest(da, db) + 3), 6) AS profile FROM f3",
    "claim_ranks": CLAIM + " SELECT left_id, right_id, rank::INTEGER AS rank, round(c, 6) AS composite, round(gap, 6) AS gap, conflict, amb AS ambiguous, label FROM z",
    "claims_one_to_one": CLAIM + ", t AS (SELECT left_id, CASE WHEN c >= 0.45::DOUBLE THEN right_id END AS right_id, c, amb, label FROM z WHERE rank = 1), u AS (SELECT *, right_id IS NOT NULL AND row_number() OVER (PARTITION BY right_id ORDER BY c DESC, left_id) > 1 AS lost FROM t) SELECT left_id, CASE WHEN NOT lost THEN right_id END AS right_id, round(c, 6) AS composite, amb OR lost AS ambiguous, CASE WHEN lost THEN 'ambiguous' ELSE label END AS label, lost FROM u",
    "claim_seeds": CLAIM + ", t AS (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY c DESC, left_id) AS k FROM z WHERE rank = 1 AND c >= 0.6::DOUBLE AND gap >= 0.02::DOUBLE AND v >= 0.65::DOUBLE AND km <= 60 AND NOT amb) SELECT left_id, right_id, round(c, 6) AS score FROM t WHERE k = 1",
    "neighbour_support": f"WITH {DIST}, {EDGE}, {EDGE0}, k AS (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS dr FROM dist), p AS (SELECT left_id, right_id, (left_id + right_id) % 101 / 100.0::DOUBLE AS c FROM k WHERE dr <= 4), m AS (SELECT id FROM n WHERE id % 3 = 0), ml AS (SELECT src AS id, count(*) AS c FROM e JOIN m ON m.id = e.dst GROUP BY 1), mr AS (SELECT src AS id, count(*) AS c FROM e0 JOIN m ON m.id = e0.dst GROUP BY 1), s AS (SELECT p.left_id, p.right_id, count(*) AS s FROM p JOIN e ON e.src = p.left_id JOIN m ON m.id = e.dst JOIN e0 ON e0.src = p.right_id AND e0.dst = m.id GROUP BY ALL), x AS (SELECT p.*, coalesce(s.s, 0) AS sup, 0.65::DOUBLE * coalesce(s.s::DOUBLE / ml.c, 0) + 0.35::DOUBLE * coalesce(s.s::DOUBLE / mr.c, 0) AS cons FROM p LEFT JOIN s USING (left_id, right_id) LEFT JOIN ml ON ml.id = p.left_id LEFT JOIN mr ON mr.id = p.right_id) SELECT left_id, right_id, sup AS support, round(cons, 6) AS consistency, round(greatest(0, least(1, 0.72::DOUBLE * c + 0.28::DOUBLE * cons + CASE WHEN sup >= 2 THEN 0.1 WHEN sup = 1 THEN 0.05 ELSE 0 END::DOUBLE)), 6) AS spread_score FROM x",
    "variant_counts": f"WITH {DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS dr FROM dist), t AS (SELECT k.*, abs(l.kv - r.kv) AS gap, count(*) OVER (PARTITION BY right_id) > 1 AS amb FROM k JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id WHERE dr = 1) SELECT 'A_pure_latlon_nearest' AS variant, count(*) AS matched, 0::BIGINT AS unmatched, count(*) - count(DISTINCT right_id) AS duplicates, round(avg((gap < 1e-9)::INT), 6) AS voltage_exact_rate, round(avg((gap > 1)::INT), 6) AS voltage_conflict_rate, round(quantile_cont(km, 0.5), 6) AS median_km, round(quantile_cont(km, 0.9), 6) AS p90_km, count(*) FILTER (amb) AS ambiguous_rows, round(avg(amb::INT), 6) AS ambiguity_rate FROM t",
    "match_lines": f"WITH {DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS dr FROM dist) SELECT left_id, right_id, round(l.lat, 6)::DOUBLE AS left_lat, round(l.lon, 6)::DOUBLE AS left_lon, round(r.lat + 0.01, 6)::DOUBLE AS right_lat, round(r.lon + 0.01, 6)::DOUBLE AS right_lon FROM k JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id WHERE dr = 1",
    "cluster_attach": "SELECT DISTINCT user_id % 12 AS bus, CASE WHEN user_id % 12 < 9 THEN (user_id % 12 % 3)::VARCHAR ELSE 'unknown' END AS kmeans_cluster, CASE WHEN user_id % 12 < 9 THEN 0.5 ELSE 0 END::DOUBLE AS kmeans_confidence FROM events",
    "cluster_members": "WITH p AS (SELECT user_id % 12 AS bus, user_id % 12 % 4 AS zone, sum(value) AS pd FROM events GROUP BY ALL, date_trunc('hour', ts)), m AS (SELECT bus, zone, avg(pd) AS a FROM p WHERE bus < 9 GROUP BY ALL) SELECT bus % 3 AS kmeans_cluster, count(*) AS members, round(avg(a), 6) AS mean_load, min(zone) AS main_zone FROM m GROUP BY 1".replace("GROUP BY ALL, date_trunc('hour', ts)", "GROUP BY 1, 2, date_trunc('hour', ts)"),
    "clusters_off": "WITH p AS (SELECT user_id % 12 AS bus, user_id % 12 % 4 AS zone, sum(value) AS pd FROM events GROUP BY 1, 2, date_trunc('hour', ts)) SELECT bus, 'disabled' AS kmeans_cluster, 0.0::DOUBLE AS kmeans_confidence, min(zone) AS zone, round(avg(pd), 6) AS average_pd FROM p GROUP BY bus",
    "model_cluster_errors": f"WITH {PRED} SELECT 'm' || (bus % 2) AS model, " + ", ".join(f"round(avg(abs(actual_pd - predicted_pd)) FILTER (bus % 3 = {k}), 6) AS c{k}" for k in range(3)) + " FROM pred GROUP BY 1",
    "runtime_rows": f"WITH {PRED} SELECT 'f' AS fold, 'm' || (bus % 3) AS model, {ERRORS}, CASE WHEN bus % 3 = 0 THEN 1.5 END::DOUBLE AS seconds FROM pred GROUP BY bus % 3",
    "rationale": "SELECT unnest(['retained', 'deferred', 'note']) AS kind, unnest([6, 5, 2])::BIGINT AS subjects",
}
_OWN = """csv_customers csv_nodes csv_branches yearly_members yearly_totals footer_inventory report_lines json_settings found_review_file typed_fill null_columns dropped_rows
text_predicates row_flags varying_columns score_formulas claim_ranks claims_one_to_one claim_seeds neighbour_support variant_counts match_lines cluster_attach cluster_members clusters_off
model_cluster_errors runtime_rows rationale selection_errors selection_levels selection_clusters selection_log zone_model_forecast""".split()
QUERIES = {n: globals()[n] for n in _OWN}
