"""Entity matching over three naming styles of ``part``, and graph alignment over two supplier graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import similarity as S
from panelforge.functions import text as X
from panelforge.operators import geo as G
from panelforge.operators import graph as GR
from panelforge.operators import matching as M
from panelforge.operators import metrics as ME
from panelforge.operators import profiling as PR
from panelforge.operators import relational as R
from panelforge.plans.panel_queries import _t, r6
from panelforge.sources.shared import checkpointed, dealt_by_some_keys, stored


def kv_of() -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (69, 138, 345, 500)]), (F.col("p_size") % 4 + 1).cast("int"))


def styles() -> dict[str, Column]:
    """Three ways of naming one part."""
    kv = kv_of().cast("string")
    return {
        "market": F.concat_ws(" ", "p_name", F.concat(kv, F.lit(" K V")), F.col("p_brand"), F.lit("XFMER")),
        "pano": F.concat_ws("_", F.upper("p_name"), F.concat(kv, F.lit("kV")), F.col("p_type")),
        "dayzer": F.concat_ws("-", "p_name", "p_brand", F.lit("SER DEV")),
    }


def parts(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").withColumn("kv", kv_of())


def records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(reference records, candidate records): all parts of one style against all parts of two others."""
    p = _t(s, d, "part")
    ref = M.record_features(p, "market", F.col("p_partkey"), styles()["market"], F.col("p_type"), F.col("p_brand"))
    pano = M.record_features(p, "pano", F.col("p_partkey"), styles()["pano"], F.col("p_type"), F.col("p_brand"), True)
    day = M.record_features(p, "dayzer", F.col("p_partkey"), styles()["dayzer"])
    return ref, pano.unionByName(day)


def scored(s: SparkSession, d: str) -> DataFrame:
    ref, cand = records(s, d)
    return M.score_pairs(M.block_candidates(ref, cand), ref, cand)


def flagged(s: SparkSession, d: str, kept: bool = False) -> DataFrame:
    """Ranked candidates of all references; scored and ranked once for all that are alike.

    ``kept``: the ranks of each class are checkpointed, for results that read the rows again and again.
    """
    return _flagged(s, d, checkpointed if kept else stored)[0]


def _flagged(s: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates, references). Each step is stored, so that no plan holds another's: large plans take the driver's memory."""
    ref, cand = (stored(x.select("dataset", "record_id", "block_tokens", *M.COMPARED)) for x in records(s, d))
    first, members = M.alike_rows(ref)
    first = stored(first)
    pairs = stored(M.block_candidates(first, cand))
    best = M.ranked(M.score_pairs(pairs, first, cand))
    return M.for_members(keep(best), keep(members)), ref


def normalize_text(s, d):
    return _t(s, d, "part").select("p_partkey", *[X.normalize_text(c).alias(n) for n, c in styles().items()])


def extract_voltage(s, d):
    return _t(s, d, "part").select("p_partkey", *[X.extract_voltage(c).alias(n) for n, c in styles().items()])


def unique_tokens(s, d):
    return _t(s, d, "part").select("p_partkey", F.array_join(X.unique_tokens(X.normalize_text(styles()["market"])), " ").alias("tokens"))


def interface_words(s, d):
    raw = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 == 0, F.lit("north-tie Interface")).otherwise(F.lit("flowgate 12")))
    return _t(s, d, "part").select("p_partkey", F.array_join(X.interface_tokens(X.normalize_text(raw)), " ").alias("words"))


def zone_words(s, d):
    return _t(s, d, "part").select("p_partkey", F.array_join(X.zone_tokens("p_brand", styles()["pano"]), " | ").alias("words"))


def node_names(s, d):
    raw = F.concat_ws("_", F.lit("North"), "s_name", F.lit("Substation"))
    norm = X.normalize_node_name(raw)
    return _t(s, d, "supplier").select("s_suppkey", norm.alias("norm"), F.array_join(X.name_tokens(norm), " ").alias("tokens"), F.array_join(X.numeric_tokens(norm), " ").alias("numbers"))


def joined_names(s, d):
    return _t(s, d, "part").select("p_partkey", X.joined_names(F.nullif(F.col("p_brand"), F.lit("Brand#11")), "p_type").alias("name"))


def _pairs(s, d):
    p = _t(s, d, "part").select("p_partkey", X.unique_tokens(X.normalize_text(F.concat_ws(" ", "p_name", "p_type"))).alias("t"), F.when(F.col("p_size") % 6 != 0, kv_of()).alias("kv"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"), F.col("kv").alias("kw"))
    return p.join(q, "p_partkey")


def dice_jaccard(s, d):
    return r6(_pairs(s, d).select("p_partkey", S.dice("t", "u").alias("dice"), S.jaccard("t", "u").alias("jaccard"), S.overlap_flag("t", "u").alias("meets")), "dice", "jaccard")


def voltage_scores(s, d):
    return _pairs(s, d).select("p_partkey", S.voltage_match("kv", "kw").alias("match"), S.voltage_near("kv", "kw").alias("near"), S.voltage_score("kv", "kw").alias("score"), S.voltage_band("kv").alias("band"))


def confidence_labels(s, d):
    x = (F.col("p_partkey") % 101) / 100
    return _t(s, d, "part").select("p_partkey", S.label_up_to(x).alias("cut"), S.label_at_least(x, S.LABELS_SUPERVISED, "reject").alias("label"), S.label_at_least(x, S.LABELS_V2, "low").alias("label_v2"))


def block_candidates(s, d):
    ref, cand = records(s, d)
    return M.block_candidates(ref, cand, 10)


def pair_scores(s, d):
    names = ["facility_score", "contingency_score", "voltage_match", "zone_overlap", "score_v1", "score_v2"]
    return r6(scored(s, d).select("left_id", "dataset", "right_id", *names), *names)


def group_flags(s, d):
    return r6(flagged(s, d).select("left_id", "dataset", "rank", "best", "second", "margin", "ambiguous"), "best", "second", "margin")


def best_match(s, d):
    ref, _ = records(s, d)
    return r6(M.best_match(scored(s, d), ref).select("left_id", "dataset", "score", "second", "ambiguous", "label"), "score", "second")


def review_queue(s, d):
    return M.label_template(M.review_queue(flagged(s, d))).select("left_id", "dataset", "right_id", "reason", "manual_label", "review_notes")


def final_matches(s, d):
    return r6(M.final_matches(*_flagged(s, d), ["pano", "dayzer"]).select("left_id", "source", "right_id", "score", "accepted", "label"), "score")


def final_validation(s, d):
    rows, ref = _flagged(s, d)
    return M.validation(M.final_matches(rows, ref, ["pano", "dayzer"]), ref, ["pano", "dayzer"])


def wide_matches(s, d):
    return r6(R.wide_by_source(M.final_matches(*_flagged(s, d), ["pano", "dayzer"]), ["left_id"], ["right_id", "score"], ["pano", "dayzer"]), "pano_score", "dayzer_score")


def completeness_grid(s, d):
    o = _t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("n"))
    return R.complete(_t(s, d, "customer").select("c_custkey"), o, ["c_custkey"], ["F", "O", "P"])


def missing_rows(s, d):
    return R.missing_rows(_t(s, d, "customer").select("c_custkey"), _t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).where(F.col("c_custkey") % 3 != 0), ["c_custkey"])


def label_status(s, d):
    rows = _t(s, d, "documents").select("doc_id")
    return M.with_labels(rows, _t(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("manual_label")), ["doc_id"]).select("doc_id", "manual_label", "review_status")


def precision_by_bucket(s, d):
    rows = _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left").select("lang", F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("manual_label"))
    return r6(ME.reviewed_precision(rows, ["lang"]), "precision")


def _two_names() -> tuple[Column, Column]:
    return F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name"))


def edit_ratio(s, d):
    return r6(_t(s, d, "part").select("p_partkey", S.edit_ratio(*_two_names()).alias("ratio")), "ratio")


def fuzzy_ratio(s, d):
    return r6(_t(s, d, "part").select("p_partkey", S.fuzzy_ratio(*_two_names()).alias("ratio")), "ratio")


def passage_blocking(s, d):
    """Benchmark passages against documents by shared long words: the blocking join on long texts."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z]+"), lambda t: F.length(t) >= 12))
    b = _t(s, d, "benchmark").select(F.col("item_id").alias("record_id"), words("text").alias("block_tokens"), F.lit(None).cast("int").alias("voltage"))
    c = _t(s, d, "documents").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("record_id"), words("text").alias("block_tokens"), F.lit(None).cast("int").alias("voltage"))
    return M.block_candidates(b, c, 5)


# graph alignment: suppliers seen through orders of odd and of even lines

def lat_of() -> Column:
    return 30 + (F.col("s_suppkey") * 37 % 101) / 50.0


def lon_of() -> Column:
    return -100 + (F.col("s_suppkey") * 53 % 97) / 40.0


def nodes(s: SparkSession, d: str, right: bool) -> DataFrame:
    t = _t(s, d, "supplier")
    shift = 0.01 if right else 0.0
    name = F.concat_ws(" ", F.lit("N"), "s_name") if right else F.concat_ws("_", F.lit("North"), "s_name")
    kv = F.element_at(F.array(*[F.lit(float(k)) for k in (69, 138, 345, 500)]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    lat = lat_of() + shift if right else F.when(F.col("s_suppkey") % 17 != 0, lat_of())
    lon = lon_of() + shift if right else F.when(F.col("s_suppkey") % 17 != 0, lon_of())
    out = t.select(F.col("s_suppkey").alias("id"), name.alias("name"), kv.alias("kv"), lat.alias("lat"), lon.alias("lon")).withColumn("norm", X.normalize_node_name("name"))
    return out.withColumns({"tokens": X.name_tokens("norm"), "numbers": X.numeric_tokens("norm")})


def edges(s: SparkSession, d: str, odd: int) -> DataFrame:
    li = _t(s, d, "lineitem").where(F.col("l_linenumber") % 2 == odd)
    together = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("_s")).where(F.size("_s") > 1)
    return GR.simple_graph(together.select(F.explode("_s").alias("src"), "_s").select("src", F.explode("_s").alias("dst")).where(F.col("src") < F.col("dst")))


def graphs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edges of odd and of even lines, stored with those of a node together."""
    return tuple(stored(G.spread_out(edges(s, d, odd), "src")) for odd in (1, 0))


def pair_table(s: SparkSession, d: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """All candidate pairs over the graphs of odd and of even lines, with features and composite score.

    What follows from other columns is not stored, but worked out by those who read it.
    """
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = G.spatial_candidates(l, r, ranks=False, grouped=True)
    with dealt_by_some_keys(s):
        rows = stored(GR.pair_features(pairs, l.join(GR.fingerprints(a, l), "id"), r.join(GR.fingerprints(b, r), "id")).drop("distance_score"))
    return GR.with_composite(rows.withColumn("distance_score", S.distance_score("distance_km", GR.RADIUS_KM)))


def firsts(pairs: DataFrame, scores: Callable[[DataFrame], dict[str, Column]] = lambda pairs: {}, first: int = 2) -> DataFrame:
    """The leading pairs by the composite and by other scores, ranked; ranks beyond ``first`` are not those of all pairs."""
    return GR.composite(GR.leading(pairs, {"composite": F.col("composite")} | scores(pairs), first))


def aligned(s: SparkSession, d: str, scores: Callable[[DataFrame], dict[str, Column]] = lambda pairs: {}) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored pairs, one-to-one baseline, propagated results). Of the pairs, the first two of each left node by the composite and by ``scores``."""
    a, b = graphs(s, d)
    pairs = pair_table(s, d, a, b)
    scored, near = checkpointed(firsts(pairs, scores)), GR._neighbourhoods(b)
    accepted, _ = GR.propagate(scored, a, b, pairs=pairs, near=near)
    return scored, GR.one_to_one(scored), checkpointed(GR.propagated_results(scored, accepted, a, b, pairs=pairs, near=near))


def graph_edges(s, d):
    return edges(s, d, 1)


def graph_fingerprint(s, d):
    rows = GR.fingerprints(edges(s, d, 1), nodes(s, d, False))
    return rows.select("id", "degree", "same_kv", "higher_kv", "lower_kv", *[f"n_{b}" for b in GR.BANDS])


def endpoint_validity(s, d):
    n = nodes(s, d, False)
    b = _t(s, d, "supplier").select(F.concat_ws("_", F.lit("North"), "s_name").alias("from_bus"), F.when(F.col("s_suppkey") % 4 == 0, "nowhere").otherwise(F.concat_ws(" ", F.lit("north"), "s_name")).alias("to_bus"))
    return GR.endpoint_validity(GR.resolve_endpoints(b, n, ("from_bus", "to_bus")))


def coordinate_profile(s, d):
    return r6(PR.coordinate_profile(nodes(s, d, False), "lat", "lon"), "min_lat", "max_lat", "min_lon", "max_lon")


def haversine_pairs(s, d):
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    return G.of_places(r6(G.place_pairs(l, r, 60.0), "distance_km"))


def nearest_pairs(s, d):
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    return r6(G.nearest_join(l, r, 5), "distance_km")


def name_fallback(s, d):
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    return G.name_fallback(l, r, 5)


def _scored(s: SparkSession, d: str, first: int = 2) -> DataFrame:
    return firsts(pair_table(s, d, *graphs(s, d)), first=first)


def composite_rank(s, d):
    return _scored(s, d, 3).where(F.col("rank") <= 3).select("left_id", "right_id", "rank", F.round("composite", 6).alias("composite"), "ambiguous", "label")


def one_to_one(s, d):
    return GR.one_to_one(_scored(s, d)).select("left_id", "right_id", F.round("composite", 6).alias("composite"), "ambiguous", "label")


def seeds(s, d):
    return GR.seeds(_scored(s, d)).select("left_id", "right_id", F.round("score", 6).alias("score"))


def propagate_final(s, d):
    _, _, final = aligned(s, d)
    return r6(final.select("left_id", "right_id", "stage", "round", "accepted", "final_score", "label", "ambiguous", "distance_km", "voltage_score"), "final_score", "distance_km")


def propagation_counts(s, d):
    return GR.one_to_one_counts(*aligned(s, d))


def topology_counts(s, d):
    pairs, _, final = aligned(s, d, GR.nearest_scores)
    return GR.topology_counts(final, GR.nearest_only(pairs))


def distance_by_label(s, d):
    return r6(GR.distance_by_label(aligned(s, d)[2]), "mean_km", "median_km", "p90_km", "max_km", "exact_kv", "kv_conflict")


def ablation(s, d):
    return r6(GR.ablation(*aligned(s, d, GR.ablation_scores)), "voltage_exact_rate", "voltage_conflict_rate", "median_km", "p90_km", "ambiguity_rate")


def sensitivity_grid(s, d):
    pairs, _, final = aligned(s, d, GR.sensitivity_scores)
    return r6(GR.sensitivity(pairs, final), "voltage_exact_rate", "voltage_conflict_rate", "median_km", "p90_km", "ambiguity_rate")


def review_samples(s, d):
    pairs, _, final = aligned(s, d, GR.nearest_scores)
    return GR.review_samples(*GR.review_strata(final, GR.nearest_only(pairs))).select("left_id", "stratum", "stage", "label")


def case_studies(s, d):
    pairs, _, final = aligned(s, d, GR.nearest_scores)
    return GR.case_studies(*GR.case_rules(final, GR.nearest_only(pairs))).select("case", "left_id", "right_id", "nearest_id", "stage")


def nearest_variant(s, d):
    """Variant A alone: each left node's nearest candidate."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = GR.attribute_features(G.spatial_candidates(l, r), l, r, fuzzy=False)
    return r6(GR.nearest_only(pairs.where(F.col("distance_km").isNotNull())).select("left_id", "right_id", "distance_km", "kv_gap", "ambiguous"), "distance_km", "kv_gap")


def voltage_rank(s, d):
    """Candidates in order of nearness, those of a compatible voltage first."""
    l, r = nodes(s, d, False), nodes(s, d, True)  # noqa: E741
    pairs = GR.attribute_features(G.nearest_join(l, r, 5).withColumn("distance_rank", F.row_number().over(W.partitionBy("left_id").orderBy("distance_km", "right_id"))), l, r, fuzzy=False)
    return pairs.select("left_id", "right_id", "distance_rank", "voltage_score", "voltage_rank")


def label_buckets(s, d):
    return M.label_buckets(flagged(s, d)).select("left_id", "dataset", "right_id", "bucket")


def flag_columns(s, d):
    return flagged(s, d).select("left_id", "dataset", "right_id", "low_score", "close_margin", "ambiguous")


def _rx(x: str, steps: list[tuple[str, str]]) -> str:
    for p, to in steps:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


KV_SQL = "([69, 138, 345, 500])[p_size % 4 + 1]"
STYLE_SQL = {"market": f"(p_name || ' ' || {KV_SQL} || ' K V' || ' ' || p_brand || ' XFMER')", "pano": f"(upper(p_name) || '_' || {KV_SQL} || 'kV' || '_' || p_type)", "dayzer": "(p_name || '-' || p_brand || '-SER DEV')"}
NORM = lambda x: "trim(" + _rx(f"lower({x})", [(r"[-_./]+", " "), (r"\bk\s*v\b", "kv"), (r"\bxfmer\b", "transformer"), (r"\bser\s+dev\b", "series device"), (r"[^a-z0-9\s]", " "), (r"\s+", " ")]) + ")"
VOLT = lambda x: f"try_cast(nullif(regexp_extract({x}, '(?:^|[^0-9])([0-9]{{2,4}})\\s*kv\\b', 1), '') AS INTEGER)"
STOP = "('" + "', '".join(X.STOP_TOKENS) + "')"
TOKS = lambda n: f"list_sort(list_distinct(list_filter(string_split({n}, ' '), lambda t: t NOT IN {STOP} AND NOT regexp_full_match(t, '[0-9]+'))))"
NODE = lambda x: "trim(" + _rx(f"lower({x})", [(r"[-_./]+", " "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")]) + ")"
INTER = lambda a, b: f"len(list_intersect({a}, {b}))"
PAIRS = f"p AS (SELECT p_partkey, {TOKS(NORM(chr(40) + 'p_name || chr(32) || p_type' + chr(41)))} AS t, CASE WHEN p_size % 6 <> 0 THEN {KV_SQL} END AS kv FROM part), pq AS (SELECT a.p_partkey, a.t, a.kv, b.t AS u, b.kv AS kw FROM p a JOIN p b ON b.p_partkey - 1 = a.p_partkey)"
BAND = lambda v: f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} >= 300 THEN 'ehv' WHEN {v} >= 100 THEN 'hv' ELSE 'lv' END"
NODES_SQL = "n AS (SELECT s_suppkey AS id, ([69, 138, 345, 500])[s_nationkey % 4 + 1]::DOUBLE AS kv, 30 + (s_suppkey * 37 % 101) / 50.0 AS lat, -100 + (s_suppkey * 53 % 97) / 40.0 AS lon FROM supplier)"
HAV = lambda a, o, b, p: f"2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin((radians({p}) - radians({o})) / 2), 2))))"
DIST = f"{NODES_SQL}, dist AS (SELECT l.id AS left_id, r.id AS right_id, {HAV('l.lat', 'l.lon', 'r.lat + 0.01', 'r.lon + 0.01')} AS km FROM n l CROSS JOIN n r WHERE l.id % 17 <> 0)"
EDGE = "e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 1 AND a.l_suppkey <> b.l_suppkey)"
REC = f"""ref AS (SELECT p_partkey AS id, {NORM(STYLE_SQL['market'])} AS f, {NORM('p_type')} AS c, {VOLT(NORM(STYLE_SQL['market'] + " || ' ' || p_type"))} AS v, {TOKS(NORM('p_brand'))} AS zb, list_transform(regexp_extract_all({STYLE_SQL['market']}, '\\b[A-Z]{{2,}}\\b'), lambda x: lower(x)) AS zc FROM part),
cand AS (SELECT 'pano' AS dataset, p_partkey AS id, {NORM(STYLE_SQL['pano'])} AS f, {NORM('p_type')} AS c, {VOLT(NORM(STYLE_SQL['pano'] + " || ' ' || p_type"))} AS v, {TOKS(NORM('p_brand'))} AS zb, list_transform(regexp_extract_all({STYLE_SQL['pano']}, '\\b[A-Z]{{2,}}\\b'), lambda x: lower(x)) AS zc FROM part
 UNION ALL SELECT 'dayzer', p_partkey, {NORM(STYLE_SQL['dayzer'])}, '', {VOLT(NORM(STYLE_SQL['dayzer']))}, []::VARCHAR[], list_transform(regexp_extract_all({STYLE_SQL['dayzer']}, '\\b[A-Z]{{2,}}\\b'), lambda x: lower(x)) FROM part),
lf AS (SELECT id, v, {TOKS('f')} AS ft, {TOKS('c')} AS ct, list_distinct(list_concat(zb, zc)) AS z FROM ref),
rf AS (SELECT dataset, id, v, {TOKS('f')} AS ft, {TOKS('c')} AS ct, list_distinct(list_concat(zb, zc)) AS z FROM cand),
lt AS (SELECT id, unnest(ft) AS k FROM lf), rt AS (SELECT dataset, id, unnest(CASE WHEN dataset = 'pano' THEN list_distinct(list_concat(ft, ct)) ELSE ft END) AS k FROM rf),
ov AS (SELECT left_id, dataset, right_id, count(*) AS n FROM (SELECT lt.id AS left_id, dataset, rt.id AS right_id FROM lt JOIN rt USING (k) UNION ALL SELECT lf.id, rf.dataset, rf.id FROM lf JOIN rf USING (v)) GROUP BY ALL),
ol AS (SELECT left_id, ov.dataset, right_id, n AS overlap, lf.ft AS lft, rf.ft AS rft, lf.ct AS lct, rf.ct AS rct, lf.v AS lv, rf.v AS rv, lf.z AS lz, rf.z AS rz FROM ov JOIN lf ON lf.id = left_id JOIN rf ON rf.dataset = ov.dataset AND rf.id = right_id),
bl AS (SELECT *, row_number() OVER (PARTITION BY left_id, dataset ORDER BY overlap DESC, right_id)::INTEGER AS block_rank FROM ol)"""
DICE = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {INTER(a, b)} / (len({a}) + len({b})) END"
SC = REC + f""", sc AS (SELECT left_id, dataset, right_id, {DICE('lft', 'rft')} AS fs, {DICE('lct', 'rct')} AS cs, coalesce((lv = rv)::INT::DOUBLE, 0) AS vm, ({INTER('lz', 'rz')} > 0)::INT::DOUBLE AS zo, ({INTER('lft', 'rft')} > 0)::INT::DOUBLE AS tk FROM bl WHERE block_rank <= 250),
s2 AS (SELECT *, fs * 0.5::DOUBLE + cs * 0.25::DOUBLE + vm * 0.15::DOUBLE + zo * 0.1::DOUBLE AS v1, CASE dataset WHEN 'pano' THEN fs * 0.45::DOUBLE + cs * 0.3::DOUBLE + vm * 0.15::DOUBLE + tk * 0.05::DOUBLE + zo * 0.05::DOUBLE ELSE fs * 0.65::DOUBLE + vm * 0.15::DOUBLE + tk * 0.1::DOUBLE END AS v2 FROM sc)"""
RANKED = SC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY left_id, dataset ORDER BY v2 DESC, right_id)::INTEGER AS rank FROM s2),
fl AS (SELECT *, max(v2) OVER w AS best, coalesce(max(v2) FILTER (rank = 2) OVER w, 0) AS second FROM rk WHERE rank <= 25 WINDOW w AS (PARTITION BY left_id, dataset)),
fin AS (SELECT left_id, g.source, CASE WHEN v2 >= 0.5 THEN right_id END AS right_id, coalesce(v2, 0) AS score FROM (SELECT id AS left_id, unnest(['pano', 'dayzer']) AS source FROM lf) g LEFT JOIN (SELECT left_id, dataset AS source, right_id, v2 FROM fl WHERE rank = 1) b USING (left_id, source))"""

SQL: dict[str, str] = {
    "normalize_text": "SELECT p_partkey, " + ", ".join(f"{NORM(x)} AS {n}" for n, x in STYLE_SQL.items()) + " FROM part",
    "extract_voltage": "SELECT p_partkey, " + ", ".join(f"{VOLT(NORM(x))} AS {n}" for n, x in STYLE_SQL.items()) + " FROM part",
    "unique_tokens": f"SELECT p_partkey, array_to_string({TOKS(NORM(STYLE_SQL['market']))}, ' ') AS tokens FROM part",
    "interface_words": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'interface tie' ELSE 'flowgate' END AS words FROM part",
    "zone_words": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({TOKS(NORM('p_brand'))}, list_transform(regexp_extract_all({STYLE_SQL['pano']}, '\\b[A-Z]{{2,}}\\b'), lambda x: lower(x))))), ' | ') AS words FROM part",
    "node_names": f"WITH x AS (SELECT s_suppkey, {NODE('s_name')} AS b FROM supplier) SELECT s_suppkey, 'n ' || b || ' sub' AS norm, array_to_string(list_sort(list_distinct(string_split('n ' || b || ' sub', ' '))), ' ') AS tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(b, '[0-9]+'))), ' ') AS numbers FROM x",
    "joined_names": "SELECT p_partkey, concat_ws(' | ', nullif(p_brand, 'Brand#11'), p_type) AS name FROM part",
    "dice_jaccard": f"WITH {PAIRS} SELECT p_partkey, round({DICE('t', 'u')}, 6) AS dice, round(CASE WHEN len(t) = 0 AND len(u) = 0 THEN 1 ELSE {INTER('t', 'u')}::DOUBLE / nullif(len(t) + len(u) - {INTER('t', 'u')}, 0) END, 6) AS jaccard, ({INTER('t', 'u')} > 0)::INT::DOUBLE AS meets FROM pq",
    "voltage_scores": f"WITH {PAIRS} SELECT p_partkey, coalesce((kv = kw)::INT::DOUBLE, 0) AS match, coalesce((abs(kv - kw) <= 5)::INT::DOUBLE, 0) AS near, CASE WHEN kv = kw THEN 1.0 WHEN kv IS NULL OR kw IS NULL THEN 0.25 WHEN {BAND('kv')} = {BAND('kw')} THEN 0.65 ELSE 0.0 END::DOUBLE AS score, {BAND('kv')} AS band FROM pq",
    "confidence_labels": "WITH x AS (SELECT p_partkey, (p_partkey % 101) / 100 AS x FROM part) SELECT p_partkey, CASE WHEN x <= 0.5::DOUBLE THEN 'reject' WHEN x <= 0.75::DOUBLE THEN 'uncertain' WHEN x <= 0.9::DOUBLE THEN 'medium_high' ELSE 'high' END AS cut, CASE WHEN x >= 0.9::DOUBLE THEN 'high' WHEN x >= 0.75::DOUBLE THEN 'medium_high' WHEN x >= 0.5::DOUBLE THEN 'uncertain' ELSE 'reject' END AS label, CASE WHEN x >= 0.85::DOUBLE THEN 'high' WHEN x >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS label_v2 FROM x",
    "block_candidates": f"WITH {REC} SELECT left_id, dataset, right_id, overlap, block_rank FROM bl WHERE block_rank <= 10",
    "pair_scores": f"WITH {SC} SELECT left_id, dataset, right_id, round(fs, 6) AS facility_score, round(cs, 6) AS contingency_score, vm AS voltage_match, zo AS zone_overlap, round(v1, 6) AS score_v1, round(v2, 6) AS score_v2 FROM s2",
    "group_flags": f"WITH {RANKED} SELECT left_id, dataset, rank, round(best, 6) AS best, round(second, 6) AS second, round(best - second, 6) AS margin, best < 0.75::DOUBLE OR best - second < 0.05::DOUBLE AS ambiguous FROM fl",
    "best_match": f"WITH {SC}, r1 AS (SELECT *, row_number() OVER (PARTITION BY left_id, dataset ORDER BY v1 DESC, right_id) AS k FROM s2), b AS (SELECT left_id, dataset, max(v1) FILTER (k = 1) AS score, coalesce(max(v1) FILTER (k = 2), 0) AS second FROM r1 GROUP BY ALL) SELECT lf.id AS left_id, dataset, round(coalesce(score, 0), 6) AS score, round(coalesce(second, 0), 6) AS second, coalesce(score < 0.35::DOUBLE OR score - second < 0.05::DOUBLE, true) AS ambiguous, CASE WHEN score >= 0.7::DOUBLE THEN 'high' WHEN score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS label FROM lf LEFT JOIN b ON b.left_id = lf.id",
    "review_queue": f"WITH {RANKED}, b AS (SELECT *, best < 0.75::DOUBLE OR best - second < 0.05::DOUBLE AS amb FROM fl WHERE rank = 1), a AS (SELECT * FROM b WHERE NOT amb AND v2 >= 0.85::DOUBLE ORDER BY md5('42|' || left_id || '|' || dataset), left_id, dataset LIMIT 100) SELECT left_id, dataset, right_id, 'flagged' AS reason, NULL::INTEGER AS manual_label, '' AS review_notes FROM b WHERE amb UNION ALL SELECT left_id, dataset, right_id, 'audit', NULL, '' FROM a",
    "final_matches": f"WITH {RANKED} SELECT left_id, source, right_id, round(score, 6) AS score, right_id IS NOT NULL AS accepted, CASE WHEN right_id IS NULL THEN 'low' WHEN score >= 0.85::DOUBLE THEN 'high' WHEN score >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS label FROM fin",
    "wide_matches": f"WITH {RANKED} SELECT left_id, max(right_id) FILTER (source = 'pano') AS pano_right_id, round(max(score) FILTER (source = 'pano'), 6) AS pano_score, max(right_id) FILTER (source = 'dayzer') AS dayzer_right_id, round(max(score) FILTER (source = 'dayzer'), 6) AS dayzer_score FROM fin GROUP BY left_id",
    "final_validation": "WITH n AS (SELECT count(*) * 2 AS k FROM part) SELECT 'rows' AS \"check\", k AS found, k AS expected FROM n UNION ALL SELECT 'accepted_below', 0, 0 UNION ALL SELECT 'no_reference', 0, 0",
    "completeness_grid": "SELECT c_custkey, g.source, n FROM (SELECT c_custkey, unnest(['F', 'O', 'P']) AS source FROM customer) g LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) o ON o_custkey = c_custkey AND o_orderstatus = g.source",
    "missing_rows": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)",
    "label_status": "SELECT doc_id, l.m AS manual_label, CASE WHEN m IS NULL THEN 'unreviewed' WHEN m = 1 THEN 'confirmed' WHEN m = 0 THEN 'rejected' ELSE 'unsure' END AS review_status FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 ELSE quality END AS m FROM labels) l USING (doc_id)",
    "precision_by_bucket": "WITH r AS (SELECT lang, CASE WHEN toxic = 1 THEN -1 ELSE quality END AS m FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, count(*) AS rows, count(*) FILTER (m IN (0, 1)) AS scored, round(avg((m = 1)::INT) FILTER (m IN (0, 1)), 6) AS precision FROM r GROUP BY lang",
    "edit_ratio": "WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || p_name) AS b FROM part) SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS ratio FROM x",
    "passage_blocking": "WITH b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 12))) AS k FROM benchmark), c AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 12))) AS k FROM documents), n AS (SELECT item_id, doc_id, count(*) AS overlap FROM b JOIN c USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id)::INTEGER AS block_rank FROM n) SELECT item_id AS left_id, 'documents' AS dataset, doc_id AS right_id, overlap, block_rank FROM r WHERE block_rank <= 5",
    "graph_edges": f"WITH {EDGE} SELECT src, dst FROM e",
    "graph_fingerprint": f"WITH {NODES_SQL}, {EDGE}, j AS (SELECT a.id, b.kv - a.kv AS g, {BAND('b.kv')} AS band, b.id AS other FROM n a LEFT JOIN e ON e.src = a.id LEFT JOIN n b ON b.id = e.dst) SELECT id, count(other) AS degree, count(*) FILTER (abs(g) <= 1e-6) AS same_kv, count(*) FILTER (g > 1e-6) AS higher_kv, count(*) FILTER (g < -1e-6) AS lower_kv, count(other) FILTER (band = 'ehv') AS n_ehv, count(other) FILTER (band = 'hv') AS n_hv, count(other) FILTER (band = 'lv') AS n_lv, count(other) FILTER (band = 'unknown') AS n_unknown FROM j GROUP BY id",
    "endpoint_validity": "SELECT count(*) AS branches, count(*) AS from_found, count(*) FILTER (s_suppkey % 4 <> 0) AS to_found, count(*) FILTER (s_suppkey % 4 <> 0) AS both_found, count(*) FILTER (s_suppkey % 4 <> 0) AS self_loops FROM supplier",
    "coordinate_profile": f"WITH {NODES_SQL}, m AS (SELECT CASE WHEN id % 17 <> 0 THEN lat END AS lat, CASE WHEN id % 17 <> 0 THEN lon END AS lon FROM n) SELECT count(*) AS rows, count(*) FILTER (lat IS NULL) AS missing, 0::BIGINT AS out_of_range, 0::BIGINT AS zero, count(*) - count(DISTINCT (lat, lon)) AS repeated, round(min(lat), 6)::DOUBLE AS min_lat, round(max(lat), 6)::DOUBLE AS max_lat, round(min(lon), 6)::DOUBLE AS min_lon, round(max(lon), 6)::DOUBLE AS max_lon FROM m",
    "haversine_pairs": f"WITH {DIST} SELECT left_id, right_id, round(km, 6) AS distance_km FROM dist WHERE km <= 60",
    "nearest_pairs": f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS k FROM dist) SELECT left_id, right_id, round(km, 6) AS distance_km FROM r WHERE k <= 5",
    "nearest_variant": f"WITH {DIST}, k AS (SELECT left_id, right_id, km FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS k FROM dist) WHERE k = 1) SELECT left_id, right_id, round(km, 6) AS distance_km, round(abs(l.kv - r.kv), 6) AS kv_gap, count(*) OVER (PARTITION BY right_id) > 1 AS ambiguous FROM k JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id",
    "voltage_rank": f"WITH {DIST}, k AS (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id)::INTEGER AS distance_rank FROM dist), v AS (SELECT k.*, CASE WHEN l.kv = r.kv THEN 1.0 WHEN {BAND('l.kv')} = {BAND('r.kv')} THEN 0.65 ELSE 0.0 END::DOUBLE AS voltage_score FROM k JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id WHERE distance_rank <= 5) SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY voltage_score >= 0.65::DOUBLE DESC, distance_rank, right_id)::INTEGER AS voltage_rank FROM v",
    "flag_columns": f"WITH {RANKED} SELECT left_id, dataset, right_id, v2 < 0.75::DOUBLE AS low_score, best - second < 0.05::DOUBLE AS close_margin, best < 0.75::DOUBLE OR best - second < 0.05::DOUBLE AS ambiguous FROM fl",
    "label_buckets": f"WITH {RANKED}, b AS (SELECT *, best < 0.75::DOUBLE OR best - second < 0.05::DOUBLE AS amb, best - second < 0.05::DOUBLE AS cm FROM fl WHERE rank = 1), u AS (SELECT left_id, dataset, right_id, 'high_confidence' AS bucket FROM b WHERE NOT amb AND v2 >= 0.85::DOUBLE UNION ALL SELECT left_id, dataset, right_id, 'medium_confidence' FROM b WHERE v2 >= 0.7::DOUBLE AND v2 < 0.85::DOUBLE UNION ALL SELECT left_id, dataset, right_id, 'low_or_ambiguous' FROM b WHERE amb OR v2 < 0.7::DOUBLE OR cm) SELECT left_id, dataset, right_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42|' || left_id || '|' || dataset), left_id, dataset) AS k FROM u) WHERE k <= 100",
    "name_fallback": f"WITH {NODES_SQL}, x AS (SELECT l.id AS left_id, r.id AS right_id, {BAND('l.kv')} = {BAND('r.kv')} AS band, list_distinct(string_split('n ' || {NODE('a.s_name')}, ' ')) AS lt, list_distinct(string_split('n ' || {NODE('b.s_name')}, ' ')) AS rt FROM n l JOIN supplier a ON a.s_suppkey = l.id CROSS JOIN n r JOIN supplier b ON b.s_suppkey = r.id WHERE l.id % 17 = 0), y AS (SELECT left_id, right_id, {INTER('lt', 'rt')}::DOUBLE / (len(lt) + len(rt) - {INTER('lt', 'rt')}) + CASE WHEN band THEN 0.25 ELSE 0 END AS s FROM x) SELECT left_id, right_id, fallback_rank FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id DESC)::INTEGER AS fallback_rank FROM y) WHERE fallback_rank <= 5",
}
_OWN = """normalize_text extract_voltage unique_tokens interface_words zone_words node_names joined_names dice_jaccard voltage_scores confidence_labels
block_candidates pair_scores group_flags best_match review_queue final_matches final_validation wide_matches completeness_grid missing_rows label_status
precision_by_bucket edit_ratio fuzzy_ratio passage_blocking graph_edges graph_fingerprint endpoint_validity coordinate_profile haversine_pairs nearest_pairs
name_fallback composite_rank one_to_one seeds propagate_final propagation_counts topology_counts distance_by_label ablation sensitivity_grid review_samples case_studies
nearest_variant voltage_rank label_buckets flag_columns""".split()
QUERIES = {n: globals()[n] for n in _OWN}
