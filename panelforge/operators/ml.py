"""Models on MLlib: preprocessing, regressors, classifiers, clustering, evaluation, artefacts.

Boosted trees and forests of other packages are stood in for by MLlib's own; names say what runs.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import safe_div
from panelforge.sources.shared import checkpointed

SEED = 42

# Settings of the models by name.
REGRESSORS = {
    "hist_gbt": lambda: GBTRegressor(maxIter=120, stepSize=0.08, maxDepth=5, seed=SEED),
    "gbt_depth4": lambda: GBTRegressor(maxIter=160, stepSize=0.06, maxDepth=4, subsamplingRate=0.9, seed=SEED),
    "gbt_depth5": lambda: GBTRegressor(maxIter=160, stepSize=0.06, maxDepth=5, seed=SEED),
    "gbt_180": lambda: GBTRegressor(maxIter=180, stepSize=0.05, maxDepth=5, seed=SEED),
    "random_forest": lambda: RandomForestRegressor(numTrees=80, maxDepth=12, minInstancesPerNode=5, seed=SEED),
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "elastic_net": lambda: LinearRegression(regParam=0.001, elasticNetParam=0.25),
}
LINEAR = {"ridge", "elastic_net"}


def preprocess(numeric: list[str], categorical: list[str], scaled: bool = False, unknown: list[str] | None = None) -> list:
    """Median for missing numbers, codes for categories (missing ones "none", unseen ones a code of their own), one vector.

    ``unknown``: numbers that training never saw; they have no median and count 0.
    """
    made, unknown = [f"{c}__n" for c in numeric], unknown or []
    seen = [c for c in numeric if c not in unknown]
    stages = [Imputer(strategy="median", inputCols=seen, outputCols=[f"{c}__n" for c in seen])] if seen else []
    if unknown:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"0.0D AS {c}__n" for c in unknown) + " FROM __THIS__"))
    if categorical:
        codes = [f"{c}__c" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
        made = made + codes
    stages.append(VectorAssembler(inputCols=made, outputCol="raw_features" if scaled else "features"))
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


def _ready(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.withColumns({**{c: F.col(c).cast("double") for c in numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in categorical}})


def fit_regressor(train: DataFrame, kind: str, numeric: list[str], categorical: list[str], target: str, settings: dict | None = None) -> PipelineModel:
    """Fit a named regressor on rows with a known target and at least one known number."""
    model = REGRESSORS[kind]().copy()
    model.setLabelCol(target)
    if settings:
        model.setParams(**settings)
    rows = _ready(train.where(F.col(target).isNotNull()).dropna("all", subset=numeric), numeric, categorical).select(*numeric, *categorical, target)
    # computed once: the fit reads these rows again and again
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = rows.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in numeric], *[F.count_distinct(c).alias(c) for c in categorical]).first()
        if hasattr(model, "maxBins"):
            model.setMaxBins(max(32, *(facts[c] + 2 for c in categorical)) if categorical else 32)
        if kind == "ridge":
            model.setRegParam(1.0 / max(1, facts["_rows"]))
        unknown = [c for c in numeric if not facts[c]]
        return Pipeline(stages=[*preprocess(numeric, categorical, kind in LINEAR, unknown), model]).fit(rows)
    finally:
        rows.unpersist()


def predict(model: Transformer, rows: DataFrame, numeric: list[str], categorical: list[str], out: str = "predicted_pd") -> DataFrame:
    """Predictions for every requested row, known target or not; never below 0."""
    scored = model.transform(_ready(rows, numeric, categorical))
    drop = [c for c in scored.columns if c.endswith(("__n", "__c")) or c in ("features", "raw_features")]
    return scored.withColumn(out, F.greatest(F.lit(0.0), F.col("prediction"))).drop("prediction", *drop)


def importances(model: PipelineModel, numeric: list[str], categorical: list[str]) -> list[tuple[str, float]]:
    """(feature, importance or coefficient), largest size first."""
    last = model.stages[-1]
    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray().tolist()
    return sorted(zip([*numeric, *categorical], values), key=lambda kv: (-abs(kv[1]), kv[0]))


def permutation_importance(model: PipelineModel, rows: DataFrame, numeric: list[str], categorical: list[str], target: str, features: list[str]) -> list[tuple[str, float]]:
    """Rise of the mean absolute error when a feature's values are dealt anew among the rows of a hash bucket."""
    mae = lambda df: predict(model, df, numeric, categorical).agg(F.avg(F.abs(F.col(target) - F.col("predicted_pd")))).first()[0] or 0.0
    base, out = mae(rows), []
    for f in features:
        w = W.partitionBy(F.pmod(F.xxhash64(*rows.columns), F.lit(64))).orderBy(F.xxhash64(F.lit(f), *rows.columns))
        out.append((f, mae(rows.withColumn(f, F.coalesce(F.lag(f).over(w), F.col(f)))) - base))
    return sorted(out, key=lambda kv: -kv[1])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 * rows of the class)."""
    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for k, v in n.items():
        weight = F.when(F.col(label) == k, total / (2.0 * v)).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit_classifier(rows: DataFrame, features: list[str], label: str, kind: str = "logistic") -> PipelineModel:
    """Balanced, scaled logistic regression (C = 1, L2) or a forest of 300 trees."""
    # computed once: the fit reads these rows again and again
    known = rows.dropna("any", subset=features).select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = class_weights(known, label).withColumn(label, F.col(label).cast("double"))
        stages = [VectorAssembler(inputCols=features, outputCol="raw_features")]
        if kind == "logistic":
            stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
            stages.append(LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / max(1, rows.count()), elasticNetParam=0.0, standardization=False))
        else:
            stages.append(RandomForestClassifier(featuresCol="raw_features", labelCol=label, weightCol="weight", numTrees=300, minInstancesPerNode=3, seed=SEED))
        return Pipeline(stages=stages).fit(rows)
    finally:
        known.unpersist()


def classify(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(rows.dropna("any", subset=features))
    return out.withColumn("probability_1", vector_to_array("probability")[1]).drop("raw_features", "features", "rawPrediction", "probability")


def enough_labels(rows: DataFrame, label: str, least: int = 100) -> bool:
    """Whether both classes have ``least`` labels: below that the rule score decides."""
    n = rows.where(F.col(label).isin(0, 1)).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).first()
    return min(n["a"], n["b"]) >= least


def with_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Stratified fold numbers 0..k-1: hash order within the label, dealt in turn.

    A row's place is its place in its bucket of hashes plus the sizes of the buckets before, so that no
    task holds all rows of a label.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rows = rows.withColumns({"_h": h, "_b": F.substring(h, 1, 3)})
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    before = W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col(label).alias("_l"), F.col("_b").alias("_k"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)) - 1
    out = rows.withColumn("_p", place).join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k")))
    return out.withColumn("fold", F.pmod(F.col("_p") + F.col("_before"), F.lit(k)).cast("int")).drop("_h", "_b", "_l", "_k", "_p", "_before")


def classifier_metrics(scored: DataFrame, label: str, score: str = "probability_1", cut: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 and auc of a scored table, without a sort on the driver.

    The area under the curve counts pairs: an average rank of ties over distinct scores.
    """
    y, hit = F.col(label).cast("int") == 1, F.col(score) >= cut
    base = scored.agg(
        F.count("*").alias("rows"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")
    )
    d = lambda a, b: safe_div(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    base = base.select("rows", d(tp + tn, F.col("rows")).alias("accuracy"), d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1"))
    steps = scored.groupBy(F.round(score, 6).alias("s")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    w = W.partitionBy(F.lit(0)).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    area = steps.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0))).agg(d(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)), F.sum("p") * F.sum("n")).alias("auc"))
    return base.join(F.broadcast(area))


def cross_validate(rows: DataFrame, features: list[str], key: str, label: str, k: int = 5) -> list[dict]:
    """Metrics of each stratified fold (k small fits; the driver sees one row a fold)."""
    folds, out = checkpointed(with_folds(rows.dropna("any", subset=features), key, label, k)), []
    for f in range(k):
        model = fit_classifier(folds.where(F.col("fold") != f), features, label)
        out.append(classifier_metrics(classify(model, folds.where(F.col("fold") == f), features), label).first().asDict() | {"fold": f})
    return out


def kmeans(profiles: DataFrame, columns: list[str], key: str, k: int = 4, seeds: tuple[int, ...] = (42, 7, 1)) -> tuple[DataFrame, dict]:
    """Clusters of profile rows, the best of several seeds; confidence 1 - distance / largest distance; with inertia and silhouette."""
    rows = profiles.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))
    n = rows.count()
    k = max(2, min(k, n))
    best = min((KMeans(k=k, seed=s, maxIter=50).fit(rows) for s in seeds), key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.clusterCenters()])
    out = best.transform(rows).withColumn("kmeans_cluster", F.col("prediction"))
    point, centre = vector_to_array("features"), F.element_at(centres, F.col("prediction") + 1)
    dist = F.sqrt(F.aggregate(F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = out.withColumn("_d", dist)
    out = out.join(F.broadcast(out.agg(F.max("_d").alias("_top"))))  # one row
    silhouette = ClusteringEvaluator().evaluate(out) if n > k else None
    out = out.withColumn("kmeans_confidence", F.coalesce(1 - safe_div("_d", "_top"), F.lit(1.0)))
    return out.select(key, "kmeans_cluster", "kmeans_confidence"), {"k": k, "inertia": best.summary.trainingCost, "silhouette": silhouette}


def gaussian_mixture(profiles: DataFrame, columns: list[str], key: str, k: int = 4) -> tuple[DataFrame, dict]:
    """Mixture clusters, the largest posterior, AIC and BIC."""
    rows = profiles.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))
    n, d = rows.count(), len(columns)
    model = GaussianMixture(k=max(2, min(k, n)), seed=SEED, maxIter=50).fit(rows)
    free = model.getK() * (1 + d + d * (d + 1) / 2) - 1
    ll = model.summary.logLikelihood
    out = model.transform(rows).select(key, F.col("prediction").alias("gmm_cluster"), F.array_max(vector_to_array("probability")).alias("cluster_confidence"))
    return out, {"aic": 2 * free - 2 * ll, "bic": free * math.log(max(n, 1)) - 2 * ll}


def cluster_summary(clusters: DataFrame, members: DataFrame, key: str, zone: str, value: str) -> DataFrame:
    """Members, mean load and the commonest zone (ties to the smallest) of each cluster."""
    return clusters.join(members, key).groupBy("kmeans_cluster").agg(F.count("*").alias("members"), F.avg(value).alias("mean_load"), F.mode(zone, True).alias("main_zone"))


def attach_clusters(rows: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Cluster columns for rows; members without a cluster are "unknown" with confidence 0."""
    out = rows.join(clusters, key, "left")
    return out.withColumns({"kmeans_cluster": F.coalesce(F.col("kmeans_cluster").cast("string"), F.lit("unknown")), "kmeans_confidence": F.coalesce("kmeans_confidence", F.lit(0.0))})


def no_clusters(rows: DataFrame, key: str, zone: str, value: str) -> DataFrame:
    """The constant that stands for clusters where clustering is off."""
    return rows.groupBy(key).agg(F.lit("disabled").alias("kmeans_cluster"), F.lit(0.0).alias("kmeans_confidence"), F.min(zone).alias("zone"), F.avg(value).alias("average_pd"))
