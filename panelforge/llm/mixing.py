"""Mixing sources to target weights by hierarchical budgeting.

The tree has the levels domain, language, source. A leaf can give its tokens times ``max_epochs``; an
inner node what its children can. From the root down, each node's budget goes to its children by
weight; a child that cannot take its share takes all it has, and the rest goes to its siblings by
weight again. A node never gets more than its subtree holds, so a shortage is made up among the
siblings first and climbs to the parents' siblings only when they are exhausted. Budgets are solved
by sorted prefix sums inside each parent, without a loop over nodes.

A leaf's tokens come from seeded epochs: epoch e orders the leaf's documents by a hash of seed, e,
doc_id and text. Full epochs count whole; the rest of the leaf's budget is the prefix of the next epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import documents, hash_digits, staged, text_or_empty
from panelforge.llm.ranks import running

LEVELS = ["domain", "lang", "source"]
#: A leaf table up to this many rows goes to every executor; beyond, the join shuffles.
BROADCAST_LEAVES = 100_000
#: Production parameters of the query: weights (1 where a node is not named), budget as a share of all tokens.
SEED, BUDGET, MAX_EPOCHS = 7, 0.6, 3
WEIGHTS = {
    "domain": {"web": 3.0, "news": 2.0, "books": 2.0, "forum": 1.0, "other": 0.5},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 1.0},
}


def domain_of(source: str = "source") -> Column:
    """The query's domain of a source: four groups of five by number, all else "other"."""
    n = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"^src([0-9]{1,4})$", 1)
    at = F.floor(F.when(n != "", n).cast("int") / 5)
    return F.when(at == 0, "web").when(at == 1, "news").when(at == 2, "books").when(at == 3, "forum").otherwise("other")


def word_tokens(text: str = "text") -> Column:
    """Whitespace-separated words of a text."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x09-\x0D\x20]+")).cast("long")


def split_budget(nodes: DataFrame, parent: list[str], child: str, budget: str, out: str) -> DataFrame:
    """``out``: each node's share of its parent's ``budget`` under its ``cap``, by ``w``.

    Children in order of cap / w: the first k are full where the level the rest could reach without
    them is no less than their ratio; all others get w times the common level.
    """
    all_ = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = all_.orderBy("_ratio", child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    nodes = nodes.withColumn("_ratio", F.col("cap") / F.col("w"))
    nodes = nodes.withColumns({"_full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "_open": F.sum("w").over(rest)})
    nodes = nodes.withColumn("_level", (F.col(budget) - F.col("_full")) / F.col("_open"))
    # levels fall from the first child that is not filled on: its level is their largest; none: all are full
    nodes = nodes.withColumn("_common", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(all_))
    share = F.when(F.col("_common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("_common")))
    return nodes.withColumn(out, share).drop("_ratio", "_full", "_open", "_level", "_common")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, target): whole tokens to take from each leaf.

    ``budget`` is a share of all tokens; more than the corpus can give in max_epochs takes all of it.
    """
    weight = lambda level: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in [("", 1.0), *weights.get(level, {}).items()] for x in kv]), F.coalesce(F.col(level), F.lit(""))), F.lit(1.0))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("t")).first()["t"]
    tree = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs).withColumn("total", F.lit(total * budget))
    for k, level in enumerate(LEVELS):
        keys = LEVELS[: k + 1]
        # caps of this level's nodes, each once
        nodes = tree.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.first("total" if k == 0 else "b").alias("up")).withColumn("w", weight(level))
        nodes = split_budget(nodes, keys[:-1], level, "up", "share")
        nodes = nodes.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("share").alias("b"))
        on = None
        for c in keys:
            one = F.col(c).eqNullSafe(F.col(f"_{c}"))
            on = one if on is None else on & one
        tree = tree.drop("b").join(nodes, on).drop(*[f"_{c}" for c in keys])
    return tree.select(*LEVELS, "tokens", F.floor(F.col("b") + 1e-6).cast("long").alias("target"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc, domain, n_tokens, copies, tail_tokens) of every row of ``docs``.

    ``copies``: full epochs in which the row is used whole; ``tail_tokens``: tokens used of it in the
    last, partial epoch (its first ones, where the leaf's prefix ends inside it). Summed over a leaf,
    copies * n_tokens + tail_tokens is exactly the leaf's target. Null text, id, lang and source:
    no tokens, hashed as empty, leaves of their own. Repeated rows tie in every order and count each.
    Very long texts are one row; a prefix may end inside one (tail_tokens says where).
    An empty table gives no rows; other columns stay in the struct ``doc``.
    """
    domain = domain_of(source) if domain is None else domain
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        domain.alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        # the text tells null and repeated ids apart, so that they don't share one hash and bucket
        F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty(text).cast("binary"))).alias("id"), word_tokens(text).alias("n_tokens"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    leaves = staged(leaves, "leaves")
    stats = leaves.agg(F.count("*").alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    plan = leaf_budgets(leaves, weights, budget, max_epochs)
    ok = F.col("tokens") > 0
    plan = staged(plan.select(
        *[F.col(c).alias(f"_{c}") for c in LEVELS],
        F.when(ok, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("long").alias("copies"),
        F.when(ok, F.col("target") % F.col("tokens")).otherwise(0).cast("long").alias("left"),
    ), "plan")
    small = F.broadcast if stats["leaves"] <= BROADCAST_LEAVES else (lambda x: x)
    same = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    drop = [f"_{c}" for c in LEVELS]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copies").cast("string"), F.col("id")).cast("binary"))
    rows = rows.join(small(plan), same).drop(*drop).withColumn("h", order).withColumn("bucket", F.substring("h", 1, hash_digits(stats["n"])))
    # the bucket in which a leaf's prefix ends: only its rows need an order
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("s"), F.first("left").alias("left"))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = sums.where((F.col("base") < F.col("left")) & (F.col("base") + F.col("s") >= F.col("left")))
    last = staged(last.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("bucket").alias("_end"), "base"), "ends")
    rows = rows.join(small(last), same, "left").drop(*drop)
    names = ["doc", "domain", "n_tokens", "copies"]
    whole = F.when(F.col("_end").isNull() | (F.col("bucket") > F.col("_end")), 0).otherwise(F.col("n_tokens")).cast("long")
    clear = rows.where(F.col("_end").isNull() | (F.col("bucket") != F.col("_end"))).select(*names, whole.alias("tail_tokens"))
    # all rows of one leaf's last bucket are few: a bucket holds about 4096 rows
    within = W.partitionBy(*LEVELS).orderBy("h", "id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.where(F.col("bucket") == F.col("_end")).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    cut = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("left") - F.col("start"))).cast("long")
    return clear.unionByName(edge.select(*names, cut.alias("tail_tokens")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` once for every epoch that uses it, whole rows (a row cut by a prefix's end is kept)."""
    rows = mix(docs, **options)
    times = (F.col("copies") + (F.col("tail_tokens") > 0).cast("long")).cast("int")
    return rows.withColumn("times", times).where(F.col("times") > 0).select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select("doc.*")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return rows.select("doc.doc_id", "domain", "doc.lang", "doc.source", "n_tokens", "copies", "tail_tokens")


OP1_SQL = r"""
WITH docs AS (
 SELECT doc_id, lang, source, coalesce(cast(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::BIGINT AS n,
  try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{1,4})$', 1) AS INTEGER) AS num FROM documents),
named AS (SELECT *, CASE WHEN num BETWEEN 0 AND 4 THEN 'web' WHEN num BETWEEN 5 AND 9 THEN 'news' WHEN num BETWEEN 10 AND 14 THEN 'books' WHEN num BETWEEN 15 AND 19 THEN 'forum' ELSE 'other' END AS domain FROM docs),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE * 3 AS cap, 1.0::DOUBLE AS w FROM named GROUP BY ALL),
d0 AS (SELECT domain, sum(cap) AS cap, (SELECT sum(tokens)::DOUBLE * 0.6 FROM leaf) AS up,
 CASE domain WHEN 'web' THEN 3.0 WHEN 'news' THEN 2.0 WHEN 'books' THEN 2.0 WHEN 'forum' THEN 1.0 WHEN 'other' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, (up - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM d0),
d2 AS (SELECT domain, least(cap, coalesce(w * (SELECT max(lv) FROM d1 WHERE cap / w > lv), cap)) AS b FROM d1),
l0 AS (SELECT domain, lang, sum(cap) AS cap, any_value(b) AS up, CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf JOIN d2 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, (up - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM l0),
l2 AS (SELECT domain, lang, least(cap, coalesce(w * max(CASE WHEN cap / w > lv THEN lv END) OVER (PARTITION BY domain), cap)) AS b FROM l1),
s0 AS (SELECT leaf.*, l2.b AS up FROM leaf JOIN l2 ON leaf.domain = l2.domain AND leaf.lang IS NOT DISTINCT FROM l2.lang),
s1 AS (SELECT *, (up - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s0),
s2 AS (SELECT domain, lang, source, tokens, floor(least(cap, coalesce(w * max(CASE WHEN cap / w > lv THEN lv END) OVER (PARTITION BY domain, lang), cap)) + 1e-6)::BIGINT AS target FROM s1),
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN target // tokens ELSE 0 END AS copies, CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest FROM s2),
o AS (SELECT n.*, p.copies, p.rest, md5('7:' || p.copies || ':' || n.id) AS h FROM named n JOIN p ON n.domain = p.domain AND n.lang IS NOT DISTINCT FROM p.lang AND n.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o)
SELECT doc_id, domain, lang, source, n AS n_tokens, copies, greatest(0, least(n, rest - start))::BIGINT AS tail_tokens FROM r
"""
