"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start in shards dealt by a hash. In each
round every group of links names the fullest of its shards that still has room, its members elsewhere
propose to move there, and each shard accepts proposals, larger groups first, up to its quota, so
that no shard passes the mean size. Rounds end when no document moves. A group larger than a shard
fills one, then another: the fewest edges are cut that the quotas allow. Unlinked documents cut no
edge wherever they go; they fill the shards up to the mean, larger ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, hash_digits, release, staged, text_or_empty
from panelforge.llm.ranks import running

SHARDS, OVERHEAD = 40, 16
#: Unlinked documents are dealt in classes of size: at least these parts of a mean shard, then the rest.
CLASSES = (1 / 32, 1 / 256)


def per_shard(values: dict[int, int], shard: Column, shards: int) -> Column:
    """The value of a shard out of a short driver-side table (one entry a shard)."""
    return F.element_at(F.array(*[F.lit(int(values.get(s, 0))) for s in range(shards)]).cast("array<long>"), shard + 1)


def loads(rows: DataFrame) -> dict[int, int]:
    """Bytes of each shard: one row a shard comes to the driver."""
    return {r["shard"]: r["b"] for r in rows.where(F.col("shard").isNotNull()).groupBy("shard").agg(F.sum("size").alias("b")).collect()}


def propagate(rows: DataFrame, mean: float, digits: int, shards: int) -> DataFrame:
    """Linked rows (grp, size, h, ..., shard) with their shards moved; quotas are the mean size.

    A group's movers all go to one of its shards, from none with more members: each move adds to the sum
    of squared members over its shards, so rounds come to an end. Tables of earlier rounds are dropped.
    """
    old: list[DataFrame] = []
    while True:
        load = loads(rows)
        room = {s: max(0, int(mean) - load.get(s, 0)) for s in range(shards)}
        votes = rows.groupBy("grp", "shard").agg(F.count("*").alias("votes"), F.max("size").alias("largest"))
        votes = votes.withColumn("tie", F.xxhash64("grp", "shard"))
        open_ = votes.where(per_shard(room, F.col("shard"), shards) >= F.col("largest"))
        to = open_.groupBy("grp").agg(F.max(F.struct("votes", "tie", "shard")).alias("to"))
        # decided by group and shard, as all members of a group are of one size; a hot group is a few rows here
        own = F.struct("votes", "tie", "shard")
        full = per_shard(room, F.col("shard"), shards) < F.col("largest")
        # at equal votes a full shard yields to an open one, else its odd members could never meet the others
        better = (F.col("to.votes") > F.col("votes")) | ((F.col("to.votes") == F.col("votes")) & (full | (F.col("to") > own)))
        plan = votes.join(to, "grp").where(better & (F.col("to.shard") != F.col("shard")))
        plan = staged(plan.select("grp", "shard", F.col("to.shard").alias("target"), F.col("to.votes").alias("votes")), "plan")
        # written, so that the join shuffles both sides and a hot group can be split
        asked = staged(rows.join(plan, ["grp", "shard"], "left"), "proposals")
        moving = asked.where(F.col("target").isNotNull())
        # larger groups first: a digit for the order of magnitude, then the hash
        level = F.lpad(F.hex(15 - F.least(F.lit(15), F.floor(F.log2("votes"))).cast("long")), 1, "0")
        moving = moving.withColumn("bucket", F.concat(level, F.substring("h", 1, digits)))
        moving = running(moving, F.col("size"), "bucket", ["h"], ["target"], "before")
        accepted = F.col("before") + F.col("size") <= per_shard(room, F.col("target"), shards)
        moved = moving.withColumn("moved", accepted).withColumn("shard", F.when(accepted, F.col("target")).otherwise(F.col("shard")))
        still = asked.where(F.col("target").isNull()).withColumn("moved", F.lit(False))
        names = [*rows.columns, "moved"]
        out = staged(still.select(*names).unionByName(moved.select(*names)), "shards")
        rows = out.drop("moved")
        release(*old, plan)
        old = [asked, out]
        if not out.where("moved").limit(1).count():
            return rows


def fill(rows: DataFrame, load: dict[int, int], goal: float, digits: int, shards: int) -> DataFrame:
    """Deal rows out so that shard s gets about goal - load[s] bytes: consecutive stretches of hash order."""
    lacks = [max(0.0, goal - load.get(s, 0)) for s in range(shards)]
    ends, total = [], 0.0
    for x in lacks:
        total += x
        ends.append(total)
    rows = running(rows.withColumn("bucket", F.substring("h", 1, digits)), F.col("size"), "bucket", ["h"], [], "before")
    middle = F.col("before") + F.col("size") / 2
    shard = F.lit(0)
    for e in ends[:-1]:
        shard = shard + (middle >= F.lit(e)).cast("int")
    return rows.withColumn("shard", shard).drop("before", "bucket")


def balanced_shards(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Put every row into a shard of nearly equal bytes, linked rows together.

    Returns id_col, size (UTF-8 bytes plus OVERHEAD), text_crc32, shard, slot (gapless from 0 in each
    shard). A null text counts as empty; equal texts are linked (repeated rows too); a null id is
    hashed as empty text; very long texts count by their bytes, one longer than a shard fills it alone;
    ties of hash and text keep any order among themselves, they are alike; an empty table gives no rows;
    other columns are ignored. Shards of fewer documents than shards stay empty.
    """
    whole = text_or_empty(text)
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.md5(whole.cast("binary")).alias("grp"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    # null or repeated ids would share one hash and with it one bucket: their texts tell them apart
    rows = rows.withColumn("h", F.md5(F.concat("h", "grp").cast("binary")))
    rows = staged(rows, "sized")
    stats = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("m")).first()
    n, mean, digits = stats["n"], (stats["b"] or 0) / shards, hash_digits(stats["n"])
    # written before the join, so that both its sides are shuffled for it and a hot group can be split
    multi = staged(rows.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") > 1).select("grp"), "groups")
    first = F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")
    tagged = rows.join(multi.withColumn("linked", F.lit(True)), "grp", "left")
    tagged = staged(tagged.withColumn("shard", F.when(F.col("linked"), first)), "tagged")
    linked = propagate(tagged.where("linked").drop("linked"), mean, digits, shards)
    done, load, left = linked, loads(linked), tagged.where(F.col("linked").isNull()).drop("linked", "shard")
    sums = {r["k"]: r["b"] for r in left.groupBy(_class(mean).alias("k")).agg(F.sum("size").alias("b")).collect()}
    for k in sorted(sums):
        goal = _level(load, sums[k], shards)
        dealt = fill(left.where(_class(mean) == k), load, goal, digits, shards)
        if k != max(sums):
            dealt = staged(dealt, "dealt")
            for s, b in loads(dealt).items():
                load[s] = load.get(s, 0) + b
        done = done.unionByName(dealt.select(*done.columns))
    done = done.withColumn("bucket", F.substring("h", 1, digits))
    done = running(staged(done, "placed"), F.lit(1), "bucket", ["h", "grp"], ["shard"], "slot")
    return done.select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _class(mean: float) -> Column:
    return sum((F.col("size") < F.lit(c * mean)).cast("int") for c in CLASSES) + F.lit(0)


def _level(load: dict[int, int], more: int, shards: int) -> float:
    """The level to which ``more`` bytes fill the shards (water over an uneven ground)."""
    ground = sorted(load.get(s, 0) for s in range(shards))
    for k in range(1, shards + 1):
        level = (more + sum(ground[:k])) / k
        if k == shards or level <= ground[k]:
            return level
    return 0.0


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_shards(documents(spark, sf_dir))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
