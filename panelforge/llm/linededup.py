"""Line dedup over levelled sorted runs of line hashes; DataFrame operations only.

Documents arrive in batches of ascending doc_id. A batch's line hashes are reduced to one row a hash
and merge-anti-joined against the runs: hashes that the runs lack form a new run, written in buckets
and in hash order to the shared folder. When a level holds ``FANOUT`` runs they are compacted into one run of the
next level, so that a hash is rewritten about log(batches) times. A line is dropped where its hash
belongs to an earlier document, of an older batch (by the runs) or of its own (by the batch's
reduction). Line hashes are 96 bits wide (XXH64 and Murmur3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import NO_ID, documents, release, staged, staged_sorted, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
HASH = ["_h", "_g"]


def ascii_lower(x: Column) -> Column:
    """Lower-case A-Z only: the fast built-in where all characters are ASCII."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


class LineRuns:
    """The levelled runs: rows (_h, _g, _first), each hash once over all of them.

    A run is written once into as many buckets as the session's shuffles have partitions, one sorted file
    a bucket. A batch dealt by the same hash is therefore merged with every run as it lies: no join
    shuffles or sorts a run again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels = spark, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a scan of one file a bucket then tells the planner its order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def merged(self, seen: DataFrame) -> DataFrame:
        """``seen`` with ``_old``, the first document of its hash in any run (null: in none), by one merge join a run."""
        out = seen.withColumn("_old", F.lit(None).cast("long"))
        for run in (r for level in self.levels for r in level):
            out = out.join(run.withColumnRenamed("_first", "_run").hint("merge"), HASH, "left")
            out = out.withColumn("_old", F.coalesce("_old", "_run")).drop("_run")
        return out

    def add(self, fresh: DataFrame) -> None:
        """Add the run of a batch's new hashes, and compact levels that are full."""
        self.levels[0].append(staged_sorted(fresh, "line-run", HASH, self.buckets))
        for k, level in enumerate(self.levels):
            if len(level) < FANOUT:
                break
            # plain files, not tables: a union of tables passes for dealt already and would leave several files a bucket
            rows = self.spark.read.schema(level[0].schema).parquet(*[r.staged_at for r in level])
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(staged_sorted(rows, "line-run", HASH, self.buckets))
            release(*level)

    def close(self) -> None:
        """Delete the runs, once no later batch needs them."""
        release(*[r for level in self.levels for r in level])
        self.levels = [[]]


def keyed_lines(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _row, _pos, _h, _g) of the lines whose key is long enough."""
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("_id"),
        F.xxhash64(text_or_empty(text)).alias("_row"),
        F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("_pos", "_line"),
    ).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= MIN_CHARS)
    low = ascii_lower(F.col("_key"))
    return lines.select("_id", "_row", "_pos", low.alias("_low")).select("_id", "_row", "_pos", F.xxhash64("_low").alias("_h"), F.hash("_low").alias("_g"))


def dropped_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """(_id, _row, _drop): for each document that loses lines, their positions from 0."""
    spark = docs.sparkSession
    lines = keyed_lines(docs, text, id_col)
    cuts: list[float] = []
    if batches > 1:
        ids = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("double").alias("x"))
        cuts = sorted(set(ids.approxQuantile("x", [k / batches for k in range(1, batches)], 0.01)))
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("_id").cast("double") > F.lit(c)).cast("int")
    # one folder a batch, so that a batch reads its own lines only; written side by side instead of sorted
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", batches + 1)
    lines = staged(lines.withColumn("_batch", batch), "lines", by="_batch")
    runs, out = LineRuns(spark), None
    for b in range(len(cuts) + 1):
        own = lines.where(F.col("_batch") == b)
        seen = own.groupBy(*HASH).agg(F.min("_id").alias("_min"), F.max("_id").alias("_max"))
        told = staged(runs.merged(seen), "batch")  # so that the join below shuffles both sides and a hot line can be split
        if b < len(cuts):
            runs.add(told.where(F.col("_old").isNull()).select(*HASH, F.col("_min").alias("_first")))
        first = told.select(*HASH, F.coalesce("_old", "_min").alias("_first"), "_max").where(F.col("_max") > F.col("_first"))
        hit = own.join(first.select(*HASH, "_first"), HASH).where(F.col("_id") > F.col("_first")).select("_id", "_row", "_pos")
        out = hit if out is None else out.unionByName(hit)
    runs.close()
    return out.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """(doc, kept, n_lines, n_dropped): each row of ``docs`` as a struct, its text without the dropped lines, and counts.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of MIN_CHARS code
    points held by two documents keep their lines only in the smallest doc_id. Rows of one doc_id are
    one document. A null text counts as empty (one empty line); very long texts are split whole; a null
    id counts as one document behind all others; equal rows of one id keep and lose the same lines; an
    empty table gives no rows; other columns stay in the struct, whatever their names.
    """
    whole = text_or_empty(text)
    drops = dropped_lines(docs.select(id_col, text), text, id_col, batches)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("_id"),
        F.xxhash64(whole).alias("_row"),
    ).join(drops, ["_id", "_row"], "left")
    whole = F.coalesce(F.col("doc")[text], F.lit(""))
    parts = F.split(whole, "\n", -1)
    kept = F.when(F.col("_drop").isNull(), whole).otherwise(F.array_join(F.filter(parts, lambda _, k: ~F.array_contains("_drop", k)), "\n"))
    breaks = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
    return rows.select("doc", kept.alias("kept"), (breaks + 1).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, pos, parts[pos] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS parts FROM docs))),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (held.k IS NOT NULL AND doc_id <> first)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (held.k IS NULL OR doc_id = first), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (k) GROUP BY doc_id
"""
