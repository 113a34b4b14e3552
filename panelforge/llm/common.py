"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only by local sessions that name no shared folder (single-machine tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Bytes of an Arrow batch handed to a Python worker; bounds a worker's memory whatever the row lengths.
ARROW_BATCH_BYTES = 8 << 20
#: The largest doc_id; rows without a doc_id sort behind all others.
NO_ID = 2**63 - 1

_staged: dict[str, SparkSession] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``by``: the last column, with few values, each of which is a folder that can be read alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[path] = spark
    out.staged_at = path
    return out


def staged_sorted(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    """``staged`` as a table of ``buckets`` files, each sorted: a merge join on ``keys`` reads it as it lies."""
    spark, name = df.sparkSession, f"{label}-{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, *keys).write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    out = spark.table(name)
    _staged[path] = spark
    out.staged_at, out.staged_as = path, name
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (those of a loop's earlier rounds)."""
    for df in tables:
        if name := getattr(df, "staged_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if _staged.pop(path := getattr(df, "staged_at", None), None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _staged.items():
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_path(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts cannot fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``fn`` over each Arrow batch; no shuffle, state lives no longer than a task."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def hash_digits(rows: int, target: int = 4096) -> int:
    """Hex digits of a hash prefix that splits ``rows`` rows into buckets of about ``target``."""
    digits = 1
    while rows > target * 16**digits and digits < 8:
        digits += 1
    return digits
