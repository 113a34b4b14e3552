"""Checkpoints in the folder that the cluster names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions that name no folder (single-machine tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Of a column in a stored table: room for half a million numbers, beyond which each is written out.
DICTIONARY_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same cut by a Parquet table: for large tables of which later steps read a few columns each."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A table that is cheap to read twice, broadcast where its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def dealt_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Within, joins take their rows as they are dealt by some of the keys, and need not deal them by all."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
