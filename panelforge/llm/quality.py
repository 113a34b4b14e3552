"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A
text is compressed in blocks under both; the normalised difference of the sizes,
(bad - good) / (bad + good), says which dictionary foresees the text better. A logistic curve fitted
on labelled texts that no dictionary has seen turns the difference into a probability.

Only the fit is bounded: ``DICT_ROWS`` rows a class for the dictionaries and ``CURVE_ROWS`` others
for the curve, the first by a hash of doc_id, of each the first ``FIT_CHARS`` characters. Every text is
scored whole. Labels, language, source and doc_id never enter a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, map_arrow

DICT_ROWS, CURVE_ROWS, FIT_CHARS = 1500, 2000, 32_768
BLOCK, DICT_BYTES, LEVEL = 2048, 65_536, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str, good: bytes, bad: bytes) -> float:
    """(bad - good) / (bad + good) of the compressed sizes; an empty text compresses alike: about 0."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    parts = blocks(text.encode())
    a, b = sum(len(by_good(p)) for p in parts), sum(len(by_bad(p)) for p in parts)
    return (b - a) / (b + a)


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of DICT_BYTES at most; few texts give the texts themselves as a raw dictionary."""
    parts = [p for t in texts for p in blocks(t.encode()) if p]
    total = sum(map(len, parts))
    size = min(DICT_BYTES, total // 10)
    if size >= 1024 and len(parts) >= 16:
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[:DICT_BYTES]


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton's steps, with a little ridge; one class only gives its share."""
    if not len(y):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-2, 1e-2])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(good: list[str], bad: list[str], held: list[tuple[str, int]]) -> Model:
    """Fit from texts. Without texts of both classes every score is the share of good among ``held`` (0.5 without any)."""
    if not good or not bad:
        y = [q for _, q in held] + [1] * len(good) + [0] * len(bad)
        share = min(max(sum(y) / len(y), 0.01), 0.99) if y else 0.5
        return Model(b" ", b" ", 0.0, math.log(share / (1 - share)))
    a, b = train_dictionary(good) or b" ", train_dictionary(bad) or b" "
    x = np.array([difference(t, a, b) for t, _ in held])
    slope, offset = fit_curve(x, np.array([q for _, q in held], float)) if held else (20.0, 0.0)
    return Model(a, b, slope, offset)


def score(text: str, model: Model) -> float:
    z = model.slope * difference(text, model.good, model.bad) + model.offset
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def is_held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", text: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows that are not held out (see the module's text).

    Rows with a null id, text or label are passed over; of several labels or rows of one id the first
    by value is used.
    """
    order = F.md5(F.col(id_col).cast("string").cast("binary"))
    usable = labels.where(F.col(target).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    usable = usable.groupBy(id_col).agg(F.min(target).cast("int").alias("_y"))
    # three of eight labelled rows may serve the curve, the others the dictionaries; no row serves both
    usable = usable.withColumn("_curve", F.substring(order, 1, 1) < "6").withColumn("_h", order)
    pick = lambda rows, n: rows.orderBy("_h", id_col).limit(n).select(id_col, "_y", "_curve")
    ids = pick(usable.where("_curve"), CURVE_ROWS)
    for y in (0, 1):
        ids = ids.unionByName(pick(usable.where(~F.col("_curve") & (F.col("_y") == y)), DICT_ROWS))
    known = docs.where(F.col(text).isNotNull()).select(id_col, F.substring(text, 1, FIT_CHARS).alias("_text"))
    rows = known.join(F.broadcast(ids), id_col).groupBy(id_col, "_y", "_curve").agg(F.min("_text").alias("_t")).orderBy(order, id_col).collect()
    return fit(
        [r["_t"] for r in rows if r["_y"] == 1 and not r["_curve"]],
        [r["_t"] for r in rows if r["_y"] == 0 and not r["_curve"]],
        [(r["_t"], r["_y"]) for r in rows if r["_curve"]],
    )


def quality_scores(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score, predicted for each row; no shuffle.

    The model (two dictionaries of at most DICT_BYTES each) travels with the tasks. A null text
    counts as empty; very long texts are compressed whole, block by block; a score at the threshold is
    predicted 1, equal texts tie in score; a null id counts as empty text for held_out; repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [score(t.as_py() or "", model) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(id_col, text, is_held_out(id_col).alias("held_out"))
    return map_arrow(rows, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with all their columns; no shuffle; odd rows as in ``quality_scores``."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([score(t.as_py() or "", model) >= THRESHOLD for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_on_labels(docs, labels_of(spark, sf_dir)))
