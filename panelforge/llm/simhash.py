"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits, cut into SEGMENTS segments in a ring. If two fingerprints differ in at
most ``max_bits`` bits, some segment starts a chain in which the first l segments together differ in
at most floor(l * max_bits / SEGMENTS) bits, for every l (the pigeonring principle). With more
segments than bits the first segment of that chain is equal, so pairs meet in buckets of one equal
segment, and within a bucket a pair must pass the chain's growing budgets before its full distance
is counted.

A wider limit takes fewer segments than bits (``ring``), up to twice as many bits as segments: then
the first segment differs in at most one bit, and pairs meet in buckets of one segment with one of its
bits masked.

Equal fingerprints are one node from the start. A bucket of more than BLOCK nodes is cut into blocks
by a hash, and every two blocks meet in a tile, so that no task holds an unbounded bucket; a tile
returns a spanning forest of the links it found, at most one edge a node, never all pairs. Components
then spread their smallest doc_id over the edges until nothing changes.

Nodes may carry labels of groups that are known already (``joins``): then a tile returns a minimum spanning
forest, by distance, of the labels its links connect; ``nearcopies`` confirms those edges on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, documents, map_arrow, release, staged

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED, BITS = 42, 64
BLOCK = 8192
#: Shingles hashed at once.
STRIP = 1 << 18
#: The production parameters of the query.
WORDS, MAX_BITS = 4, 4


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """Big-endian hashes of the text's shingles, repeats included, STRIP at a time; no words: nothing."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STRIP):
        a, b = starts[at : at + STRIP].tolist(), ends[at : at + STRIP].tolist()
        yield np.array([one(joined[i:j], SEED) for i, j in zip(a, b)], ">u8")


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; no words: 0."""
    count, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(id_col, fp): the fingerprint of each row as a signed long; no shuffle. A null text counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, int] = {}
        out = np.empty(batch.num_rows, np.uint64)
        for k, t in enumerate(batch.column(1)):
            s = t.as_py() or ""
            if s not in known:
                known[s] = fingerprint(s, words)
            out[k] = known[s]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fp"])

    return map_arrow(docs.select(id_col, text), run, f"`{id_col}` {kind}, fp long")


def segments(max_bits: int, ring: int | None = None) -> list[tuple[int, int]]:
    """(shift, width) of ``ring`` segments (max_bits + 1 by default), the high bits first."""
    n = ring or max_bits + 1
    if not max_bits < 2 * n:
        raise ValueError("a ring needs more than half as many segments as differing bits")
    widths = [BITS // n + (k < BITS % n) for k in range(n)]
    return [(BITS - sum(widths[: k + 1]), w) for k, w in enumerate(widths)]


def bucket_keys(max_bits: int, ring: int | None = None) -> list[tuple[int, int | None, int, int]]:
    """(segment, masked bit, shift, mask) of each kind of bucket: the segment whole, or with one of its bits masked."""
    out = []
    for k, (shift, width) in enumerate(parts := segments(max_bits, ring)):
        whole = (1 << width) - 1
        out += [(k, None, shift, whole)] if len(parts) > max_bits else [(k, bit, shift, whole ^ 1 << bit) for bit in range(width)]
    return out


def linked(a: np.ndarray, b: np.ndarray, start: int, max_bits: int, ring: int | None = None, bit: int | None = None) -> np.ndarray:
    """Index pairs (2 x n) into a and b at distance max_bits or less whose chain from segment ``start`` keeps its budgets.

    ``bit``: the masked bit of the bucket; a pair with equal segments is left to the bucket of bit 0.
    """
    parts = segments(max_bits, ring)
    n = len(parts)
    diff = a[:, None] ^ b[None, :]
    mask, rows, cols = 0, None, None
    if bit:
        rows, cols = np.nonzero(diff & np.uint64(1 << parts[start][0] + bit))
        diff = diff[rows, cols]
    for length in range(1, n + 1):
        shift, width = parts[(start + length - 1) % n]
        mask |= ((1 << width) - 1) << shift
        if length == 1:
            continue  # held by the bucket itself
        ok = np.bitwise_count(diff & np.uint64(mask)) <= length * max_bits // n
        if rows is None:
            rows, cols = np.nonzero(ok)
            diff = diff[rows, cols]
        else:
            rows, cols, diff = rows[ok], cols[ok], diff[ok]
        if not len(rows):
            break
    if rows is None:
        rows, cols = np.nonzero(np.bitwise_count(diff) <= max_bits)
    return np.stack([rows, cols])


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def spanning(n: int, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of n nodes, by Boruvka's rounds."""
    order = np.argsort(weight, kind="stable")
    rows, cols = rows[order], cols[order]
    live, label, taken = np.arange(len(rows)), np.arange(n), []
    while True:
        x, y = label[rows[live]], label[cols[live]]
        off = x != y
        live, x, y = live[off], x[off], y[off]
        if not len(live):
            return order[np.concatenate(taken)] if taken else live
        best = np.full(n, len(rows))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        pick = np.unique(best[best < len(rows)])
        taken.append(pick)
        label = forest(n, np.concatenate([label[rows[pick]], np.arange(n)]), np.concatenate([label[cols[pick]], label]))


def _strips(fps: np.ndarray, side: np.ndarray, start: int, bit: int | None, max_bits: int, ring: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a tile, 256 rows at a time. side 0: one block against itself; 1 and 2: two blocks."""
    left = np.flatnonzero(side != 2)
    right = np.flatnonzero(side == 2) if (side == 2).any() else left
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        i, j = linked(fps[part], fps[right], start, max_bits, ring, bit)
        if len(i):
            yield part[i], right[j]


def _tile_edges(fps: np.ndarray, side: np.ndarray, *way) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges among the links of a tile."""
    label = np.arange(len(fps))
    for rows, cols in _strips(fps, side, *way):
        label = forest(len(fps), np.concatenate([rows, np.arange(len(fps))]), np.concatenate([cols, label]))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved].view(np.int64), fps[label[moved]].view(np.int64)


def _tile_joins(fps: np.ndarray, nodes: np.ndarray, labels: np.ndarray, side: np.ndarray, *way) -> tuple[np.ndarray, ...]:
    """Pairs of nodes and their differing bits: the shortest spanning edges among the labels that links of a tile connect."""
    names, label = np.unique(labels, return_inverse=True)
    x = y = np.empty(0, np.int64)
    if len(names) > 1:
        for rows, cols in _strips(fps, side, *way):
            off = label[rows] != label[cols]
            if off.any():
                x, y = np.concatenate([x, rows[off]]), np.concatenate([y, cols[off]])
                pick = spanning(len(names), label[x], label[y], np.bitwise_count(fps[x] ^ fps[y]))
                x, y = x[pick], y[pick]
    return np.minimum(nodes[x], nodes[y]), np.maximum(nodes[x], nodes[y]), np.bitwise_count(fps[x] ^ fps[y]).astype(np.int64)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, ring: int | None = None) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within max_bits of each other, directly or through others.

    ``nodes``: distinct fingerprints (fp). Buckets number at most (max_bits + 1) * 2^(64 / (max_bits + 1)
    rounded up), with a ``ring`` of n segments 64 * 2^(64 / n rounded up); only those over BLOCK rows are
    looked up by the others, so that table is bounded.
    """
    return _met(nodes, [], max_bits, ring)


def joins(nodes: DataFrame, max_bits: int, ring: int | None = None) -> DataFrame:
    """(a, b, bits): pairs of nodes within max_bits that connect their labels, as all such pairs would; nodes of one label are not paired.

    ``nodes``: (fp, node, label), node distinct; nodes may share a fingerprint.
    """
    return _met(nodes, ["node", "label"], max_bits, ring)


def _met(nodes: DataFrame, carried: list[str], max_bits: int, ring: int | None) -> DataFrame:
    spark = nodes.sparkSession
    bounded_batches(spark)
    kinds = bucket_keys(max_bits, ring)
    keys = F.array(*[F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)).cast("int" if mask < 2**31 else "long") for _, _, shift, mask in kinds])
    dealt = nodes.select("fp", *carried, F.posexplode(keys).alias("seg", "val"))
    sizes = dealt.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = staged(sizes.select("seg", "val", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    dealt = dealt.join(sizes, ["seg", "val"])
    block = F.pmod(F.xxhash64(*(carried[:1] or ["fp"])), F.col("blocks")).cast("int")
    # block b meets blocks 0..b as the right side and b..last as the left; a tile (i, i) holds one block
    tiles = dealt.select("fp", *carried, "seg", "val", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select(
        "fp", *carried, "seg", "val", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    tiles = tiles.repartition("seg", "val", "i", "j").sortWithinPartitions("seg", "val", "i", "j", "fp", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            yield from cut([c for c in cols], False)
            rest = kept[0]
        if rest is not None:
            yield from cut(rest, True)

    kept: list = [None]

    def cut(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        fp, *more, seg, val, i, j, side = cols
        new = np.flatnonzero((seg[1:] != seg[:-1]) | (val[1:] != val[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = [0, *new.tolist(), *([len(fp)] if last else [])]
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                found = (_tile_joins if more else _tile_edges)(fp[a:b].view(np.uint64), *[c[a:b] for c in more], side[a:b], *kinds[int(seg[a])][:2], max_bits, ring)
                if len(found[0]):
                    out.append(found)
        kept[0] = None if last else [c[bounds[-1] :] for c in cols]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(len(names))], names)

    names = ["a", "b", "bits"][: 2 + bool(carried)]
    return tiles.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest label each node reaches. ``nodes``: (fp, label), ``edges``: (a, b).

    Each round takes the smallest label of a node and its neighbours, then that of the node it points
    to; only nodes with edges take part. Rounds are about the logarithm of a component's breadth.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.select(F.col("a").alias("fp")).distinct().join(nodes, "fp").select("fp", "label"), "labels")
    while True:
        heard = both.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("heard"))
        new = staged(labels.join(heard, "fp").select("fp", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "heard")
        # pointer jump: all nodes that held a label pass on the best they know; written, so that the join
        # shuffles both sides and a hub's label can be split
        best = staged(new.groupBy("old").agg(F.min("label").alias("best")), "best")
        after = staged(new.join(best, "old").select("fp", "old", F.least("label", "best").alias("label")), "labels")
        changed = after.where(~F.col("label").eqNullSafe(F.col("old"))).limit(1).count()
        release(labels, new, best)
        labels = after
        if not changed:
            release(both)
            return labels.select("fp", "label")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fp, component_id): each row's fingerprint and the smallest id reachable over links of max_bits or less.

    A null or wordless text has fingerprint zero, linked like any other; fewer than ``words`` words
    make one shingle; very long texts are hashed whole, STRIP shingles at a time; a bit set in exactly
    half of the hashes is 0; a null id never becomes a component_id unless no other is reachable (then
    null); repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    fps = staged(fingerprints(docs, text, id_col, words), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min(id_col).alias("label")), "nodes")
    known = F.coalesce("label", F.lit(2**63 - 1))
    labels = components(nodes.select("fp", known.alias("label")), links(nodes.select("fp"), max_bits))
    labels = nodes.join(labels.withColumnRenamed("label", "low"), "fp", "left").select("fp", F.coalesce(F.nullif("low", F.lit(2**63 - 1)), "label").alias("component_id"))
    return fps.join(labels, "fp").select(id_col, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(fps: list[tuple[int, int]], max_bits: int = MAX_BITS) -> dict[int, int]:
    """doc_id to component_id by comparing all pairs; for tests on small fixtures."""
    ids, values = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    rows, cols = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits)
    label = forest(len(ids), rows, cols)
    low: dict[int, int] = {}
    for k, i in enumerate(ids):
        low[label[k]] = min(low.get(label[k], i), i)
    return {i: low[label[k]] for k, i in enumerate(ids)}
