"""Operator 11: hard-negative mining by an orthogonal PCA rotation.

Vectors become integers, ``floor(scale * x)``; a score is an integer inner
product. Anchors, in chunks, meet all rows, in blocks. Chunk and block are
rotated into the principal axes of a bounded sample (``FIT_CELLS``), so that the
leading coordinates carry most of a product. Partial products accumulate slab by
slab; what the remaining coordinates can still add is bounded by the product of
the residual norms, widened by slack for the rounding of rotation and products.
A pair that cannot reach its anchor's current floor (or must exceed its ceiling)
is discarded early; each survivor's score is an integer product of the unrotated
vectors. The rotation decides cost, never results.

A first pass finds each anchor's best rows of its own label, a second one, for
each of these positives, the best rows of other labels between ``low`` and
``high`` percent of its score. Tasks keep the best few of each anchor only, and
of identical vectors of one label in a block the smallest ids that can count.
Chunks are broadcast while they are below ``BROADCAST_BYTES``; otherwise blocks
and chunks are joined by chunk number and a salt.

Defined results: rows with a null id, label or vector, or with a component that
is null or not finite (also after scaling) take no part; a shorter vector counts
as padded with zeros; "other rows" are rows of another id; a row given more than
once counts once; anchors of one id that differ are mined each; an anchor
without positives, and a positive without negatives in its range, give no rows;
scores beyond the limits of a long count as that limit; an empty table gives no
rows; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.frames import map_arrow, materialise, table

#: Components of the sample that the rotation is fitted on, of a block of rows, and of a chunk of anchors.
FIT_CELLS, BLOCK_CELLS, CHUNK_CELLS = 1 << 20, 1 << 18, 1 << 17
#: Bytes of all chunks up to which they are broadcast; blocks that one task of the joined way compares.
BROADCAST_BYTES, TASK_BLOCKS = 16 << 20, 256
#: Rows compared at once, chunks whose state a task holds, share of surviving pairs below which they are taken one by one.
TILE, HELD, SPARSE = 1024, 64, 0.125

_LONG = np.iinfo(np.int64)


def usable(df: DataFrame, vec_id: Column, vector: Column, label: Column, is_anchor: Column, scale: float) -> DataFrame:
    """(id, label, v array<double> of whole numbers, is_anchor) of the rows that take part."""
    v = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    out = df.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)


def fit_rotation(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Principal axes (columns, leading first) of a sample by hash of about ``FIT_CELLS`` components."""
    share = min(1.0, FIT_CELLS / max(1, n * dims))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").toArrow()
    x = _matrix(picked.column(0).combine_chunks(), dims)
    norm = np.sqrt((x * x).sum(1))
    x = x[np.isfinite(norm) & (norm > 0)]
    if not len(x):
        return np.eye(dims)
    x /= max(1.0, np.abs(x).max())
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers as doubles, one row a vector, padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _packed(ids: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> dict:
    narrow = not len(cells) or np.abs(cells).max() < 1 << 24
    return {"ids": [ids.tobytes()], "labels": [labels.tobytes()], "cells": [cells.astype(np.float32 if narrow else np.float64).tobytes()], "wide": [not narrow]}


def _unpacked(ids: bytes, labels: bytes, cells: bytes, wide: bool, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(cells, np.float64 if wide else np.float32).astype(np.float64).reshape(-1, dims)


PACKED = "ids binary, labels binary, cells binary, wide boolean"


def _least_ids(ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, keep: int) -> np.ndarray:
    """Rows to keep of a block: each different row once, and of equal vectors of one label those with the ``keep`` smallest ids."""
    rows = np.ascontiguousarray(np.column_stack([labels.astype(np.float64), cells + 0.0]))
    key = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, key))
    k, i = key[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    order, k = order[new], k[new]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    rank = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
    return np.sort(order[rank < keep])


def pack_blocks(rows: DataFrame, dims: int, keep: int) -> DataFrame:
    """Blocks of rows, packed where they are read."""
    most = max(1, BLOCK_CELLS // dims)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                ids, labels, cells = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dims)
                kept = _least_ids(ids, labels, cells, keep)
                yield pa.RecordBatch.from_pydict(_packed(ids[kept], labels[kept], cells[kept]))

    return rows.select("id", "label", "v").transform(map_arrow, run, PACKED)


def pack_chunks(anchors: DataFrame, dims: int, n_chunks: int) -> DataFrame:
    """Anchors as ``n_chunks`` rows at most (k, and their packed vectors), dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        current = None

        def packed():
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_pydict({"k": pa.array([current], pa.int32())} | _packed(t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"], dims)))

        for b in batches:
            ks = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), len(ks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if held and ks[lo] != current:
                        yield packed()
                        held = []
                    current = int(ks[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield packed()

    dealt = anchors.select("id", "label", "v").dropDuplicates().select(F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_chunks)).cast("int").alias("k"), "id", "label", "v")
    return dealt.repartition("k").sortWithinPartitions("k").transform(map_arrow, run, f"k int, {PACKED}")


def _meet(blocks: DataFrame, chunks: DataFrame, n_chunks: int, n_blocks: int, size: int) -> DataFrame:
    """Every block beside every chunk: the anchors are a stated query set against all rows, in blocks."""
    every = blocks.select(F.struct("ids", "labels", "cells", "wide").alias("x")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    if size <= BROADCAST_BYTES:
        return every.join(F.broadcast(chunks), "k")
    salts = -(-n_blocks // TASK_BLOCKS)
    salted = chunks.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return every.withColumn("s", F.pmod(F.xxhash64("x.ids"), F.lit(salts).cast("long"))).join(salted, ["k", "s"])


class Rotated:
    """Vectors, their rotation, and the norms of what remains after each slab."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, axes: np.ndarray, cuts: list[int], slack: float):
        self.ids, self.labels, self.cells = ids, labels, cells
        self.rot = cells @ axes
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.cumsum((self.rot * self.rot)[:, ::-1], axis=1)[:, ::-1]
            norm = np.sqrt((cells * cells).sum(1))
            left = [np.sqrt(squares[:, c]) if c < cells.shape[1] else np.zeros(len(ids)) for c in cuts]
            #: Of two factors, each widened by the root of the slack, the product covers the slack of the pair.
            self.tail = np.array([t * (1 + 1e-9) + np.sqrt(slack) * norm for t in left])
        self.finite = bool(np.isfinite(norm * norm).all())
        self.peak = float(np.abs(cells).max()) if cells.size else 0.0

    def take(self, rows: np.ndarray | slice) -> Rotated:
        out = object.__new__(Rotated)
        out.ids, out.labels, out.cells, out.rot, out.tail = self.ids[rows], self.labels[rows], self.cells[rows], self.rot[rows], self.tail[:, rows]
        out.finite, out.peak = self.finite, self.peak
        return out


def survivors(a: Rotated, x: Rotated, floor: np.ndarray, ceiling: np.ndarray | None, allowed: np.ndarray | None, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose score may lie between the anchor's floor and ceiling."""
    if not (a.finite and x.finite):
        return np.nonzero(np.ones((len(a.ids), len(x.ids)), bool) if allowed is None else allowed)
    s = np.zeros((len(a.ids), len(x.ids)))
    stage, at = 0, 0
    while True:
        s += a.rot[:, at : cuts[stage]] @ x.rot[:, at : cuts[stage]].T
        at = cuts[stage]
        rest = np.outer(a.tail[stage], x.tail[stage])
        alive = s + rest >= floor[:, None]
        if ceiling is not None:
            alive &= s - rest <= ceiling[:, None]
        if allowed is not None:
            alive &= allowed
        stage += 1
        if stage == len(cuts) or alive.mean() < SPARSE:
            break
    i, j = np.nonzero(alive)
    v = s[i, j]
    for stage in range(stage, len(cuts)):
        if not len(i):
            break
        v += np.einsum("pc,pc->p", a.rot[i, at : cuts[stage]], x.rot[j, at : cuts[stage]])
        at = cuts[stage]
        rest = a.tail[stage][i] * x.tail[stage][j]
        keep = v + rest >= floor[i]
        if ceiling is not None:
            keep &= v - rest <= ceiling[i]
        i, j, v = i[keep], j[keep], v[keep]
    return i, j


def exact(a: Rotated, x: Rotated, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs, as longs."""
    dims = a.cells.shape[1]
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 22) // max(1, dims))
    small = a.peak * x.peak * dims < 2.0**62
    for lo in range(0, len(i), step):
        p, q = a.cells[i[lo : lo + step]], x.cells[j[lo : lo + step]]
        if small:
            out[lo : lo + step] = np.einsum("pc,pc->p", p.astype(np.int64), q.astype(np.int64))
        else:
            out[lo : lo + step] = [min(max(sum(int(y) * int(z) for y, z in zip(u, w, strict=True)), _LONG.min), _LONG.max) for u, w in zip(p.tolist(), q.tolist(), strict=True)]
    return out


class Best:
    """The best ``k`` (score, id) of each key, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(keys, _LONG.min)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ident = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        order = np.lexsort((ident, ~score, key))
        key, score, ident = key[order], score[order], ident[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])
        key, score, ident = key[new], score[new], ident[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.k
        self.key, self.score, self.id = key[keep], score[keep], ident[keep]
        full = rank == self.k - 1
        self.floor[key[full]] = score[full]


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float64), -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float64), np.inf)


def share_up(score: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * score / 100), without overflow."""
    return percent * (score // 100) - (-percent * (score % 100)) // 100


def share_down(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100), without overflow."""
    return percent * (score // 100) + percent * (score % 100) // 100


def _tiles(n: int) -> Iterator[slice]:
    """A small tile first: it raises the floors."""
    at = 0
    while at < n:
        step = TILE // 8 if at == 0 else TILE
        yield slice(at, min(n, at + step))
        at += step


class Positives:
    """State of one chunk in the first pass: best rows of each anchor's own label."""

    def __init__(self, a: Rotated, k: int, cuts: list[int]):
        self.a, self.cuts, self.best = a, cuts, Best(len(a.ids), k)
        self.of = {int(v): np.flatnonzero(a.labels == v) for v in np.unique(a.labels)}

    def see(self, x: Rotated) -> None:
        order = np.argsort(x.labels, kind="stable")
        values, first = np.unique(x.labels[order], return_index=True)
        for v, lo, hi in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
            mine = self.of.get(v)
            if mine is None:
                continue
            a, own = self.a.take(mine), x.take(order[lo:hi])
            for t in _tiles(hi - lo):
                tile = own.take(t)
                i, j = survivors(a, tile, _down(self.best.floor[mine]), None, None, self.cuts)
                other = a.ids[i] != tile.ids[j]
                i, j = i[other], j[other]
                self.best.add(mine[i], exact(a, tile, i, j), tile.ids[j])

    def rows(self, k: int) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array((k << 32) | b.key), pa.array(self.a.ids[b.key]), pa.array(b.id), pa.array(b.score)], names=["a", "anchor_id", "id", "score"])


class Negatives:
    """State of one chunk in the second pass: best rows of other labels within each positive's range."""

    def __init__(self, a: Rotated, k: int, cuts: list[int], slots: int, low: int, high: int, found: list[dict]):
        self.a, self.cuts, self.slots = a, cuts, slots
        at = np.array([f["i"] * slots + f["slot"] - 1 for f in found], np.int64)
        score = np.array([f["score"] for f in found], np.int64)
        n = len(a.ids) * slots
        self.lo, self.hi = np.full(n, _LONG.max), np.full(n, _LONG.min)
        self.lo[at], self.hi[at] = share_up(score, low), share_down(score, high)
        self.best = Best(n, k)
        self.open = self.lo <= self.hi

    def see(self, x: Rotated) -> None:
        a, slots = self.a, self.slots
        for t in _tiles(len(x.ids)):
            tile = x.take(t)
            lo = np.where(self.open, np.maximum(self.lo, self.best.floor), _LONG.max).reshape(-1, slots)
            hi = np.where(self.open, self.hi, _LONG.min).reshape(-1, slots)
            rows = np.flatnonzero(self.open.reshape(-1, slots).any(1))
            if not len(rows):
                return
            part = a.take(rows)
            i, j = survivors(part, tile, _down(lo[rows].min(1)), _up(hi[rows].max(1)), part.labels[:, None] != tile.labels[None, :], self.cuts)
            score = exact(part, tile, i, j)
            i = rows[i]
            for slot in range(slots):
                inside = (score >= lo[i, slot]) & (score <= hi[i, slot])
                self.best.add(i[inside] * slots + slot, score[inside], tile.ids[j[inside]])

    def rows(self, k: int) -> pa.RecordBatch:
        b = self.best
        i, slot = b.key // self.slots, b.key % self.slots
        return pa.RecordBatch.from_arrays([pa.array((k << 32) | i), pa.array((slot + 1).astype(np.int32)), pa.array(b.id), pa.array(b.score)], names=["a", "slot", "id", "score"])


def _pass(met: DataFrame, axes: np.ndarray, state, schema: str) -> DataFrame:
    """Runs ``state(anchors, cuts, row)`` over the pairs of blocks and chunks of each task; emits what each chunk has found."""
    dims = len(axes)
    cuts = sorted({max(1, dims * q // 4) for q in (1, 2, 3, 4)})
    slack = 8 * dims**1.5 * np.finfo(np.float64).eps + float(np.abs(axes.T @ axes - np.eye(dims)).sum())

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, object] = {}
        last: tuple[bytes, Rotated] | None = None
        for b in batches:
            for row in b.to_pylist():
                x = row["x"]
                if last is None or last[0] != x["ids"]:
                    last = x["ids"], Rotated(*_unpacked(x["ids"], x["labels"], x["cells"], x["wide"], dims), axes, cuts, slack)
                k = row["k"]
                if k not in held:
                    if len(held) >= HELD:
                        old = next(iter(held))
                        yield held.pop(old).rows(old)
                    held[k] = state(Rotated(*_unpacked(row["ids"], row["labels"], row["cells"], row["wide"], dims), axes, cuts, slack), cuts, row)
                held[k].see(last[1])
        for k, s in held.items():
            yield s.rows(k)

    return map_arrow(met, run, schema)


def _leading(df: DataFrame, by: list[str], rank: str, k: int) -> DataFrame:
    """The best k different (score, id) of each group."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    return df.withColumn(rank, F.dense_rank().over(w)).where(F.col(rank) <= k).dropDuplicates([*by, rank])


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(df: DataFrame, vec_id: Column, vector: Column, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256) -> DataFrame:
    """For each anchor and each of its best ``positives``, the best ``negatives`` in the range of its score."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector, label, is_anchor, scale)
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    dims = max(1, dims)
    axes = fit_rotation(rows, n, dims)
    n_chunks = -(-n_anchors * dims // CHUNK_CELLS)
    chunks = materialise(pack_chunks(rows.where("is_anchor"), dims, n_chunks), "anchors")
    blocks = pack_blocks(rows, dims, max(positives + 1, negatives))
    meet = lambda c: _meet(blocks, c, n_chunks, -(-n * dims // BLOCK_CELLS), 8 * n_anchors * (dims + 2 + 3 * positives))
    found = _pass(meet(chunks), axes, lambda a, cuts, _: Positives(a, positives, cuts), "a long, anchor_id long, id long, score long")
    best = materialise(_leading(found, ["a"], "slot", positives), "positives")
    mine = best.groupBy(F.shiftright("a", 32).cast("int").alias("k")).agg(F.collect_list(F.struct(F.col("a").bitwiseAND((1 << 32) - 1).alias("i"), "slot", "score")).alias("found"))
    ranges = materialise(chunks.join(mine, "k"), "ranges")
    held = _pass(meet(ranges), axes, lambda a, cuts, row: Negatives(a, negatives, cuts, positives, low, high, row["found"]), "a long, slot int, id long, score long")
    picked = _leading(held, ["a", "slot"], "rank", negatives).select("a", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = best.select("a", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return materialise(picked, "negatives").join(of, ["a", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), label, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
"""
