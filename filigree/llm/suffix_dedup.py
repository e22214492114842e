"""Operator 3: removal of repeated 200-byte strings, by a logarithmic index family of suffix arrays.

Every 200-byte window of a text belongs to one anchor, the place of its least
40-byte hash (the leftmost of equals). Equal windows have their anchors at
equal offsets, so only texts around anchors with equal 40 bytes need comparing.
An anchor's context is the text that its windows cover.

1. One pass yields, for each anchor, hashes of its 40 bytes and of its context.
2. Anchors with unique 40 bytes go. Those whose whole context occurs again are
   removed with all their windows; one of them stands for them from here on.
3. Contexts that still face different ones are fetched and dealt by their 40
   bytes. Each task keeps a family of suffix arrays over its contexts: a batch
   gets its own suffix array, is merge-scanned against the existing levels (the
   suffixes that share 40 bytes are compared in both directions), and levels of
   equal size merge. Each pair of contexts is met once.
4. Where more than ``SCAN`` contexts share 40 bytes, windows are matched by
   fingerprint instead, within the task; beyond ``CELL`` contexts the windows
   are dealt out as rows, so no task holds an unbounded group.

All stages are distributed; the driver gets nothing. Matches never cross
documents; overlapping repeats count; all is judged on the input.

Defined results: null text counts as empty; texts under 200 bytes are kept
whole; identical rows repeat each other; rows with a null doc_id take part; an
empty table gives no rows; other columns are kept by ``strip_repeats`` and
ignored by ``repeat_report``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import map_arrow, id_filter, map_batches, materialise, null_text, table, with_filter
from filigree.llm.words import _BYTE, Texts, mix64, text_slices

LENGTH, GRAM = 200, 40
#: Contexts with equal 40 bytes that are compared pair by pair, and that one task takes.
SCAN, CELL = 64, 200_000
#: Contexts that get a suffix array together.
BATCH = 4096
#: Bytes of a text that are hashed at once; pieces overlap by LENGTH - 1.
PIECE = 1 << 20

_R = 0x9E3779B97F4A7C15
_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_R**i and _R**-i modulo 2**64 for i up to n."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_R, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


class Rolling:
    """Hashes of any stretch of a byte array from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sum[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sum[b] - self.sum[a]) * self.down[a] + (b - a).astype(np.uint64))


def anchors(t: Texts) -> tuple[np.ndarray, ...]:
    """(document, position, first and last window start, hash of 40 bytes, hash of context); positions in the document."""
    parts = []
    for d0, begin, piece in _pieces(t):
        data, off = piece.data, piece.off
        n = len(data)
        if n < LENGTH:
            continue
        roll = Rolling(data)
        at = np.arange(n - GRAM + 1)
        grams = roll(at, at + GRAM)
        low = (1 << 22) - 1
        tagged = (grams & ~np.uint64(low)) | at.astype(np.uint64)
        w = LENGTH - GRAM + 1
        m = len(tagged)
        rows = -(-m // w) + 1
        grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:m] = tagged
        grid = grid.reshape(rows, w)
        fore = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - LENGTH + 1)
        least = np.minimum(back[starts], fore[starts + w - 1]) & np.uint64(low)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(starts)]
        ok = starts + LENGTH <= off[1:][doc]
        starts, least, doc = starts[ok], least[ok].astype(np.int64), doc[ok]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        p, a, b, d = least[first], starts[first], starts[last], doc[first]
        full = mix64(roll(a, b + LENGTH) + (p - a).astype(np.uint64))
        base = off[d] - begin
        parts.append((d + d0, p - base, a - base, b - base, grams[p], full))
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pieces(t: Texts):
    """(first document, offset of the piece in it, Texts): slices of whole documents, long ones in pieces."""
    sizes = np.diff(t.off)
    i = 0
    while i < len(t):
        if sizes[i] > PIECE:
            for a in range(0, int(sizes[i]) - LENGTH + 1, PIECE):
                b = min(int(sizes[i]), a + PIECE + LENGTH - 1)
                yield i, a, Texts(t.data[t.off[i] + a : t.off[i] + b], np.array([0, b - a]))
            i += 1
            continue
        j = i
        while j < len(t) and sizes[j] <= PIECE and t.off[j + 1] - t.off[i] <= 2 * PIECE:
            j += 1
        yield i, 0, Texts(t.data[t.off[i] : t.off[j]], t.off[i : j + 1] - t.off[i])
        i = j


class Family:
    """Levels of suffix arrays over contexts, as a binary counter of sizes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.left = length, gram, length - gram
        self.levels: list[tuple[np.ndarray, ...]] = []  # right bytes, left bytes, lo, hi, row; sorted by right bytes
        self.marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, first and last offset of repeated windows

    def add(self, right: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> None:
        """right: (n, length) bytes from the anchor on; left: (n, length - gram) bytes before it, nearest first; windows begin lo to hi bytes before it."""
        order = np.argsort(_key(right), kind="stable")
        new = tuple(x[order] for x in (right, left, lo, hi, row))
        self._scan(new, new, True)
        for level in self.levels:
            self._scan(new, level, False)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = tuple(np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
            order = np.argsort(_key(both[0]), kind="stable")
            self.levels.append(tuple(x[order] for x in both))

    def _scan(self, new, level, same: bool) -> None:
        prefix = _key(np.ascontiguousarray(level[0][:, : self.gram]))
        mine = _key(np.ascontiguousarray(new[0][:, : self.gram]))
        a, b = np.searchsorted(prefix, mine, "left"), np.searchsorted(prefix, mine, "right")
        if same:
            a = np.arange(len(mine)) + 1
        n = np.maximum(b - a, 0)
        i = np.repeat(np.arange(len(mine)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        for s in range(0, len(i), 1 << 15):
            self._compare(new, i[s : s + (1 << 15)], level, j[s : s + (1 << 15)])

    def _compare(self, x, i, y, j) -> None:
        lo, hi = np.maximum(x[2][i], y[2][j]), np.minimum(x[3][i], y[3][j])
        live = lo <= hi
        i, j, lo, hi = i[live], j[live], lo[live], hi[live]
        r = _common(x[0][i], y[0][j])
        lo = np.maximum(lo, self.length - r)
        hi = np.minimum(hi, _common(x[1][i], y[1][j]))
        live = lo <= hi
        if live.any():
            self.marks.append((x[4][i[live]], lo[live], hi[live]))
            self.marks.append((y[4][j[live]], lo[live], hi[live]))


def _key(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(f"S{a.shape[1]}").ravel()


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    diff = a != b
    return np.where(diff.any(axis=1), diff.argmax(axis=1), a.shape[1])


def _frame(batch, n: int, length: int = LENGTH, gram: int = GRAM):
    """Right and left byte matrices of the contexts (column 5) of a batch, with lo and hi."""
    ctx = batch.column(5)
    off = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + n + 1].astype(np.int64)
    data = np.frombuffer(ctx.buffers()[2], np.uint8)
    pos, a, b = (batch.column(i).to_numpy() for i in (2, 3, 4))
    lo, hi = pos - b, pos - a
    mid = off[:-1] + hi
    r = mid[:, None] + np.arange(length)
    ok = r < off[1:][:, None]
    right = np.where(ok, data[np.minimum(r, len(data) - 1)], 0).astype(np.uint8)
    q = mid[:, None] - 1 - np.arange(length - gram)
    ok = q >= off[:-1][:, None]
    left = np.where(ok, data[np.maximum(q, 0)], 0).astype(np.uint8)
    return right, left, lo, hi


def _window_hashes(right, left, lo, hi):
    """(row, offset, fingerprint) of every window of the contexts."""
    whole = np.concatenate([left[:, ::-1], right], axis=1)
    width, reach = whole.shape[1], left.shape[1]
    roll = Rolling(whole.ravel())
    n = hi - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    at = row * width + reach - d
    return row, d, mix64(roll(at, at + LENGTH) + d.astype(np.uint64))


def _mark(batches):
    """Repeated stretches (doc, a, b) of contexts (gram, doc, pos, a, b, context, m) dealt by gram."""
    family, pos, docs, n = Family(), [], [], 0
    big: list[tuple] = []
    for b in batches:
        for s in range(0, b.num_rows, BATCH):
            part = b.slice(s, BATCH)
            right, left, lo, hi = _frame(part, part.num_rows)
            docs.append(part.column(1).to_numpy())
            pos.append(part.column(2).to_numpy())
            row = np.arange(part.num_rows) + n
            n += part.num_rows
            small = part.column(6).to_numpy() <= SCAN
            if small.any():
                family.add(*(x[small] for x in (right, left, lo, hi, row)))
            if not small.all():
                r, d, h = _window_hashes(*(x[~small] for x in (right, left, lo, hi)))
                big.append((row[~small][r].astype(np.int32), d.astype(np.int16), h + mix64(part.column(0).to_numpy().view(np.uint64)[~small][r])))
    marks = family.marks
    if big:
        r, d, h = (np.concatenate(x) for x in zip(*big, strict=True))
        o = np.argsort(h)
        same = h[o][1:] == h[o][:-1]
        twice = np.zeros(len(h), bool)
        twice[o[1:][same]] = True
        twice[o[:-1][same]] = True
        marks.append((r[twice], d[twice].astype(np.int64), d[twice].astype(np.int64)))
    if marks:
        row, lo, hi = (np.concatenate(x) for x in zip(*marks, strict=True))
        p, doc = np.concatenate(pos)[row], np.concatenate(docs)[row]
        yield from _stretches(doc, p - hi, p - lo + LENGTH)


def _stretches(doc, a, b):
    """Maximal stretches of each document as a batch (doc, a, b)."""
    o = np.lexsort((a, doc))
    doc, a, b = doc[o], a[o], b[o]
    reach = np.empty_like(b)
    # Running maxima within a document: documents are lifted apart by their order.
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64)
    lift = rank * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(a[first].astype(np.int64)), pa.array(reach[last].astype(np.int64))], names=["doc", "a", "b"])


def _row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), null_text())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, a, b): repeated byte stretches of the rows whose ``_row_key`` is doc; they may touch or overlap."""
    keyed = docs.select(_row_key().alias("doc"), "text")

    def find(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy()
        for i, _, t in text_slices(batch.column(1)):
            d, p, a, b, g, f = anchors(t)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[i + d]), pa.array(p.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["gram", "full", "doc", "pos", "a", "b"])

    found = materialise(map_batches(keyed, find, "gram long, full long, doc long, pos int, a int, b int"), "anchors")
    twice = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("full") != F.max("full")).alias("differ")).where("n > 1").select("gram", "differ")
    shared = materialise(found.join(twice, "gram"), "anchors-shared")
    whole = shared.groupBy("gram", "full").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "a")).alias("first")).where("n > 1").select("gram", "full", "first")
    known = materialise(shared.join(whole, ["gram", "full"], "left"), "anchors-known")
    sure = known.where("first IS NOT NULL").select("doc", F.col("a").cast("long").alias("a"), (F.col("b") + LENGTH).cast("long").alias("b"))
    open_ = known.where(F.col("differ") & (F.col("first").isNull() | ((F.col("first.doc") == F.col("doc")) & (F.col("first.pos") == F.col("pos")) & (F.col("first.a") == F.col("a")))))
    open_ = open_.dropDuplicates(["gram", "doc", "pos", "a"])
    sizes = open_.groupBy("gram").agg(F.count("*").alias("m"))
    open_ = open_.join(sizes, "gram").where("m > 1").select("gram", "m", "doc", "pos", "a", "b")
    spots = open_.groupBy("doc").agg(F.collect_list(F.struct("gram", "m", "pos", "a", "b")).alias("spots"))
    spots = materialise(spots, "spots")
    texts = _wanted(keyed, spots.select("doc")).dropDuplicates(["doc"])

    def cut(batch: pa.RecordBatch):
        rows = []
        for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            rows += [(s["gram"], doc, s["pos"], s["a"], s["b"], raw[s["a"] : s["b"] + LENGTH], s["m"]) for s in spots]
            if len(rows) > 20_000:
                yield _context_batch(rows)
                rows = []
        if rows:
            yield _context_batch(rows)

    contexts = map_batches(texts.join(spots, "doc").select("doc", "text", "spots"), cut, "gram long, doc long, pos int, a int, b int, context binary, m long")
    contexts = materialise(contexts, "contexts")
    near = contexts.where(F.col("m") <= CELL).repartition("gram").transform(map_arrow, _mark, "doc long, a long, b long")

    def rows_of(batch: pa.RecordBatch):
        for s in range(0, batch.num_rows, BATCH):
            part = batch.slice(s, BATCH)
            r, d, h = _window_hashes(*_frame(part, part.num_rows))
            at = part.column(2).to_numpy()[r] - d
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(h.view(np.int64)), part.column(1).take(pa.array(r)), pa.array(at.astype(np.int64))], names=["gram", "h", "doc", "a"])

    far = map_batches(contexts.where(F.col("m") > CELL), rows_of, "gram long, h long, doc long, a long")
    again = far.groupBy("gram", "h").agg(F.count("*").alias("n")).where("n > 1").select("gram", "h")
    far = far.join(again, ["gram", "h"], "left_semi").select("doc", "a", (F.col("a") + LENGTH).alias("b"))
    return sure.union(near).union(far)


def _context_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "doc", "pos", "a", "b", "context", "m"])


def _wanted(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    return with_filter(keyed, id_filter(ids, "doc"), "doc").where("_may").drop("_may")


def _cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal runs removed)."""
    out, at, runs, gone = [], 0, 0, 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out.append(raw[at:a])
        at = b
        runs += 1
        gone += b - a
    out.append(raw[at:])
    return b"".join(out), gone, runs


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = docs.select("doc_id", "text")
    spans = materialise(repeats(docs), "repeats")

    def merge(batches):
        for b in batches:
            if b.num_rows:
                yield from _stretches(*(b.column(i).to_numpy() for i in range(3)))

    spans = spans.repartition("doc").transform(map_arrow, merge, "doc long, a long, b long")
    spans = materialise(spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeats-merged")
    keyed = with_filter(docs.withColumn("doc", _row_key()), id_filter(spans.select("doc"), "doc"), "doc")
    t = null_text().cast("binary")
    clean = keyed.where(~F.col("_may")).select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(t, 256).alias("kept_sha256"))

    def run(batch: pa.RecordBatch):
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            rest, gone, runs = _cut_out(raw, [(s["a"], s["b"]) for s in spans or []])
            rows.append((doc, len(raw), gone, runs, hashlib.sha256(rest).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = map_batches(keyed.where("_may").join(spans, "doc", "left").select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return clean.union(cut)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
