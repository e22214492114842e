"""Operator 2: benchmark decontamination by template canonicalisation.

Texts become sequences of lower-case words without punctuation. A run of
numbers, in digits or words, becomes one <num>, a unit after a number or grown
together with it <unit>, a run of capitalised words one <name>; the first word
of a sentence counts as a name unless it is one of ``OPENERS``. An item is found
in a document when five-element windows on nearly one diagonal cover enough of
it; then the slots are compared: the same value in the item must always face the
same value in the document, and two names never face one. Each window of the
item faces one of the document, and the best of all diagonals counts. Equal
values mean a verbatim copy, other consistent ones a re-parameterised question.

Windows are joined by their hashes. As a copy holds ``COVERAGE`` of an item's
windows, it holds at least one of the rest and one more: each item offers only
that many, those that fewest items share, so that windows common to many items
make no pairs. Documents offer windows that pass a bit set of fixed size over the
benchmark's. The pairs of text and item that meet are then judged on whole texts,
equal texts once; items reach a text's task as a sorted stream. Nothing of the
benchmark but the bit set is on the driver.

Defined results: null, empty and blank texts hold nothing; an item of fewer
than five elements is one window of all of them, looked up in every document;
an item whose windows all have fewer than two words beside slots is looked up by
its words and numbers as they stand (elements are then words), and one of a
single word only in documents that are nothing else; items without a word or
number are skipped; repeated rows give repeated results; an empty table gives no rows;
other columns are kept by ``remove_contaminated`` and ignored by ``matches``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.frames import id_filter, map_arrow, map_batches, materialise, table, with_filter
from filigree.llm.words import Texts, mix64, text_slices, windows, word_hashes, words

K = 5
#: Share of an item's windows that must be found, and how far diagonals may drift.
COVERAGE, DRIFT = 0.6, 6
#: Bits of the filter over the benchmark's windows: two megabytes, whatever its size.
FILTER_BITS = 24
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
#: Words that open sentences and are no names.
OPENERS = "a an the this that these those it its he she they we you i his her their our your my there here if when while after before since because as at in on by for from to with of and but or so then what which who whom whose where why how each every all some many most any no not is are was were do does did can could will would should may let suppose given find calculate determine consider assume during once".split()
UNITS = "km m cm mm kg g mg t l ml h s ms hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent usd eur gbp percent miles mile feet foot inches inch pounds pound ounces ounce mph kmh watts volts degrees".split()

_FOLD = np.full(256, 32, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_FOLD[128:] = np.arange(128, 256)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True
_TAGS = mix64(np.array([11, 12, 13], dtype=np.uint64))
WORD, NUM, UNIT, NAME = 0, 1, 2, 3


class Sequence:
    """Elements of the texts of a slice: hashes, kinds and bytes."""

    def __init__(self, data, h, off, kind, starts, ends):
        self.data, self.h, self.off, self.kind, self.starts, self.ends = data, h, off, kind, starts, ends
        self._held: dict[int, tuple] = {}

    def held(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first elements, at least two words) of the windows of k elements, in order, computed once."""
        if k not in self._held:
            win, off = windows(self.h, self.off, k, False)
            first = np.arange(len(win)) - np.repeat(off[:-1] - self.off[:-1], np.diff(off))
            lit = np.concatenate([[0], np.cumsum(self.kind == WORD)])
            self._held[k] = win, first, lit[first + k] - lit[first] >= 2
        return self._held[k]

    def value(self, i: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes().split())


class Templates(Sequence):
    """Template sequences of the texts of a slice; ``words`` has their words as they stand."""

    def __init__(self, t: Texts):
        folded = Texts(_FOLD[t.data], t.off)
        self._held = {}
        starts, ends, woff = words(folded)
        dig = np.concatenate([[0], np.cumsum(_DIGIT[folded.data])])
        starts, ends, woff = _parted(folded.data, dig, starts, ends, woff)
        h = word_hashes(folded, starts, ends)
        self.words = Sequence(folded.data, h, woff, np.zeros(len(h), np.int8), starts, ends)
        n = len(starts)
        kind = np.zeros(n, np.int8)
        if n:
            num = (dig[ends] > dig[starts]) | np.isin(h, _NUMBER_HASHES)
            first = np.zeros(n, bool)
            first[woff[:-1][np.diff(woff) > 0]] = True
            raw = t.data
            lead = raw[starts]
            nxt = raw[np.minimum(starts + 1, len(raw) - 1)]
            upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
            stop = np.concatenate([[0], np.cumsum(_STOP[raw])])
            opens = first.copy()
            opens[1:] |= stop[starts[1:]] > stop[ends[:-1]]
            kind[upper & ~(opens & np.isin(h, _OPENER_HASHES))] = NAME
            kind[num] = NUM
            after = np.zeros(n, bool)
            after[1:] = num[:-1] & ~first[1:]
            kind[after & ~num & np.isin(h, _UNIT_HASHES)] = UNIT
            same = np.zeros(n, bool)
            same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != WORD) & ~first[1:] & ~(opens[1:] & (kind[1:] == NAME))
            keep = ~same
        else:
            keep = np.zeros(0, bool)
        at = np.flatnonzero(keep)
        total = np.concatenate([[0], np.cumsum(keep)])
        self.off = total[woff]
        self.kind = kind[at]
        h = h[at]
        slot = self.kind != WORD
        h[slot] = _TAGS[self.kind[slot] - 1]
        self.starts, self.ends = starts[at], ends[np.append(at[1:], n) - 1] if len(at) else ends[:0]
        self.data = folded.data
        self.h = h


def _parted(data: np.ndarray, dig: np.ndarray, starts: np.ndarray, ends: np.ndarray, woff: np.ndarray):
    """Words with those parted that are a number and a unit grown together."""
    digits = dig[ends] - dig[starts]
    cut = {}
    for w in np.flatnonzero((digits > 0) & (digits < ends - starts) & (ends - starts <= 40)):
        m = _GLUED.fullmatch(data[starts[w] : ends[w]].tobytes())
        if m and m[2] in _UNIT_SET:
            cut[w] = starts[w] + len(m[1])
    if not cut:
        return starts, ends, woff
    at = np.array(list(cut), np.int64)
    where = np.array(list(cut.values()), np.int64)
    return np.insert(starts, at + 1, where), np.insert(ends, at, where), woff + np.searchsorted(at, woff)


_GLUED = re.compile(rb"([0-9]+)([a-z]+)")
_UNIT_SET = {u.encode() for u in UNITS}


def _hashes(names: list[str]) -> np.ndarray:
    t = next(text_slices(pa.array([" ".join(names)])))[2]
    s, e, _ = words(t)
    return word_hashes(t, s, e)


_UNIT_HASHES, _NUMBER_HASHES, _OPENER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS), _hashes(OPENERS)


class Item:
    """One benchmark item: its telling windows, and the slot values and kinds of its elements.

    A short item has one window of its own length; an item without a window of
    two words in its template is looked up by its words as they stand (plain).
    """

    def __init__(self, text: str | None):
        t = next(text_slices(pa.array([text], pa.string())))[2]
        p = Templates(t)
        self.places: dict[int, list[int]] = {}
        self.size = self.length = 0
        for self.plain, q in ((False, p), (True, p.words)):
            self.length = min(K, len(q.h))
            if not self.length:
                continue
            win, first, telling = q.held(self.length)
            use = np.arange(len(win)) if self.plain else np.flatnonzero(telling)
            if len(use):
                for w, place in zip(win[use].tolist(), first[use].tolist(), strict=True):
                    self.places.setdefault(w, []).append(place)
                self.size = len(use)
                self.slots = [q.value(i) if q.kind[i] != WORD else None for i in range(len(q.h))]
                self.kinds = q.kind
                break
        self.key = np.array(sorted(self.places), np.uint64)

    def offered(self) -> list[tuple[int, int]]:
        """(window under its length and way, its places) of all telling windows."""
        return [(tagged(w, self.plain, self.length), len(x)) for w, x in self.places.items()]

    def find(self, p: Templates, d: int, coverage: float) -> tuple[float, int, int, bool, bool] | None:
        """(coverage, first and last element, equal, consistent) of the best copy in document d of the slice."""
        q = p.words if self.plain else p
        a, b = int(q.off[d]), int(q.off[d + 1])
        if not self.size or b - a < self.length or (self.plain and self.length == 1 and b - a != 1):  # one word alone is no copy within a longer text
            return None
        win, first, telling = q.held(self.length)
        lo, hi = np.searchsorted(first, [a, b])
        at = np.minimum(np.searchsorted(self.key, win[lo:hi]), len(self.key) - 1)
        hits = lo + np.flatnonzero((self.key[at] == win[lo:hi]) & (telling[lo:hi] | self.plain))
        rows = [(int(first[w]) - a - place, place, int(first[w])) for w in hits for place in self.places[int(win[w])]]
        least = coverage * self.size
        if len({r[1] for r in rows}) < least:
            return None
        best = self._best(rows, q, least)
        if best is None:
            return None
        same, fits, n, begin, end = best
        return n / self.size, begin - a, end - a, same, fits

    def _best(self, rows: list[tuple[int, int, int]], p: Sequence, least: float) -> tuple[bool, bool, int, int, int] | None:
        """(equal, consistent, windows found, first and last element) of the best copy: equal before consistent ones, then the most windows, then the earliest.

        Every diagonal is judged, with those up to DRIFT beyond it; each window
        of the item faces one window of the document.
        """
        rows.sort()
        diagonals = [r[0] for r in rows]
        equal = {r: self._slots([r], p)[0] for r in rows}
        best = None
        for base in sorted(set(diagonals)):
            near = rows[bisect_left(diagonals, base) : bisect_right(diagonals, base + DRIFT)]
            if len({r[1] for r in near}) < least:
                continue
            for anchor in sorted({r[0] for r in near}):
                for prefer in (equal, {}):
                    one: dict[int, tuple] = {}
                    for r in near:
                        rank = (not prefer.get(r, False), abs(r[0] - anchor), r)
                        if r[1] not in one or rank < one[r[1]]:
                            one[r[1]] = rank
                    faced = [x[2] for x in one.values()]
                    same, fits = self._slots(faced, p)
                    first = min(r[2] for r in faced)
                    judged = ((same, fits, len(faced), -first), (same, fits, len(faced), first, max(r[2] for r in faced)))
                    best = judged if best is None or judged[0] > best[0] else best
                    if same:
                        break
        return best[1] if best else None

    def _slots(self, rows, p: Sequence) -> tuple[bool, bool]:
        """(all slots have equal values, each item value faces one value and no two names face one)."""
        faces: dict[bytes, set[bytes]] = defaultdict(set)
        names: dict[bytes, set[bytes]] = defaultdict(set)
        for _, place, first in rows:
            for k in range(self.length):
                mine = self.slots[place + k]
                if mine is not None:
                    value = p.value(first + k)
                    faces[mine].add(value)
                    if self.kinds[place + k] == NAME:
                        names[value].add(mine)
        return all(v == {k} for k, v in faces.items()), all(len(v) == 1 for v in [*faces.values(), *names.values()])


def tagged(window: int, plain: bool, length: int) -> int:
    """A window's hash as the join sees it, signed."""
    x = (window + (2 * length + plain) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def _offers(items: DataFrame, coverage: float) -> DataFrame:
    """(item, win): for each distinct item text the windows one of which every copy holds, those that fewest items share."""

    def run(batch: pa.RecordBatch):
        rows = [(k, w, n, item.size, 2 * item.length + item.plain) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item in [Item(t)] for w, n in item.offered()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if not i else pa.int64()) for i in range(5)], names=["item", "win", "places", "size", "way"])

    offered = map_batches(items.select("item", "item_text"), run, "item string, win long, places long, size long, way long")
    shared = offered.groupBy("win").agg(F.count("*").alias("items"))
    # The windows beyond the first ones have fewer places than a copy must cover.
    rest = F.sum("places").over(Window.partitionBy("item").orderBy(F.desc("items"), "win"))
    return offered.join(shared, "win").withColumn("rest", rest - F.col("places")).where(F.col("rest") < F.ceil(F.lit(coverage) * F.col("size"))).select("item", "win", "way")


def _bits(offers: DataFrame) -> np.ndarray:
    """A bit set over the windows on offer."""
    place = F.shiftrightunsigned("win", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    rows = offers.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def _met(docs: DataFrame, offers: DataFrame) -> DataFrame:
    """(digest, item) of the texts and items that share a window on offer."""
    ways = [(bool(r[0]), r[1]) for r in offers.select((F.col("way") % 2).alias("p"), F.expr("way div 2").cast("int").alias("k")).distinct().collect()]
    bits = _bits(offers)

    def run(batch: pa.RecordBatch):
        texts = batch.column(0)
        found: set[tuple[str, int]] = set()
        for i, _, t in text_slices(texts):
            p = Templates(t)
            for plain, length in ways:
                q = p.words if plain else p
                win, first, telling = q.held(length)
                x = win + np.uint64(((2 * length + plain) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
                at = x >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) & (telling | plain))
                doc = np.searchsorted(q.off, first[hit], "right") - 1
                for d in np.unique(doc):
                    digest = hashlib.md5((texts[i + int(d)].as_py() or "").encode()).hexdigest()
                    found |= {(digest, w) for w in x[hit[doc == d]].view(np.int64).tolist()}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64())], names=["digest", "win"])

    hits = map_batches(docs.select("text"), run, "digest string, win long").distinct()
    return hits.join(offers, "win").select("digest", "item").distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(digest, item_id, coverage, first_element, last_element, verbatim, consistent) of the texts in which items are found."""
    named = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text IS NOT NULL").withColumn("item", F.md5(F.col("item_text").cast("binary")))
    items = named.groupBy("item").agg(F.first("item_text").alias("item_text"))
    offers = materialise(_offers(items, coverage), "offers")
    met = materialise(_met(docs, offers), "met")
    texts = docs.select("text").withColumn("digest", _digest())
    texts = with_filter(texts, id_filter(met, "digest"), "digest").where("_may").select("digest", "text").dropDuplicates(["digest"])
    none = F.lit(None).cast("string")
    rows = met.join(items, "item").select("digest", F.col("item").alias("item"), F.col("item_text").alias("text")).union(texts.join(met.select("digest").distinct(), "digest").select("digest", none, "text"))

    def run(batches):
        digest, p, cached = None, None, {}
        for b in batches:
            out = []
            for key, item, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if item is None:  # the text comes before its items
                    digest, p = key, Templates(next(text_slices(pa.array([text], pa.string())))[2])
                    continue
                if item not in cached:
                    if len(cached) >= 1000:
                        cached.clear()
                    cached[item] = Item(text)
                found = cached[item].find(p, 0, coverage) if key == digest else None
                if found:
                    out.append((key, item, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["digest", "item", *[f.split()[0] for f in SCHEMA.split(", ")[2:]]])

    found = rows.repartition("digest").sortWithinPartitions("digest", F.col("item").asc_nulls_first()).transform(map_arrow, run, "digest string, item string, " + SCHEMA.split(", ", 2)[2])
    return materialise(found, "judged").join(named.select("item", "item_id"), "item").drop("item")


def _digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


SCHEMA = "doc_id long, item_id long, coverage double, first_element long, last_element long, verbatim boolean, consistent boolean"


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each benchmark item found in a document with consistent slots."""
    found = _judged(docs, benchmark, coverage).where("consistent")
    mine = with_filter(docs.select("doc_id", _digest().alias("digest")), id_filter(found, "digest"), "digest").where("_may").drop("_may")
    return mine.join(found, "digest").select(*[f.split()[0] for f in SCHEMA.split(", ")])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows in which an item is found; rows that the filter clears pass by without a shuffle."""
    gone = _judged(docs, benchmark, coverage).where("consistent").select(F.col("digest").alias("_digest")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_digest", _digest("_row.text"))
    rows = with_filter(rows, id_filter(gone, "_digest"), "_digest")
    return rows.where("NOT _may").select("_row.*").union(rows.where("_may").join(gone, "_digest", "left_anti").select("_row.*"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
