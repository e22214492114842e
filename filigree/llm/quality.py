"""Operator 9: quality rules as a short-circuit cascade.

The rules form a conjunction, so their order does not change a verdict, only
its cost. Each rule's cost (seconds a document) and selectivity (share that it
rejects) are measured on a sample, and rules run in descending order of
rejections per second; a document that one rule rejects never reaches the next.
The base figures that the report returns are computed for every document.

Defined results: null text counts as empty; an empty or blank document has all
figures 0 and fails the base rule; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored; very long texts are judged
whole, one at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import map_arrow, map_batches, small_batches, table
from filigree.llm.words import SAME, Texts, text_slices, windows, word_hashes, words

#: The sample that orders the rules: share of all rows, and bytes of text that one task measures at most.
#: The order changes cost, never results.
SAMPLE_SHARE, SAMPLE_BYTES = 0.01, 1 << 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_HEAD = np.ones(256, dtype=bool)
_HEAD[0x80:0xC0] = False  # UTF-8 continuation bytes


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _groups(key: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by document and value, True where a value equals the one before it in its document)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return order, same


class Slice:
    """Figures of the documents of one slice, computed when first asked for."""

    def __init__(self, t: Texts):
        self.t = t
        self.starts, self.ends, self.word_off = words(t)
        self.n_words = np.diff(self.word_off)
        self._h: np.ndarray | None = None

    @property
    def h(self) -> np.ndarray:
        if self._h is None:
            self._h = word_hashes(self.t, self.starts, self.ends, SAME)
        return self._h

    def word_chars(self) -> np.ndarray:
        heads = _HEAD[self.t.data]
        total = np.zeros(len(heads) + 1, np.int64)
        np.cumsum(heads, out=total[1:])
        each = total[self.ends] - total[self.starts]
        s = np.concatenate([[0], np.cumsum(each)])
        return s[self.word_off[1:]] - s[self.word_off[:-1]]

    def n_symbols(self) -> np.ndarray:
        return _per_doc(_SYMBOL[self.t.data], self.t.off)

    def n_dup_lines(self) -> np.ndarray:
        return self._lines()[0]

    def n_lines(self) -> np.ndarray:
        return self._lines()[1]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(repeated lines, lines) among the lines that hold a word."""
        t = self.t
        cut = np.flatnonzero(t.data == 10)
        starts = np.unique(np.concatenate([t.off[:-1], cut + 1]))
        starts = starts[starts < len(t.data)]
        if not len(starts):
            z = np.zeros(len(t), np.int64)
            return z, z
        stops = np.append(starts[1:], len(t.data))
        stops = stops - ((stops > starts) & (t.data[stops - 1] == 10))
        # A line runs to its \n or to its document's end; its bytes are hashed whole.
        has = np.searchsorted(self.starts, starts) < np.searchsorted(self.starts, stops)
        starts, stops = starts[has], stops[has]
        doc_off = np.searchsorted(starts, t.off)
        hashed = word_hashes(t, starts, stops, SAME)
        order, same = _groups(hashed, doc_off)
        flags = np.zeros(len(starts), bool)
        flags[order] = same
        return _per_doc(flags, doc_off), np.diff(doc_off)

    def n_repeat_words(self, k: int = 8) -> np.ndarray:
        win, off = windows(self.h, self.word_off, k, whole_short=False)
        order, same = _groups(win, off)
        twice = same.copy()
        twice[:-1] |= same[1:]
        hot = np.zeros(len(win), bool)
        hot[order] = twice
        n = np.diff(off)
        at = np.arange(len(win)) - np.repeat(off[:-1] - self.word_off[:-1], n)
        mark = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(mark, at[hot], 1)
        np.add.at(mark, np.minimum(at[hot] + k, len(self.h)), -1)
        return _per_doc(np.cumsum(mark[:-1]) > 0, self.word_off)

    def upper(self) -> np.ndarray:
        return _per_doc(_UPPER[self.t.data], self.t.off)

    def letters(self) -> np.ndarray:
        return _per_doc(_LETTER[self.t.data], self.t.off)

    def runs(self) -> np.ndarray:
        """Words equal to the word before them."""
        same = np.zeros(len(self.h), bool)
        same[1:] = self.h[1:] == self.h[:-1]
        same[self.word_off[:-1][self.n_words > 0]] = False
        return _per_doc(same, self.word_off)

    def solid_bytes(self) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return s[self.word_off[1:]] - s[self.word_off[:-1]]


#: Each rule gives True for the documents that it rejects.
RULES: dict[str, Callable[[Slice], np.ndarray]] = {
    "symbols": lambda s: 10 * s.n_symbols() > s.n_words,
    "capitals": lambda s: 10 * s.upper() > 4 * s.letters(),
    "runs": lambda s: 10 * s.runs() > 2 * s.n_words,
    "dup_lines": lambda s: 10 * s.n_dup_lines() > 4 * s.n_lines(),
    "few_letters": lambda s: 10 * s.letters() < 5 * s.solid_bytes(),
    "long_words": lambda s: s.solid_bytes() > 25 * s.n_words,
}


def measure(t: Texts, rules: dict[str, Callable[[Slice], np.ndarray]] = RULES) -> dict[str, tuple[int, float]]:
    """(documents rejected, seconds) of each rule on its own."""
    out = {}
    for name, rule in rules.items():
        s = Slice(t)
        began = time.perf_counter()
        rejected = int(rule(s).sum())
        out[name] = rejected, time.perf_counter() - began
    return out


def order_rules(figures: dict[str, tuple[int, float]]) -> list[str]:
    """Rule names by rejections per second, highest first."""
    return sorted(figures, key=lambda k: (-(figures[k][0] + 0.5) / (figures[k][1] + 1e-9), k))


def sampled_order(docs: DataFrame) -> list[str]:
    """The rules in order of what tasks measure on their parts of a random sample; only sums reach the driver."""

    def run(batches):
        spent = 0
        for b in batches:
            for _, _, t in text_slices(b.column(0), SAMPLE_BYTES):
                if spent < SAMPLE_BYTES and len(t.data) <= SAMPLE_BYTES:
                    spent += len(t.data)
                    for name, (rejected, seconds) in measure(t).items():
                        yield pa.RecordBatch.from_pydict({"rule": [name], "rejected": pa.array([rejected], pa.int64()), "seconds": [seconds]})

    sums = docs.select("text").sample(False, SAMPLE_SHARE, 9).transform(map_arrow, run, "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds"))
    with small_batches(docs.sparkSession):
        return order_rules({name: (0, 0.0) for name in RULES} | {r[0]: (r[1], r[2]) for r in sums.collect()})


def _sub(t: Texts, keep: np.ndarray) -> Texts:
    lens = np.diff(t.off)
    off = np.concatenate([[0], np.cumsum(lens[keep])])
    return Texts(t.data[np.repeat(keep, lens)], off)


def cascade(t: Texts, order: list[str], rules: dict[str, Callable[[Slice], np.ndarray]] = RULES) -> np.ndarray:
    """True for the documents that pass all rules; each rule sees only what earlier ones have kept."""
    alive = np.arange(len(t))
    s = Slice(t)
    for name in order:
        bad = rules[name](s)
        if bad.any():
            alive = alive[~bad]
            s = Slice(_sub(s.t, ~bad))
        if not len(alive):
            break
    out = np.zeros(len(t), bool)
    out[alive] = True
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_report(docs: DataFrame) -> DataFrame:
    order = sampled_order(docs)

    def run(batch: pa.RecordBatch):
        ids = batch.column(0)
        for i, j, t in text_slices(batch.column(1)):
            s = Slice(t)
            n, rep = s.n_words, s.n_repeat_words()
            failed = (n < 20) | (100 * rep > 30 * n)
            kept = np.zeros(len(t), bool)
            if (~failed).any():
                kept[~failed] = cascade(_sub(t, ~failed), order)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, (n, s.word_chars(), s.n_symbols(), s.n_dup_lines(), rep, failed, kept))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
