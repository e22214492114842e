"""Operator 5: toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs of other scripts and full-width
forms to Latin letters, invisible characters dropped, punctuation to spaces,
digits and signs inside words to the letters they stand for. The lexicon holds
whole words, with their plain inflections, and stems, all with weights and all
found by one automaton in one pass; matches inside exception phrases do not
count. The sum of weights, as it is and for the length of the text, gives a
score between 0 and 1.

The lexicon, exceptions and the score weights are learnt from a bounded sample
of at most ``SAMPLE_ROWS`` labelled rows outside the held-out fold. A word
beginning is telling when it is far likelier in toxic rows and follows enough
different words there, so that copies of one text give no entries. Of nested
beginnings the longest that keeps nearly all their toxic rows enters, as a whole
word if it is one: "path" gives way to "pathetic", while a stem stays one whose
endings vary. Two-word phrases with an entry that several clean rows have and no
toxic one become exceptions, beside those given.

Defined results: null text counts as empty and gets the score of no match;
rows with a null doc_id are in no fold and are scored; null labels are not
learnt from; without labels of both kinds every score is 0; repeated rows give
repeated results; an empty table gives no rows; other columns are kept by
``remove_toxic`` and ignored by ``toxicity_report``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import map_arrow, map_batches, small_batches, table

SAMPLE_ROWS = 8000
#: Lengths of word beginnings, different preceding words, and log odds that an entry needs.
SHORTEST, LONGEST, CONTEXTS, ODDS = 4, 9, 6, 3.0
#: Share of a beginning's toxic rows that a longer one must keep to take its place.
KEPT = 0.9
#: Clean rows that make a phrase an exception.
CLEAN_ROWS = 5
#: Endings with which a whole word counts too.
ENDINGS = ("", "s", "es", "ed", "ing", "ly")
#: Phrases in which an entry is harmless, as folded words.
EXCEPTIONS = ("clown fish", "trash can", "trash cans", "trash bin", "trash bag", "sore loser rule", "idiot proof", "stupid easy", "pond scum")

#: Letters of other scripts that look like Latin ones.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ı": "i", "ɑ": "a", "ɡ": "g", "ꜱ": "s",
}
_TABLE = {ord(k): v for k, v in _LOOKS.items()}
_TABLE |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_TABLE |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])
_TABLE |= dict.fromkeys(map(ord, "\u00a0«»“”„‟‘’‚‹›¿¡…–—•·"), " ")
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _TABLE))) + "]")
_SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_SIGNED = re.compile(r"[^ ]*[0134578@$!|][^ ]*")
_EDGES = "$!|"
_SPACES = bytes(32 if c < 128 and not chr(c).isalnum() and chr(c) not in "@$!|" else c for c in range(256))


def _letters(m: re.Match) -> str:
    w = m.group().strip(_EDGES)
    return w.translate(_SIGNS) if any(c.isalpha() for c in w) else w


def fold(text: str) -> str:
    """Folded words, each after a space, and a closing space."""
    t = text.lower()
    if _ODD.search(t):
        t = t.translate(_TABLE).lower()
    t = t.encode("utf-8", "replace").translate(_SPACES).decode()
    if _SIGNED.search(t):
        t = _SIGNED.sub(_letters, t)
    return f" {' '.join(t.split())} "


@dataclass(frozen=True)
class Model:
    """Entries with weights (whole words end in a space, stems do not), exception phrases, and the three score weights."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -100.0
    by_sum: float = 0.0
    by_rate: float = 0.0

    def score(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        x = features(total, n_words)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.by_sum * x[:, 0] + self.by_rate * x[:, 1], -500, 500)))


def features(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(n_words, 1))], axis=1)


class Matcher:
    """The automaton of a model's lexicon and exception phrases."""

    def __init__(self, model: Model):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w, x in model.lexicon:
            for form in [w.rstrip() + e + " " for e in ENDINGS] if w.endswith(" ") else [w]:
                if f" {form}" not in self.auto:
                    self.auto.add_word(f" {form}", (x, len(form)))
        for p in model.exceptions:
            self.auto.add_word(f" {p} ", (None, len(p) + 1))
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()

    def total(self, text: str | None) -> tuple[float, int]:
        """(sum of weights of the matches outside exceptions, words)."""
        f = fold(text or "")
        n = f.count(" ") - 1 if len(f) > 2 else 0
        if self.empty:
            return 0.0, n
        return sum(weight for _, _, weight in self.hits(f)), n

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches outside exceptions, in order; a place counts once, for its longest match."""
        found: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (weight, size) in self.auto.iter(folded):
            if weight is None:
                safe.append((end - size, end))
            elif end > found.get(end - size, (-1, 0.0))[0]:
                found[end - size] = end, weight
        safe.sort()
        out, k, reach = [], 0, -1
        for start in sorted(found):
            while k < len(safe) and safe[k][0] <= start:
                reach = max(reach, safe[k][1])
                k += 1
            if found[start][0] > reach:
                out.append((start, *found[start]))
        return out


def held_out(doc_id=None):
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32((doc_id if doc_id is not None else F.col("doc_id")).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows outside the held-out fold, the same ones each time."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _counts(batches):
    """(beginning, previous word or null, rows): toxic rows by context, other rows by number."""
    for b in batches:
        contexts: set[tuple[str, int]] = set()
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = fold(text or "").split()
            mine = set()
            for prev, x in zip(["", *w], w, strict=False):
                starts = {x[:n] for n in range(SHORTEST, min(LONGEST, len(x)) + 1)} | ({f"{x} "} if len(x) > 2 else set())
                mine |= starts
                if toxic:
                    contexts.update((s, hash_word(prev)) for s in starts)
            seen[1 if toxic else 0].update(mine)
        rows = [(s, c, 0, 0) for s, c in contexts] + [(s, None, n, 0) for s, n in seen[1].items()] + [(s, None, 0, n) for s, n in seen[0].items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["start", "context", "toxic", "clean"])


def hash_word(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode())


def entries(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Lexicon out of telling beginnings: text -> (weight, toxic rows); whole words end in a space."""
    longer: dict[str, int] = {}
    for w, (_, rows) in found.items():
        for n in {len(w) - 1, min(len(w) - 1, LONGEST)}:
            longer[w[:n]] = max(longer.get(w[:n], 0), rows)
    out: dict[str, float] = {}
    for w in sorted(found, key=lambda w: (len(w), w)):
        weight, rows = found[w]
        if not any(w[:n] in out for n in range(1, len(w))) and longer.get(w, 0) < KEPT * rows:
            out[w] = weight
    return out


def _phrases(model: Model):
    """(phrase, toxic rows, clean rows) of two words, one of them matched."""

    def run(batch: pa.RecordBatch):
        m = Matcher(model)
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = fold(text or "")
            mine = set()
            for start, *_ in m.hits(f) if not m.empty else []:
                end = f.index(" ", start + 1)
                mine.add(f[f.rfind(" ", 0, start) + 1 : end] if start else "")
                mine.add(f[start + 1 : max(f.find(" ", end + 1), end)])
            for phrase in mine:
                if " " in phrase:
                    counts.setdefault(phrase, [0, 0])[not toxic] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["phrase", "toxic", "clean"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, rows)


def _fit(docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    sample = _sample(docs, labels, rows)
    totals = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    t, c = totals.get(True, 0), totals.get(False, 0)
    if not t or not c:
        return Model(())
    found = sample.transform(map_arrow, _counts, "start string, context long, toxic long, clean long").groupBy("start").agg(F.countDistinct("context").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    best = found.withColumn("odds", odds).where((F.col("contexts") >= CONTEXTS) & (F.col("odds") >= ODDS)).select("start", "odds", "toxic").collect()  # of the bounded sample
    lexicon = tuple(sorted(entries({r[0]: (float(r[1]), r[2]) for r in best}).items()))
    clean = map_batches(sample, _phrases(Model(lexicon)), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    learnt = [r[0] for r in clean.where((F.col("toxic") == 0) & (F.col("clean") >= CLEAN_ROWS)).select("phrase").collect()]
    exceptions = tuple(sorted({*EXCEPTIONS, *learnt}))
    model = Model(lexicon, exceptions)

    def figures(batch: pa.RecordBatch):
        m = Matcher(model)
        x = [m.total(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([n for _, n in x], pa.int64()), batch.column(1)], names=["total", "n", "toxic"])

    got = map_batches(sample, figures, "total double, n long, toxic int").toArrow().sort_by([("total", "ascending"), ("n", "ascending"), ("toxic", "ascending")])
    bias, a, b = logistic(features(got["total"].to_numpy(), got["n"].to_numpy()), (got["toxic"].to_numpy() > 0).astype(float))
    return Model(lexicon, exceptions, bias, a, b)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Ridge-penalised logistic regression by Newton's method: intercept and weights."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


_matchers: dict[Model, Matcher] = {}


def _matcher(model: Model) -> Matcher:
    if model not in _matchers:
        _matchers.clear()
        _matchers[model] = Matcher(model)
    return _matchers[model]


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    m = _matcher(model)
    x = [m.total(v.as_py()) for v in column]
    s = model.score(np.array([a for a, _ in x], float), np.array([n for _, n in x], float))
    assert math.isfinite(float(s.sum()))
    return s


def toxicity_report(docs: DataFrame, model: Model) -> DataFrame:
    def run(batch: pa.RecordBatch):
        s = _scores(batch.column(2), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(_scores(batch.column(at), model) < threshold))

    return map_batches(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_report(docs, fit(docs, table(spark, sf_dir, "labels")))
