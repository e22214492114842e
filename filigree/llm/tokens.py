"""Operator 7: token counts, with overlap resynchronisation for huge documents.

A document longer than ``CHUNK`` characters is encoded in overlapping chunks
with offsets. Neighbouring encodings are spliced at a boundary that is proven
stable: the character before it is ASCII white space, where the tokenizer's
pre-tokenizer always splits and no added token reaches across, both encodings
have a token that starts there, and they agree (ids and offsets) on all tokens
from there to the overlap's last white space. Where no such boundary exists the
overlap is doubled and encoded again, up to the rest of the document.

Other documents are encoded word by word through a bounded memo: for the same
reason a text's tokens are those of its white-space-separated words, one after
another.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated results; an empty table gives no rows; other columns are ignored; a text
of any length without white space is encoded whole, since nothing else is proven
stable in it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filigree.llm.frames import map_batches, table

#: Characters of a chunk and of the first overlap, words in a worker's memo.
CHUNK, OVERLAP, MEMO = 1 << 16, 1 << 10, 1 << 19
LIMIT = 2048
_WHITE = " \t\n\x0b\f\r"

_cached: dict[str, TokenCounter] = {}


class TokenCounter:
    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[bytes, int] = {}
        self.widened = 0

    def _encode(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens of text[a:b], offsets in the whole text."""
        e = self.tok.encode(text[a:b], add_special_tokens=False)
        return [(x + a, y + a, i) for (x, y), i in zip(e.offsets, e.ids, strict=True)]

    def _boundary(self, text: str, left: list, right: list, lo: int, hi: int) -> int | None:
        """A stable common boundary in (lo, hi) of two encodings, the first there is."""
        last = max(text.rfind(c, lo, hi) for c in _WHITE)
        if last < 0:
            return None
        l_in = [t for t in left if lo < t[0] and t[1] <= last]
        r_in = [t for t in right if lo < t[0] and t[1] <= last]
        starts = {t[0] for t in r_in}
        for k, t in enumerate(l_in):
            if t[0] in starts and text[t[0] - 1] in _WHITE:
                return t[0] if l_in[k:] == [x for x in r_in if x[0] >= t[0]] else None
        return None

    def count_chunked(self, text: str) -> int:
        n, total, a, begin = len(text), 0, 0, 0
        b = min(n, self.chunk)
        left = self._encode(text, a, b)
        while b < n:
            overlap = self.overlap
            while True:
                c = max(begin, b - overlap)
                d = min(n, c + self.chunk + overlap)
                right = self._encode(text, c, d)
                p = self._boundary(text, left, right, c, b)
                if p is not None:
                    total += sum(begin <= t[0] < p for t in left)
                    begin, left, b = p, right, d
                    break
                self.widened += 1
                if c == begin:
                    # Nothing stable since the last splice: the chunk itself grows.
                    b = min(n, b + max(self.chunk, b - begin))
                    left = self._encode(text, begin, b)
                    if b == n:
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
        return total + sum(t[0] >= begin for t in left)

    def count_words(self, raws: list[bytes]) -> list[int]:
        split = [r.split() for r in raws]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = list({w for ws in split for w in ws if w not in memo})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                memo[w] = len(e)
        return [sum(map(memo.__getitem__, ws)) for ws in split]


def counter(spec: str) -> TokenCounter:
    """This worker's counter."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if spec not in _cached:
        _cached.clear()
        _cached[spec] = TokenCounter(spec)
    return _cached[spec]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """The vocabulary file is read on the driver and goes to the executors with the function."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()

    def run(batch: pa.RecordBatch):
        c = counter(spec)
        ids, texts = batch.column(0), batch.column(1)
        i = 0
        while i < len(texts):
            held, size, j = [], 0, i
            while j < len(texts) and size < 1 << 20:
                held.append(texts[j].as_py() or "")
                size += len(held[-1])
                j += 1
            raws = [t.encode() for t in held]
            small = [k for k, t in enumerate(held) if len(t) <= c.chunk]
            n = dict(zip(small, c.count_words([raws[k] for k in small]), strict=True))
            n |= {k: c.count_chunked(t) for k, t in enumerate(held) if k not in n}
            counts = [n[k] for k in range(len(held))]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(r) for r in raws], pa.int64()), pa.array(counts, pa.int64()), pa.array([x > limit for x in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
            i = j

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
