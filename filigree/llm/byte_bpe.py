"""Operator 12: byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is the encoding of a byte string exactly when its
first token encodes itself and every two neighbours encode themselves together;
so each prefix of the string has one last token, found from the encodings of
shorter prefixes. The transducer reads bytes. Its state is what may still matter:
the pending tokens before each open token, that is before each place from which a
token may reach beyond the bytes read so far, and the last token emitted where an
open one stands right after it. On a byte, open tokens move in the trie of the
vocabulary; the one that ends here and suits its predecessor completes the
prefix. Tokens on which all open ones agree are emitted, after a lookahead bounded
by the vocabulary, not by the text.
States are determinised lazily: a state and its transitions are built when first
met, and all are forgotten when ``STATES`` is reached. A short match, whose tokens
need not leave before its end, goes through the same machine before it is
determinised: failure links of the trie lead from the longest open token to the
shorter ones, and the last token of each prefix is kept until the match ends. So an
invented word builds no state that only it will use.

Each match of the pattern is encoded by itself; a match that is a token is that
token. Long texts are read in segments of ``SEGMENT`` characters, cut between a
letter and a space before a letter, where every match ends. Matches of up to
``MEMO_CHARS`` characters are remembered (``MEMO`` of them).

Decoding. Ids become bytes; an incremental UTF-8 machine, whose step over a whole
token is remembered, releases bytes up to the last character boundary, so that a
reader of the stream never sees half a character. Malformed bytes pass unchanged.

Defined results: null text counts as empty (no tokens, digests of nothing);
repeated rows give repeated results; an empty table gives no rows; other columns
are ignored; a very long match without a cut is encoded whole, in linear time. An
id outside of the vocabulary fails the task.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filigree.llm.frames import map_batches, table

#: States held, matches remembered, their length, and characters of a segment.
STATES, MEMO, MEMO_CHARS, SEGMENT = 1 << 17, 1 << 19, 48, 1 << 10
#: Pairs of neighbours and links over a failure that are remembered.
PAIRS, LINKS = 1 << 20, 1 << 19


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merges(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, list[bytes]]]:
    """(rank, parts after it) of each merge of plain byte-pair encoding, the definition that the transducer compiles."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if rank == _NEVER:
            return
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        yield rank, parts


_NEVER = 1 << 60


class Transducer:
    """Bytes to tokens; ``feed`` appends tokens as soon as they are certain."""

    START = 0

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], bytearray(1)
        for t, i in ranks.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                self.inner[node] = 1
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(0)
            self.token[node] = i
        self.edges: dict[int, tuple[list[int], list[bytes], list[bytes]] | None] = {}
        self.suits: dict[int, bool] = {}
        self._link()
        self._forget()

    def _link(self) -> None:
        """Failure links (node of the longest proper suffix in the trie) and the tokens that end at each node, longest first:
        token, its length, and which tokens before it are known to suit it."""
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        self.fail, self.ends = [0] * len(self.token), [()] * len(self.token)
        level, depth = [0], 0
        while level:
            depth, deeper = depth + 1, []
            for parent in level:
                for byte, node in below.get(parent, ()):
                    if parent:
                        at = self.fail[parent]
                        while at and at << 8 | byte not in self.child:
                            at = self.fail[at]
                        self.fail[node] = self.child.get(at << 8 | byte, 0)
                    shorter = self.ends[self.fail[node]]
                    self.ends[node] = ((self.token[node], depth, {}), *shorter) if self.token[node] >= 0 else shorter
                    deeper.append(node)
            level = deeper
        self.moves, self.pairs = dict(self.child), 0

    def _move(self, node: int, byte: int) -> int:
        """The node after a byte that the node has no child for."""
        if len(self.moves) >= len(self.child) + LINKS:
            self.moves.clear()
            self.moves.update(self.child)
        at = node
        while at and at << 8 | byte not in self.child:
            at = self.fail[at]
        known = self.moves[node << 8 | byte] = self.child.get(at << 8 | byte, 0)
        return known

    def _fits(self, before: int, t: int, fits: dict[int, bool]) -> bool:
        if self.pairs >= PAIRS:
            for known in self.ends:
                for _, _, held in known[:1]:
                    held.clear()
            self.pairs = 0
        self.pairs += 1
        found = fits[before] = self._meets(before, t)
        return found

    def _forget(self) -> None:
        first = (-1, ((0, ()),))
        self.states, self.number, self.step = [first], {first: self.START}, {}
        self.suits.clear()

    def _merged(self, t: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """How a token's bytes merge: rank of each merge, first and last part before each and at the end; None if they end as other tokens."""
        if t not in self.edges:
            data = self.bytes_of[t]
            ranks, first, last, parts = [], [data[:1]], [data[-1:]], [data] if len(data) == 1 else []
            for rank, parts in merges(data, self.ranks):
                ranks.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            self.edges[t] = ([*ranks, _NEVER], first, last) if len(parts) == 1 else None
        return self.edges[t]

    def _meets(self, before: int, t: int) -> bool:
        """Whether ``t`` may stand after ``before`` (-1: at the start): no merge reaches across while both grow, lowest rank first."""
        right = self._merged(t)
        if right is None or before < 0:
            return right is not None
        i, j = 0, 0
        (l_ranks, _, l_last), (r_ranks, r_first, _) = self._merged(before), right
        while True:
            across = self.ranks.get(l_last[i] + r_first[j], _NEVER)
            # Of equal ranks the leftmost pair merges first.
            if across < l_ranks[i] and across <= r_ranks[j]:
                return False
            if l_ranks[i] <= r_ranks[j]:
                if l_ranks[i] == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _follows(self, before: int, t: int) -> bool:
        """``_meets``, remembered as long as the states are."""
        key = before << 32 | t
        known = self.suits.get(key)
        if known is None:
            known = self.suits[key] = self._meets(before, t)
        return known

    def _build(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """The transition of a state that was not met with this byte before: (tokens emitted, next state)."""
        last, opened = self.states[state]
        out, whole = [], None
        for node, pending in opened:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            t = self.token[node]
            if whole is None and t >= 0 and self._follows(pending[-1] if pending else last, t):
                whole = (*pending, t)
            if self.inner[node]:
                out.append((node, pending))
        if whole is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        out.append((0, whole))
        shared = 0
        if all(p for _, p in out):
            low, high = min(p for _, p in out), max(p for _, p in out)
            while shared < len(low) and low[shared] == high[shared]:
                shared += 1
            out = [(node, p[shared:]) for node, p in out] if shared else out
        emitted = whole[:shared]
        # What was emitted matters only to an open token that stands right after it.
        after = ((emitted[-1] if emitted else last) if not all(p for _, p in out) else -1, tuple(out))
        number = self.number.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.step[state << 8 | byte] = emitted, number
        return emitted, number

    def feed(self, state: int, data: bytes, out: list[int]) -> int:
        """Reads bytes, appends the tokens that are certain, returns the next state."""
        step = self.step
        for byte in data:
            known = step.get(state << 8 | byte)
            if known is None:
                if len(self.states) >= self.limit:
                    here = self.states[state]
                    self._forget()
                    step = self.step
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                known = self._build(state, byte)
            emitted, state = known
            if emitted:
                out += emitted
        return state

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens pending at the end of the bytes."""
        return self.states[state][1][-1][1]

    def run(self, data: bytes) -> list[int]:
        out: list[int] = []
        out += self.end(self.feed(self.START, data, out))
        return out

    def short(self, data: bytes) -> list[int]:
        """``run`` for few bytes, by failure links: the last token of each prefix is held to the end."""
        moves, ends, node, last = self.moves, self.ends, 0, [-1]
        for byte in data:
            try:
                node = moves[node << 8 | byte]
            except KeyError:
                node = self._move(node, byte)
            for t, size, fits in ends[node]:
                before = last[-size]  # the last token of what precedes this one
                try:
                    known = fits[before]
                except KeyError:
                    known = self._fits(before, t, fits)
                if known:
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]


class Memo(dict):
    """Ids of matches; those of one not met before are asked for."""

    def __init__(self, fresh: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.fresh = fresh

    def __missing__(self, match: str) -> tuple[int, ...]:
        return self.fresh(match)


class Encoder:
    """Texts to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # White space is Unicode's property here and in the merges' own library.
        unicode_space = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.matches, self.cut = regex.compile(unicode_space).findall, regex.compile(r"\p{L}(?= \p{L})").search
        # The same pattern over ASCII, for the faster standard library, where that can express it.
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii_matches = self.matches if r"\p" in narrow else re.compile(narrow, re.ASCII).findall
        self.transducer = Transducer(ranks)
        self.memo = Memo(self._fresh)

    def segments(self, text: str, size: int = SEGMENT) -> Iterator[str]:
        at = 0
        while len(text) - at > size and (found := self.cut(text, at + size)):
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def _fresh(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        whole = self.transducer.ranks.get(data)
        short = len(match) <= MEMO_CHARS
        ids = (whole,) if whole is not None else tuple(self.transducer.short(data) if short else self.transducer.run(data))
        if short:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[match] = ids
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, segment by segment."""
        get = self.memo.__getitem__
        for segment in self.segments(text):
            found = (self.ascii_matches if segment.isascii() else self.matches)(segment)
            yield list(itertools.chain.from_iterable(map(get, found)))


def _after(state: int, byte: int) -> int:
    """UTF-8 machine: 0 at a boundary, -1 malformed; else continuation bytes to come (1 to 3), plus 4 times the lead byte
    where the next one is restricted."""
    lead, left = divmod(state, 4)
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte < 0xE0:
            return 1
        if 0xE0 <= byte < 0xF0:
            return 2 + 4 * byte * (byte in (0xE0, 0xED))
        return 3 + 4 * byte * (byte in (0xF0, 0xF4)) if 0xF0 <= byte < 0xF5 else -1
    low, high = {0xE0: (0xA0, 0xC0), 0xED: (0x80, 0xA0), 0xF0: (0x90, 0xC0), 0xF4: (0x80, 0x90)}.get(lead, (0x80, 0xC0))
    return left - 1 if low <= byte < high else -1


class StreamDecoder:
    """Ids to bytes, released at character boundaries."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        #: Tokens that start and end at a boundary.
        self.plain = {i for i in bytes_of if self._move(0, i) == (0, 0)}
        self.moves.clear()
        self.state, self.held = 0, b""

    def _move(self, state: int, i: int) -> tuple[int, int]:
        """(state after the token, bytes at the end of the stream so far that belong to an unfinished character)."""
        known = self.moves.get((state, i))
        if known is None:
            now = state
            tail = -1  # all that is held and the whole token
            for at, byte in enumerate(self.bytes_of[i]):
                before, now = now, _after(now, byte)
                if now < 0:  # what came before is malformed and ends here; the byte starts anew
                    now = _after(0, byte) if before else -1
                    tail = len(self.bytes_of[i]) - at - (now <= 0)
                    now = max(now, 0)
                elif now == 0:
                    tail = len(self.bytes_of[i]) - at - 1
                elif before == 0:
                    tail = len(self.bytes_of[i]) - at
            known = self.moves[state, i] = now, tail
        return known

    def feed(self, ids: Iterable[int]) -> bytes:
        ids = list(ids)
        if not self.state and self.plain.issuperset(ids):
            return b"".join(map(self.bytes_of.__getitem__, ids))
        ready, held = [], self.held
        for i in ids:
            self.state, tail = self._move(self.state, i)
            held += self.bytes_of[i]
            if 0 <= tail < len(held):
                ready.append(held[: len(held) - tail])
                held = held[len(held) - tail :]
        self.held = held
        return b"".join(ready)

    def end(self) -> bytes:
        rest, self.state, self.held = self.held, 0, b""
        return rest


_cached: dict[tuple[str, str], Encoder] = {}


def encoder(lines: bytes, pattern: str) -> Encoder:
    """This worker's encoder."""
    key = hashlib.sha256(lines).hexdigest(), pattern
    if key not in _cached:
        _cached.clear()
        _cached[key] = Encoder(parse_ranks(lines), pattern)
    return _cached[key]


def _read(ranks_file: str) -> bytes:
    """The rank file is read on the driver and goes to the executors with the function."""
    with open(ranks_file, "rb") as f:
        return f.read()


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows of about ``size`` characters."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and held < size:
            held += len(texts[j].as_py() or "")
            j += 1
        yield i, j
        i = j


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>)."""
    lines = _read(ranks_file)

    def run(batch: pa.RecordBatch):
        e = encoder(lines, pattern)
        for i, j in _groups(batch.column(1)):
            ids = [list(itertools.chain.from_iterable(e.encode(t.as_py() or ""))) for t in batch.column(1).slice(i, j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); malformed bytes become U+FFFD, null ids no text."""
    lines = _read(ranks_file)

    def run(batch: pa.RecordBatch):
        d = StreamDecoder({i: t for t, i in parse_ranks(lines).items()})
        for at in range(0, batch.num_rows, 256):
            texts = [None if (ids := x.as_py()) is None else (d.feed(ids) + d.end()).decode("utf-8", "replace") for x in batch.column(1).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes its ids, both as streams: (doc_id, n_tokens, digests of ids and of decoded bytes)."""
    lines = _read(ranks_file)

    def run(batch: pa.RecordBatch):
        e = encoder(lines, pattern)
        if not hasattr(e, "decoder"):
            e.decoder = StreamDecoder(e.transducer.bytes_of)
            e.decimal = {i: str(i) for i in e.transducer.bytes_of}
        decoder, decimal = e.decoder, e.decimal.__getitem__
        for i, j in _groups(batch.column(1)):
            out: dict[str, list] = {"n": [], "ids": [], "decoded": []}
            for t in batch.column(1).slice(i, j - i):
                n, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
                for ids in e.encode(t.as_py() or ""):
                    if n and ids:
                        ids_sha.update(b",")
                    n += len(ids)
                    ids_sha.update(",".join(map(decimal, ids)).encode())
                    decoded_sha.update(decoder.feed(ids))
                decoded_sha.update(decoder.end())
                for k, v in zip(out, (n, ids_sha.hexdigest(), decoded_sha.hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
