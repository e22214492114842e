import hashlib
import itertools
import random

import public_tokenizers
import pytest
import tiktoken

from filigree.llm.byte_bpe import SEGMENT, Encoder, StreamDecoder, Transducer, decode_ids, encode_texts, parse_ranks, round_trip_digests

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return parse_ranks(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return Encoder(ranks, PATTERN)


def ids(encoder, text):
    return list(itertools.chain.from_iterable(encoder.encode(text)))


def texts():
    r = random.Random(5)
    out = ["", " ", "x" * 5000, "aaaa" * 999 + "b", "it's we'll 'S d'accord 12 345 ½ Ⅷ", "a<|endoftext|>b", " \t\n\x0b\f\r \n\n x", "a\x1cb \x1f\x85 \xa0 ﻿​ z", "日本語のテキスト。ここに", "é́ß naïve Ünïcode", "👩‍👩‍👧 🇩🇪 emoji", "\x00\x01 nul", "#" * 300 + " " * 300 + "1" * 300]
    out += ["".join(r.choices("abcdeé 1.\n'日", k=r.randrange(60))) for _ in range(400)]
    out += ["".join(r.choices(["th", "e", "in", "g ", "ation", " un", "à", "'s", "0"], k=400)) for _ in range(20)]
    return out


def test_encoding_against_the_library(encoder, library):
    for t in texts():
        assert ids(encoder, t) == library.encode_ordinary(t), t[:80]


def test_every_code_point_is_split_as_the_library_splits(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 64):
        for form in ("a{0}b {0} ", "{0}{0}1{0}"):
            t = "".join(form.format(c) for c in points[lo : lo + 64])
            assert ids(encoder, t) == library.encode_ordinary(t), hex(ord(points[lo]))


def test_long_texts_and_long_matches(encoder, library):
    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(1, 12))) for _ in range(30_000)]
    for t in (" ".join(words), "\n".join(words), "".join(words), "é ".join(words)):
        assert len(t) > 50 * SEGMENT and ids(encoder, t) == library.encode_ordinary(t)


def test_transducer_on_random_vocabularies():
    """Against merging by hand, with states forgotten all the time."""
    r = random.Random(7)
    for _ in range(60):
        tokens = [bytes([c]) for c in b"abc"]
        while len(tokens) < 24:
            t = r.choice(tokens) + r.choice(tokens)
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        ranks = {t: i for i, t in enumerate(tokens)}
        if r.random() < 0.3:  # ranks out of order, so that some tokens do not encode themselves
            order = list(range(3, len(tokens)))
            r.shuffle(order)
            ranks = {t: i if i < 3 else order[i - 3] for t, i in ranks.items()}
        small, big = Transducer(ranks, limit=4), Transducer(ranks)
        for _ in range(60):
            data = bytes(r.choices(b"abc", k=r.randrange(40)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            want = [ranks[p] for p in parts]
            assert small.run(data) == big.run(data) == want


def test_short_matches_build_no_states(ranks, library):
    """Invented words go by failure links, with the tokens that the determinised machine finds."""
    e, r = Encoder(ranks, PATTERN), random.Random(11)
    words = ["".join(r.choices("etaoinshrdlué日", k=r.randrange(1, 16))) for _ in range(4000)]
    assert ids(e, " ".join(words)) == library.encode_ordinary(" ".join(words))
    assert len(e.transducer.states) == 1
    assert all(e.transducer.short(w.encode()) == e.transducer.run(w.encode()) for w in words)
    for _ in range(60):
        tokens = [bytes([c]) for c in b"abc"]
        while len(tokens) < 24:
            t = r.choice(tokens) + r.choice(tokens)
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        order = list(range(3, len(tokens)))
        if r.random() < 0.3:
            r.shuffle(order)
        small = Transducer({t: i if i < 3 else order[i - 3] for i, t in enumerate(tokens)})
        for _ in range(60):
            data = bytes(r.choices(b"abc", k=r.randrange(40)))
            assert small.short(data) == small.run(data)


def test_lookahead_is_bounded(ranks):
    t = Transducer(ranks)
    data, out, state = ("the quick brown été " * 400).encode(), [], Transducer.START
    for at in range(0, len(data), 7):
        state = t.feed(state, data[at : at + 7], out)
        done = sum(len(t.bytes_of[i]) for i in out)
        assert min(len(data), at + 7) - done <= 2 * max(map(len, ranks))


def test_stream_decoder(ranks, library):
    d = StreamDecoder({i: t for t, i in ranks.items()})
    r = random.Random(8)
    for t in texts():
        got = [d.feed(library.encode_ordinary(t)[k : k + 1]) for k in range(len(library.encode_ordinary(t)))]
        assert d.end() == b"" and b"".join(got) == t.encode() and "".join(p.decode() for p in got) == t
    odd = [ranks[bytes([b])] for b in range(0x7E, 0x100)]
    for _ in range(3000):
        some = r.choices(odd, k=r.randrange(1, 9))
        raw = b"".join(d.bytes_of[i] for i in some)
        got = [d.feed([i]) for i in some] + [d.end()]
        assert b"".join(got) == raw and "".join(p.decode("utf-8", "replace") for p in got) == raw.decode("utf-8", "replace")


def test_rows(docs, rows, none, library):
    out = round_trip_digests(docs, PATH, PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        e = library.encode_ordinary(r[1] or "")
        want.append((r[0] or -1, len(e), sha(",".join(map(str, e)).encode()), sha((r[1] or "").encode())))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    encoded = encode_texts(docs, PATH, PATTERN)
    assert sorted((r.doc_id or -1, r.text) for r in decode_ids(encoded, PATH).collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert round_trip_digests(none, PATH, PATTERN).count() == 0 and encode_texts(none, PATH, PATTERN).count() == 0
