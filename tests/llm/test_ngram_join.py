import itertools
import random
from collections import Counter, defaultdict

import numpy as np

import filigree.llm.ngram_join as m
from filigree.llm.components import components
from filigree.llm.keep_one import keep_one
from tests.llm.conftest import edited, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inv, common = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            inv[g].append(k)
    for ks in inv.values():
        common.update(itertools.combinations(ks, 2))
    for (a, b), c in common.items():
        x, y = rows[a][0], rows[b][0]
        if x is not None and y is not None and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for (i, *_), s in zip(rows, sets, strict=True)]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_against_brute_force(docs, rows, monkeypatch):
    want = sorted(map(key, brute(rows)))
    for setting in ({}, {"FIRST": 0, "LAST": 1, "CELL": 3, "LOCAL_COUNT": 1, "TOTAL_COUNT": 2, "SHARE": 2}, {"FIRST": 0, "LAST": 0, "CELL": 2, "SHARE": 1}):
        with monkeypatch.context() as change:
            for name, value in setting.items():
                change.setattr(m, name, value)
            assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in m.link(docs).collect()) == want


def test_many_near_copies_and_long_words(spark):
    base = prose(1, 120)
    rows = [(i, edited(base, i, 1 + i % 9)) for i in range(150)] + [(900, base)]
    a, b = "v" * 4096, "w" * 4096
    rows += [(200, f"{a}{b} x y z t u"), (201, f"{b}{a} x y z t u"), (202, " ".join([a + b] * 6)), (203, " ".join([b + a] * 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in m.link(df).collect()) == sorted(brute(rows))


def test_signatures_bound_the_difference():
    r = random.Random(3)
    for size in (1, 5, 200, 3000, 50_000):
        x = {r.getrandbits(64) for _ in range(size)}
        y = set(list(x)[: size * 9 // 10]) | {r.getrandbits(64) for _ in range(size // 5)}
        values = [np.sort(np.array(list(s), np.uint64)) for s in (x, y)]
        bits, off = m._parity(np.concatenate(values), np.cumsum([0, *map(len, values)]))
        short = m._folded(bits, off)
        assert sum(int(np.bitwise_count(f[0] ^ f[1])) for f in short) <= len(x ^ y)
        a, b = bits[off[0] : off[1]], bits[off[1] : off[2]]
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        assert int(np.bitwise_count(a ^ b).sum()) <= len(x ^ y)


def test_empty(none):
    assert m.link(none).count() == 0 and keep_one(none).count() == 0


def test_keep_one(docs, rows):
    comp = {i: c for i, _, c in brute(rows) if i is not None}
    out = keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    assert got == sorted([i for i, c in comp.items() if i == c] + [-1, -1])


def test_components(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)] + [(200, 200 + i) for i in range(1, 30)]
    for edges in (300_000, 7):
        monkeypatch.setattr("filigree.llm.components.TASK_EDGES", edges)
        got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(12)).collect()}
        assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {200 + i: 200 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
