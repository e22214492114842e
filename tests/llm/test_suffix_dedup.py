import hashlib

import numpy as np
import pyarrow as pa

import filigree.llm.suffix_dedup as m


def brute(raws):
    seen, dup = {}, [np.zeros(len(b) + 1, bool) for b in raws]
    for i, b in enumerate(raws):
        for s in range(len(b) - m.LENGTH + 1):
            w = b[s : s + m.LENGTH]
            if w in seen:
                j, q = seen[w]
                dup[j][q : q + m.LENGTH] = True
                dup[i][s : s + m.LENGTH] = True
            else:
                seen[w] = (i, s)
    out = []
    for b, d in zip(raws, dup, strict=True):
        d = d[:-1]
        runs = int((d & ~np.concatenate([[False], d[:-1]])).sum()) if len(d) else 0
        out.append((len(b), int(d.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~d].tobytes()).hexdigest()))
    return out


def test_against_brute_force(docs, rows):
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], brute([(r[1] or "").encode() for r in rows]), strict=True))
    for scan, cell in ((64, 200_000), (2, 200_000), (2, 3)):
        old = m.SCAN, m.CELL
        m.SCAN, m.CELL = scan, cell
        try:
            got = sorted((r.doc_id if r.doc_id is not None else -1, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in m.repeat_report(docs).collect())
        finally:
            m.SCAN, m.CELL = old
        assert got == want


def test_empty(none):
    assert m.repeat_report(none).count() == 0


def test_pieces_of_long_texts_cover_all_windows(monkeypatch):
    from filigree.llm.words import Texts

    monkeypatch.setattr(m, "PIECE", 700)
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    d, p, a, b, g, f = m.anchors(Texts(data, np.array([0, 5000])))
    assert sorted(x for lo, hi in zip(a, b, strict=True) for x in range(lo, hi + 1)) == list(range(5000 - m.LENGTH + 1))
    assert all(lo <= q <= lo + m.LENGTH - m.GRAM for q, lo in zip(p, b, strict=True))


def test_family_levels_are_geometric():
    rng = np.random.default_rng(0)
    f = m.Family()
    for i in range(13):
        right = rng.integers(0, 255, (4, m.LENGTH)).astype(np.uint8)
        left = rng.integers(0, 255, (4, m.LENGTH - m.GRAM)).astype(np.uint8)
        f.add(right, left, np.zeros(4, int), np.full(4, 9), np.arange(4) + 4 * i)
    assert [len(x[0]) for x in f.levels] == [32, 16, 4]
    assert not f.marks
    f.add(right[:1], left[:1], np.zeros(1, int), np.full(1, 9), np.array([99]))
    assert {int(r) for mark in f.marks for r in mark[0]} == {48, 99}


def test_slices_of_arrow_arrays():
    from filigree.llm.words import text_slices

    a = pa.array(["ab", None, "c" * 300]).slice(1)
    assert [t.data.tobytes() for _, _, t in text_slices(a)] == [b"c" * 300]
