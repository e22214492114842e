import math
import re
from collections import defaultdict

from filigree.llm.mixing import mix, mix_report, targets


def level(sizes, weights, cap=3):
    """Targets by repeated capping and resharing."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        w = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / w for i in free} if free and w else {}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_targets(spark):
    for sizes in ([10, 1000, 5, 300, 70], [0, 10], [7], [1, 1, 100000]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in targets(df).orderBy("source").collect()]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, level(sizes, [i % 3 + 1 for i in range(len(sizes))]), strict=True))


def test_rows(docs, rows, none):
    out = mix_report(docs).collect()
    assert len(out) == len(rows) and sorted((r.doc_id or -1, r.size) for r in out) == sorted((r[0] or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    assert sorted(map(str, out)) == sorted(map(str, mix_report(docs.repartition(5)).collect()))
    by = defaultdict(lambda: [0, 0, 0])
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        x = by[(r.source_size, r.target)]
        x[0] += r.taken
        x[1] = max(x[1], r.size)
        x[2] += r.size
    assert math.isclose(sum(t for _, t in by), sum(s for s, _ in by))
    for (size, target), (taken, most, all_) in by.items():
        assert all_ == size and abs(taken - target) <= most + 1e-6
    assert mix_report(none).count() == 0


def key_order(out):
    """By hand: in each source, by ascending key, the prefix nearest to what whole epochs leave."""
    by = defaultdict(list)
    for r in out:
        by[(r.source_size, r.target)].append((r.key, r.doc_id, r.size, r.copies))
    for (size, target), rows in by.items():
        epochs = min(3, int(target / size + 1e-9)) if size else 0
        extra = sorted({(k, i, sum(x[2] for x in rows if x[:2] == (k, i))) for k, i, n, _ in rows if n})
        prefix, sums = 0, [0]
        for *_, n in extra:
            sums.append(prefix := prefix + n)
        best = min(abs(s - (target - epochs * size)) for s in sums)
        taken = {(k, i) for k, i, n, c in rows if n and c == epochs + 1}
        assert taken == {e[:2] for e in extra[: len(taken)]}
        assert math.isclose(abs(sums[len(taken)] - (target - epochs * size)), best, abs_tol=1e-6)


def test_documents_are_taken_in_key_order(spark, docs, monkeypatch):
    odd = [(i, ("a$ " if i % 3 else "wo rd ") * (1 + i * 7 % 40), "abcd"[i * i % 4 if i % 5 else 0]) for i in range(600)]
    df = spark.createDataFrame(odd, "doc_id long, text string, source string").repartition(4)
    for size, split in ((2000, 64), (20, 4), (1, 2)):
        monkeypatch.setattr("filigree.llm.mixing.RANGE_DOCS", size)
        monkeypatch.setattr("filigree.llm.mixing.SPLIT", split)
        key_order(mix_report(df).collect())
        assert len({tuple(r) for r in mix_report(df).collect()} ^ {tuple(r) for r in mix_report(df.repartition(2)).collect()}) == 0
    key_order(mix_report(docs.where("doc_id IS NOT NULL")).collect())


def test_equal_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, f"t{i} x", "a") for i in range(100)] + [(7, "same text", "a")] * 50 + [(i, "u v", "b") for i in range(300)], "doc_id long, text string, source string")
    out = mix_report(df).collect()
    assert len({r.key for r in out if r.doc_id is None}) == 100 and len({r.copies for r in out if r.doc_id == 7}) == 1


def test_mix_repeats_rows(docs):
    want = {(r.doc_id, r.size, r.copies) for r in mix_report(docs).collect()}
    got = mix(docs)
    assert got.columns == docs.columns and got.count() == sum(r.copies for r in mix_report(docs).collect())
    assert got.where("doc_id = 3").count() == next(c for i, _, c in want if i == 3)
    assert {r["size"] for r in got.select("size").distinct().collect()} == {"mine"}
