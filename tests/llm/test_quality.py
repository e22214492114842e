import re
from collections import Counter

import pyarrow as pa

from filigree.llm.quality import RULES, Slice, cascade, measure, order_rules, quality_report, sampled_order
from filigree.llm.words import text_slices


def figures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = [0] * len(w)
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(mark)


EXTRA = ["a\nb\n\na\n \nb\nb", "x ## y\n" * 40, "A B C " * 60, "same line here\n" * 3 + "other", "w %%% é|é " * 30, "a" * 4096 + "b" * 4096 + "\n" + "b" * 4096 + "a" * 4096, *["\n".join([x + y, y + x, x + y]) for x, y in (("q" * 4096, "r" * 1500), ("q" * 8192, "r" * 12000), ("q" * (1 << 20), "r" * 4096))]]


def test_figures_against_brute_force(spark, docs, rows):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    out = quality_report(docs.select("doc_id", "text").union(extra)).collect()
    want = sorted((r[0] or -1, figures(r[1] or "")) for r in [*rows, *[(1000 + i, t) for i, t in enumerate(EXTRA)]])
    assert sorted((r.doc_id or -1, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert kept[5] and kept[10] and not kept[1001] and not kept[1002] and not kept[16]


def test_cascade_does_not_depend_on_the_order(rows):
    t = next(text_slices(pa.array([r[1] for r in rows] + EXTRA)))[2]
    want = ~sum((RULES[k](Slice(t)) for k in RULES), start=RULES["symbols"](Slice(t)))
    for order in (list(RULES), list(RULES)[::-1], order_rules(measure(t))):
        assert sorted(order) == sorted(RULES) and (cascade(t, order) == want).all()


def test_empty(none):
    assert quality_report(none).count() == 0


def test_sampled_order_names_every_rule(docs, none):
    assert sorted(sampled_order(docs)) == sorted(sampled_order(none)) == sorted(RULES)
    assert order_rules({"a": (0, 1.0), "b": (5, 1.0), "c": (5, 0.1)}) == ["c", "b", "a"]
