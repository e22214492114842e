import itertools
import random
import re

from pyspark.sql import functions as F

from filigree.llm.filter_audit import filter_audit, judged, trie_edges

NAMES = "ABCDE"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, firsts):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * (doc_id is not None and firsts.get(text) is not None and firsts[text] < doc_id)


def brute(rows, labels):
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    docs = [(lang or "", set(fails(t or "", i, firsts)), i in good, i in toxic) for i, t, lang, *_ in rows]
    out = []
    for part in {d[0] for d in docs}:
        mine, lines = [d for d in docs if d[0] == part], []
        for order in itertools.permutations(NAMES):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                lines.append([part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        total = {f: sum(x[4] for x in lines if x[-1] == f) for f in NAMES}
        out += [tuple([*x[:-1], total[x[-1]]]) for x in lines]
    return sorted(out)


def run(docs, labels):
    return sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit(judged(docs, labels), NAMES).collect())


def cases(rows):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    extra = [(2000 + k, " ".join(r.choices(words[: r.choice([40, 300])], k=r.choice([60, 130]))) + r.choice(["", " # ", " A" * 70]), r.choice(["en", "de", None, ""]), "s", 1) for k in range(60)]
    extra += [(3000 + k, extra[0][1], "fr", "s", 1) for k in range(20)] + [(1999, extra[1][1], "de", "s", 1), extra[1], extra[1], (None, extra[0][1], "en", "s", 1)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 2040)] + [(2001, 1, 0), (2001, 0, 1), (None, 1, 1), (3005, 1, 1)]
    return [*rows, *extra], labels


def test_against_brute_force(spark, rows):
    data, labels = cases(rows)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(data, labels)
    clash = docs.withColumn("part", F.lit("x")).withColumn("A", F.lit(1)).withColumn("digest", F.lit("y")).withColumn("good", F.lit(3))
    assert run(clash, marks) == want
    assert {x[0] for x in want} == {"", "de", "en", "fr"} and len(want) == 4 * 600


def test_edges_share_unordered_states(spark):
    rows = spark.createDataFrame([("p", True, False, True, True, False), ("p", False, False, True, False, True), ("q", False, False, False, False, False)], "part string, x boolean, y boolean, z boolean, good boolean, toxic boolean")
    edges = [tuple(r) for r in trie_edges(rows, "xyz").select("part", "state", "filter", "alive", "removed", "good_lost", "toxic_lost").collect()]
    assert len(edges) == len(set(edges)) and ("p", 0, "z", 2, 2, 1, 1) in edges and ("p", 1, "z", 1, 1, 0, 1) in edges and ("q", 3, "z", 1, 0, 0, 0) in edges
    assert len([e for e in edges if e[0] == "q"]) == 3 * 2**2  # each filter from every set without it, once


def test_empty(spark, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(none, marks) == []
