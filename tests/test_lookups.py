import random

import pytest
from pyspark.sql import functions as F

from filigree.operators import disclosures, resolver
from filigree.sources.filings import merged_feeds


def test_search_variants(spark):
    rows = [("H & H International Investment LLC",), ("H&H INTERNATIONAL INVESTMENT GROUP, LTD.",), ("Plain",), (" co ",), ("",), (None,), ("A* ~b-c_d.é, Inc",)]
    out = [r[0] for r in spark.createDataFrame(rows, "n string").select(resolver.search_variants(F.col("n"))).collect()]
    assert out[0] == ["H & H International Investment LLC", "H&H International Investment LLC", "H&H International Investment", "H H International Investment"]
    assert out[1] == ["H&H INTERNATIONAL INVESTMENT GROUP, LTD.", "H&H INTERNATIONAL INVESTMENT", "H H INTERNATIONAL INVESTMENT"]
    assert out[2:5] == [["Plain"], ["co"], [""]] and out[5] == []
    assert spark.createDataFrame([("H&H International Investment, LLC",), ("a* ~b-c_d.é",)], "n string").select(resolver.form_encoded(F.col("n"))).collect() == [("H%26H+International+Investment%2C+LLC",), ("a%2A+~b-c_d.%C3%A9",)]


def test_atom_feed():
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><company-info><cik>1</cik></company-info><company-info><cik> 0001759760 </cik><conformed-name>A &amp; B</conformed-name></company-info><entry><content><filing-type>13F-HR</filing-type></content></entry></feed>'
    assert resolver.atom_feed(feed) == [{"cik": 1759760, "company": "A & B", "entries": 1, "forms": ["13F-HR"]}]
    assert resolver.atom_feed("<feed/>")[0]["cik"] is None and resolver.atom_feed("<feed><company-info><cik>x</cik></company-info></feed>")[0]["cik"] is None
    with pytest.raises(ValueError):
        resolver.atom_feed("no feed")


def test_scored_pairs_miss_none(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    name = lambda: " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=r.randrange(1, 6)))
    q, c = [(i, name()) for i in range(150)] + [(900, ""), (901, None), (902, "Inc.")], [(i, name() + " Corp") for i in range(200)] + [(901, None)]
    words = lambda n: set((n or "").lower().replace(".", "").split()) - {"corp", "inc"}
    named = [words(n) for _, n in q + c if words(n)]
    df = {w: sum(w in x for x in named) for x in named for w in x}
    weight = lambda ws: sum(len(bin(len(named) // df[w])) - 2 for w in ws)
    want = []
    for i, a in q:
        for j, b in c:
            shared, heavier = weight(words(a) & words(b)), max(weight(words(a)), weight(words(b)))
            if shared and shared * 100 >= 60 * heavier:
                want.append((i, j, shared, heavier))
    got = resolver.scored_pairs(spark.createDataFrame(q, "id long, name string"), spark.createDataFrame(c, "cik long, company string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    none = resolver.manager_lookup(spark.createDataFrame(q[-3:], "id long, name string"), spark.createDataFrame([], "cik long, company string")).collect()
    assert len(none) == 3 and all(x.cik is None for x in none)


def test_lookup_prefers_variants_and_small_ciks(spark):
    c = spark.createDataFrame([(9, "Alpha Beta Corp"), (4, "Alpha Beta Inc"), (4, "Alpha Beta Inc"), (7, "Gamma Delta Epsilon LLC")], "cik long, company string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "Alpha Beta, Ltd."), (3, "delta GAMMA epsilon"), (4, "omega")], "id long, name string")
    out = {r.id: (r.cik, r.how) for r in resolver.manager_lookup(q, c).collect()}
    assert out == {1: (4, "score"), 2: (4, "variant"), 3: (7, "score"), 4: (None, None)}


def test_names_are_not_broadcast(spark):
    c = spark.createDataFrame([(k, f"Alpha{k} Beta") for k in range(50)], "cik long, company string")
    q = spark.createDataFrame([(k, f"beta alpha{k}") for k in range(50)], "id long, name string")
    out = resolver.manager_lookup(q, c)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One row, the number of names, is all that is broadcast.
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastNestedLoopJoin") == plan.count("IdentityBroadcastMode") == 2
    assert {r.id: r.cik for r in out.collect()} == {k: k for k in range(50)}


def test_model_answers():
    assert resolver.answer_json('x ```json\n[1]\n``` y') == [1] and resolver.answer_json('so {"a": [2]} end') == {"a": [2]}
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return ["nothing here", "[]", '{"candidates": [{"manager": "M", "cik": "CIK 0012", "confidence": 0.5}, "x", {"investor": 7, "cik": true}]}'][len(asked) - 1]

    out = resolver.answered("q", ask)
    assert len(asked) == 3 and [(c["rank"], c["manager"], c["investor"], c["cik"], c["confidence"]) for c in out] == [(1, "M", None, 12, "0.5"), (2, None, "7", None, None)]
    assert len(resolver.answered("q", lambda p: '[{"cik": 1}, {}, {}, {}, {}, {}, {}]')) == 5
    with pytest.raises(ValueError):
        resolver.answered("q", lambda p: "no")


def test_resolved_questions(spark, tmp_path):
    companies = spark.createDataFrame([(1, "Alpha Beta Corp"), (2, "Gamma Delta LLC"), (3, "Silent Partners")], "cik long, company string")
    filings = spark.createDataFrame([(1, "Alpha Beta Corp", "a1", "13F-HR", "2023-12-31", "2024-02-01"), (1, "Alpha Beta Corp", "a2", "13f-hr", "2024-03-31", "2024-05-01"), (2, "Gamma Delta LLC", "b1", "13F-HR", "2024-03-31", "2024-05-02"), (3, "Silent Partners", "c1", "10-K", None, "2024-01-01")], "cik long, company string, accession string, form string, report_date string, filing_date string")
    log = str(tmp_path / "asked")

    def ask(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return {"q1": '[{"manager": "ALPHA BETA, INC.", "cik": 1}]', "q2": '[{"manager": "Gamma Delta", "cik": 1, "notes": "n"}, {"manager": "Nowhere", "cik": 3}]', "q3": "garbage"}[prompt[-2:] if prompt[-2:] in ("q1", "q2", "q3") else "q3"]

    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3"), (4, None)], "id long, question string")
    out = {(r.id, r.rank): r for r in resolver.resolve_questions(q, ask, companies, filings).collect()}
    assert {k: (r.cik, r.status, r.latest_accession) for k, r in out.items()} == {(1, 1): (1, "verified_13f", "a2"), (2, 1): (2, "verified_13f", "b1"), (2, 2): (3, "no_recent_13f", None)}
    assert out[2, 1].notes == "n Company search corrected the CIK from 1 to 2." and len(out[1, 1].next_commands) == 3
    assert len(open(log).readlines()) == 4  # each question once, and one repair


def test_filing_rules():
    for text, want in (("[X] Rule 13d-1(b) [ ] Rule 13d-1(c)", "13d-1(b)"), ("[ ] Rule 13d-1(b) ☒ Rule 13d-l(c)", "13d-1(c)"), ("Rule 13d-1(d) x", "13d-1(d)"), ("Box Rule 13d-1(b) xylem", None), ("Rule 13d-1(b)", None), ("X Rule 13d-1(b", "13d-1(b)")):
        assert disclosures.filing_rule(text) == want, text


def test_merged_feeds(spark):
    schema = "cik long, accession string, form string, filing_date string, pos int"
    d = spark.createDataFrame([(1, "a", "SC 13D", "2024-01-01", 0), (1, "b", "SC 13D", "2024-03-01", 1), (1, "c", "SC 13D", "2024-09-01", 2), (2, "x", "SC 13D", None, 0)], schema)
    g = spark.createDataFrame([(1, "b", "SC 13G", "2024-03-01", 0), (1, "e", "SC 13G", "2024-03-01", 1)], schema)
    out = [(r.cik, r.place, r.accession, r.form) for r in merged_feeds([d, g], 2).orderBy("cik", "place").collect()]
    assert out == [(1, 1, "e", "SC 13G"), (1, 2, "b", "SC 13D"), (2, 1, "x", "SC 13D")]  # c is third of its feed
    assert merged_feeds([d, g], 0).count() == 0
    docs = spark.createDataFrame([("b", "1", "f.htm", "X Corp (Name of Issuer)"), ("a", "1", "f.htm", "y"), ("b", "2", "g", "z")], "accession string, sequence string, filename string, content string")
    r = disclosures.schedule13_reports(d.union(g), docs, 2)
    assert [(x.accession, x.issuer_name, x.filing_type) for x in r.collect()] == [("b", "X Corp", "13d")]
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("row_number")  # the limit lies below the parser
