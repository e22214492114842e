import pytest
from pyspark.sql import functions as F

from filigree.functions.texts import plain
from filigree.operators import disclosures, holdings, insiders, names, trees
from filigree.plans.metrics import METRICS, financial_metrics
from filigree.plans.scores import altman_rating, beneish_rating, health_scores, piotroski_rating
from filigree.plans.statements import facts, financial_statements, stitched_statements

FACT = "cik long, taxonomy string, concept string, label string, unit string, pos int, value string, numeric_value double, fy long, fp string, form string, filed string, start string, end string, accession string"


def fact(concept, value, end, form="10-K", fp="FY", filed=None, accession=None, cik=1, unit="USD", taxonomy="us-gaap"):
    return (cik, taxonomy, concept, None, unit, 0, str(value), value, int(end[:4]), fp, form, filed or f"{int(end[:4]) + 1}-02-01", None, end, accession or f"a-{end}-{form}")


@pytest.fixture(scope="module")
def source(spark):
    rows = []
    for y, k in (("2021-12-31", 1.0), ("2022-12-31", 2.0)):
        rows += [fact(c, v * k if c != "Assets" else v, y) for c, v in {"Revenues": 100.0, "GrossProfit": 40.0, "NetIncomeLoss": 10.0, "Assets": 500.0, "AssetsCurrent": 50.0, "LiabilitiesCurrent": 25.0, "NetCashProvidedByUsedInOperatingActivities": 12.0, "PaymentsToAcquirePropertyPlantAndEquipment": -2.0, "StockholdersEquity": 20.0, "CostOfRevenue": 0.0}.items()]
    rows += [fact("RevenueFromContractWithCustomerExcludingAssessedTax", 7.0, "2020-12-31", form="10-Q", fp="Q4"), fact("Revenues", 190.0, "2022-12-31", form="10-Q", fp="Q4", filed="2023-01-15"), fact("Revenues", 9.0, "2022-12-31", cik=2)]
    return spark.createDataFrame(rows, FACT)


def test_priority_is_judged_after_the_filters(source):
    pick = lambda form: {r.concept for r in financial_statements(source, "income", form, latest=9).where("line_item = 'revenue' and cik = 1").collect()}
    assert pick(None) == {"RevenueFromContractWithCustomerExcludingAssessedTax"} and pick("10-K") == {"Revenues"}


def test_newest_first_and_stitching(source):
    s = financial_statements(source, "income", "10-K", latest=1).where("line_item = 'revenue'").collect()
    assert sorted((r.cik, r.end, r.numeric_value) for r in s) == [(1, "2022-12-31", 200.0), (2, "2022-12-31", 9.0)]
    only = source.where("concept = 'Revenues' and cik = 1")
    x = {r.end: r for r in stitched_statements(only, "income", latest=4).collect()}
    assert x["2022-12-31"].form == "10-K" and x["2022-12-31"].duplicate_forms == ["10-K", "10-Q"] and x["2022-12-31"].source_count == 2 and x["2022-12-31"].period_kind == "annual"


def test_facts(source):
    assert facts(source, "revenue", latest=1).where("cik = 1").first().filed == "2023-02-01" and facts(source, "evenu").count() >= 5


def test_metrics(source):
    m = {(r.cik, r.period_end, r.metric): r for r in financial_metrics(source.where("form = '10-K'"), latest=2).collect()}
    assert len(METRICS) == 54 == len({x[0] for x in METRICS})
    assert m[1, "2022-12-31", "gross_margin"].value == 0.4 and m[1, "2022-12-31", "gross_margin"].display_value == "40.00%"
    assert m[1, "2022-12-31", "revenue_growth"].value == 1.0 and (1, "2021-12-31", "revenue_growth") not in m
    assert m[1, "2022-12-31", "free_cash_flow"].value == 20.0 and m[1, "2022-12-31", "current_ratio"].display_value == "2.00x"
    assert m[1, "2022-12-31", "working_capital"].value == 50.0 and (1, "2022-12-31", "roic") not in m and (1, "2022-12-31", "inventory_turnover") not in m


def test_scores(source, spark):
    s = {(r.period_end, r.score_name): r for r in health_scores(source.where("form = '10-K' and cik = 1"), latest=1).collect()}
    p = s["2022-12-31", "piotroski_f_score"]
    assert p.score == 5.0 and p.rating == "mixed" and {x.signal: x.passed for x in p.signals}["no_share_dilution"] is None
    assert s["2022-12-31", "altman_z_score_private"].rating == "insufficient_data" and s["2022-12-31", "beneish_m_score"].score is None
    r = spark.range(1).select(piotroski_rating(F.lit(8.0)).alias("a"), altman_rating(F.lit(2.6)).alias("b"), beneish_rating(F.lit(-1.78)).alias("c"), altman_rating(F.lit(1.1)).alias("d")).first()
    assert tuple(r) == ("strong", "gray", "low_risk", "gray")


def test_holdings(spark):
    rows = [(1, "a1", "x", "A", None, "2022-09-30", 5, 10.0, 1), (1, "a1", "x", "A", None, "2022-09-30", 1, 2.0, 0), (1, "a2", "x", "A", None, "2022-12-31", 7000, 12.0, 0), (1, "a2", "y", "A", "Put", "2022-12-31", 9, 1.0, 1), (1, "a1", "z", "A", None, "2022-09-30", 9223372036854775807, 1.0, 2)]
    df = spark.createDataFrame(rows, "cik long, accession string, cusip string, class string, put_call string, report_date string, value long, shares double, pos int")
    agg = holdings.aggregate(holdings.scaled(df))
    got = {(r.accession, r.cusip): (r.value_usd, r.shares, r.row_count) for r in agg.collect()}
    assert got[("a1", "x")] == (6000, 12.0, 2) and got[("a2", "x")][0] == 7000 and got[("a1", "z")][0] == 9223372036854775807
    d = {r.cusip: (r.change_type, int(r.value_change)) for r in holdings.diff(*holdings.two_newest(agg)).collect()}
    assert d["x"] == ("unchanged", 1000) and d["y"] == ("new", 9) and d["z"][0] == "exited"


def test_insiders(spark):
    df = spark.createDataFrame([("P", "A", 10.0, 2.5, False), ("S", "D", 4.0, None, False), ("Q", "D", 1.0, 3.0, True), ("Q", None, None, 1.0, False)], "code string, acquired_disposed string, shares double, price double, derivative boolean").withColumn("k", F.lit(1))
    assert [r.transaction_type for r in insiders.transactions(df).collect()] == ["purchase", "sale", "disposition", None]
    r = insiders.summary(df, ["k"]).first()
    assert (r.transaction_count, r.derivative_count, r.acquired_value, r.disposed_value, r.net_shares) == (4, 1, 25.0, 3.0, 5.0)


def test_tree_with_cycle_and_shared_child(spark):
    e = [("r", "a", "c", 2.0, 1.0), ("r", "a", "b", None, 1.0), ("r", "b", "d", 1.0, 1.0), ("r", "c", "d", 1.0, -1.0), ("r", "d", "a2", 1.0, 1.0), ("r", "a2", "d", 1.0, 1.0)]
    t = trees.preorder(spark.createDataFrame(e, "role string, parent string, child string, ord double, weight double"), ["role"]).orderBy("line_order").collect()
    assert [(r.node, r.depth) for r in t] == [("a", 0), ("b", 1), ("d", 2), ("a2", 3), ("c", 1), ("d", 2), ("a2", 3)] and t[3].path == "a > b > d > a2"


def test_checks(spark):
    e = spark.createDataFrame([(1, "r", p, c, w) for p, c, w in [("ok", "x", None), ("ok", "y", -1.0), ("bad", "x", 1.0), ("gone", "x", 1.0), ("none", "q", 1.0)]], "k int, role string, parent string, child string, weight double")
    v = spark.createDataFrame([(1, c, x) for c, x in [("x", 10.0), ("y", 4.0), ("ok", 6.2), ("bad", 100.0), ("none", 1.0)]], "k int, concept string, numeric_value double")
    got = {r.parent: (r.status, r.missing_children) for r in trees.calculation_checks(e, v, ["k"], 0.25).collect()}
    assert got == {"ok": ("ok", []), "bad": ("mismatch", []), "gone": ("missing_parent", []), "none": ("missing_children", ["q"])}


def test_names(spark):
    a = spark.createDataFrame([(1, "Acme Holdings, Inc."), (2, "Ab Co"), (3, "Nothing Alike")], "id int, name string")
    b = spark.createDataFrame([(7, "The Acme Holdings Corp of Ohio"), (8, "AB Company"), (9, "ABC")], "other_id int, other_name string")
    assert sorted(tuple(r) for r in names.match(a, b).collect()) == [(1, 7), (2, 8)]


def test_events_and_exhibits(spark):
    html = "<p>Item 2.02 Results 1 Item 9.01 Exhibits</p><p>Item 2.02 Results of Operations. The company said revenue rose.</p><p>Item 9.01 Financial Statements and Exhibits are listed below.</p><p>Item 9.99 no</p>"
    ev = disclosures.eightk_events(html)
    assert [(e["item"], e["is_furnished"]) for e in ev] == [("2.02", True), ("9.01", False)] and "revenue rose" in ev[0]["content"]
    kinds = [("EX-99.1", "earnings", "earnings_release"), ("EX-99.2", None, "press_release"), ("EX-10.1", None, "material_contract"), ("EX-101.INS", None, "xbrl"), ("EX-21", None, "other_exhibit"), ("EX-2.1", None, "transaction_agreement"), ("10-K", None, None)]
    df = spark.createDataFrame([(i, k, d, None, "x") for i, (k, d, _) in enumerate(kinds)], "i int, document_type string, description string, filename string, content string")
    assert {r.i: r.category for r in disclosures.eightk_exhibits(df).collect()} == {i: c for i, (*_, c) in enumerate(kinds) if c}
    assert disclosures.eightk_exhibits(df, shadowed=True).where("i = 3").first().category == "material_contract"


def test_topics(spark):
    df = spark.createDataFrame([("Revenue by business segment", ["net sales"], [["a"]]), ("Nothing", ["x"], [["y"]])], "title_hint string, headers array<string>, rows array<array<string>>")
    r = disclosures.company_topics(df).collect()
    assert [x.topic for x in r] == ["segment_revenue"] and r[0].confidence == pytest.approx(7 / 8)
    assert disclosures.company_topics(df, "tax-rate").count() == 0


def test_narratives():
    g = disclosures.schedule13("13g")("Widget Corp (Name of Issuer) December 31, 2023 (Date of Event Which Requires Filing) 1. Names of Reporting Persons. Fund LP 2. Check Sole Voting Power 1,000 Item 1. (a) Name of Issuer: Widget Corp (b) Address of Issuer: 1 Road Item 2. (a) Name of Person Filing: Fund LP (d) Title of Class of Securities: Common (e) CUSIP Number: 123456789 Item 4. Ownership Amount beneficially owned: 5,000 Percent of class: 7.5% /s/ Jane Roe Jane Roe")[0]
    assert (g["issuer_name"], g["reporting_persons"], g["sole_voting_power"], g["beneficially_owned"], g["percent_of_class"], g["event_date"]) == ("Widget Corp", ["Fund LP"], 1000.0, 5000.0, 7.5, "December 31, 2023") and g["signatures"] == ["Jane Roe"]
    p = disclosures.proxy("<p>Annual Meeting on May 3, 2024. Record date is March 1, 2024.</p><table><tr><td>1</td><td>Election of Directors: all</td><td>FOR</td></tr><tr><td>2</td><td>Ratify the auditor</td><td>FOR</td></tr></table>")[0]
    assert [(x["number"], x["category"], x["title"]) for x in p["proposals"]] == [(1, "director_election", "Election of Directors"), (2, "auditor_ratification", "Ratify the auditor")] and p["meeting_date"] == "May 3, 2024"
    assert [x["number"] for x in disclosures.proposals("Proposal No. 3 - Approve the stock plan; Proposal 4 - Other thing.", [])] == [3, 4]
    f = disclosures.prospectus("<p>" + "x " * 80 + 'Our common stock, 1,500,000 shares at $10.00 to $12.00 is under the symbol "ACME" on the New York Stock Exchange. Risk Factors Investing is risky indeed. Use of Proceeds We will spend it. Underwriting Goldman Sachs leads.</p>')[0]
    assert (f["proposed_ticker"], f["shares_offered"], f["price_range"], f["exchange"], f["underwriters"]) == ("ACME", "1,500,000 shares", "$10.00 to $12.00", "New York Stock Exchange", ["Goldman Sachs"]) and f["risk_factors"]["content"] == "Risk Factors Investing is risky indeed."
    i = disclosures.foreign_issuer("<p>" + "y " * 60 + "Symbol: ABC. on NYSE. A dividend and press release. Risk Factors many risks exist here. Item 5 KPMG LLP</p>")[0]
    assert (i["symbol"], i["exchange"], i["auditor"], i["event_signals"]) == ("ABC", "NYSE", "KPMG LLP", ["press_release", "dividend"])
    assert plain("a<br>b") == "a b"


def test_cover_page_of_a_schedule():
    text = "ACME HOLDINGS, INC. (Name of Issuer) Common Stock (Title of Class of Securities) 00101A100 (CUSIP Number) June 30, 2021 (Date of Event Which Requires Filing of this Statement) 1. Name of Reporting Person: Blue Fund, L.P. 2. Check the Appropriate Box (a) [ ] 7. Sole Voting Power 0 8. Shared Voting Power 12,345 9. Sole Dispositive Power 0 10. Shared Dispositive Power 12,345 11. Aggregate Amount Beneficially Owned by Each Reporting Person 12,345 13. Percent of Class Represented by Amount in Row (11) 6.25% 1. Name of Reporting Person: Red LLC 2. Check Item 3. Source and Amount of Funds. Working capital. Item 4. Purpose of Transaction. The persons seek talks with the board. Signature /s/ Ann Lee Name: Ann Lee"
    r = disclosures.schedule13("13d")(text)[0]
    assert (r["issuer_name"], r["security_title"], r["cusip"], r["event_date"]) == ("ACME HOLDINGS, INC", "Common Stock", "00101A100", "June 30, 2021")
    assert r["reporting_persons"] == ["Blue Fund, L.P", "Red LLC"] and (r["sole_voting_power"], r["shared_voting_power"], r["beneficially_owned"], r["percent_of_class"]) == (0.0, 12345.0, 12345.0, 6.25)
    assert r["purpose"].startswith("Item 4. Purpose of Transaction") and r["signatures"] == ["Ann Lee"] and r["activist_intent"]
    assert disclosures.schedule13("13g")("")[0]["issuer_name"] is None


def test_notice_and_headings_of_a_proxy():
    notice = "Notice of Annual Meeting. Items of Business: 1. Election of Directors: Ann Lee, Bob Ray and Cy Young FOR 2. Ratification of the auditor FOR 3. Report on climate AGAINST and other business"
    rows = disclosures.proposals(notice, [])
    assert [(r["number"], r["category"], r["title"], r["recommendation"]) for r in rows] == [(1, "director_election", "Election of Directors", "FOR"), (2, "auditor_ratification", "Ratification of the auditor", "FOR"), (3, "other", "Report on climate", "AGAINST")]
    assert disclosures.proxy(notice)[0]["director_nominees"] == ["Ann Lee", "Bob Ray", "Cy Young"]
    rows = disclosures.proposals("Proposal No. 2: Approval of the 2024 stock plan. The Board recommends a vote FOR Proposal 2.", [])
    assert [(r["number"], r["category"], r["recommendation"]) for r in rows] == [(2, "equity_plan", "FOR")]


def test_long_name_inside_a_longer_one(spark):
    long = " ".join(f"word{i}" for i in range(14))
    a, b = spark.createDataFrame([(1, long)], "id long, name string"), spark.createDataFrame([(7, "first " + long + " last")], "other_id long, other_name string")
    assert [tuple(r) for r in names.match(a, b).collect()] == [(1, 7)]


def test_comparison_without_a_join_equals_the_joined_one(spark):
    import random

    from filigree.operators import holdings

    r = random.Random(5)
    rows = {(c, d, r.choice("AB"), r.choice(["x", None]), r.choice(["PUT", None])): (r.randrange(5) * 100, float(r.randrange(4))) for c in range(6) for d in ("2024-03-31", "2023-12-31", "2023-09-30")[: 1 + c % 3] for _ in range(6)}
    df = spark.createDataFrame([(c, f"{c}-{d}", d, a, k, p, v, s, 1) for (c, d, a, k, p), (v, s) in rows.items()], "cik long, accession string, report_date string, cusip string, class string, put_call string, value_usd long, shares double, row_count long")
    joined = holdings.diff(*holdings.two_newest(df))
    assert sorted(map(str, holdings.newest_changes(df).select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    plan = holdings.newest_changes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_search_filters_let_every_match_pass(spark):
    from filigree.functions import texts

    rows = ["the NET sales", "net  sales", "Sales then a net", "net", None, "", "ſales net sales", "é NET SALES é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    kept = {x.id for x in df.where(texts.may_match(F.col("t"), "Net Sales") | texts.may_match_words(F.col("t"), "Net Sales")).collect()}
    assert kept >= {i for i, t in enumerate(rows) if t and texts.search(t, "Net Sales")} and not kept & {3, 4, 5}
    assert texts.search("sales far net", "net sales", exact=True) == [] and texts.search("sales far net", "net sales") != []


def test_parser_hands_on_rows_document_by_document(spark, monkeypatch):
    from filigree.sources import parse

    df = spark.createDataFrame([(i, "k", "x" * 300_000 if i % 2 else None) for i in range(20)], "id int, other string, text string").coalesce(1)

    def parser(t):
        if not t:
            raise ValueError("empty")
        return [{"n": len(t)}, {"n": 1}]

    out = parse.parsed(df, ["other", "id"], "text", parser, "n long").collect()
    assert sorted((r.id, r.n, r._error) for r in out if r.id % 2) == sorted((i, n, None) for i in range(1, 20, 2) for n in (300_000, 1))
    assert sum(r._error == "ValueError: empty" for r in out) == 10
