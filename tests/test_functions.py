import pytest
from pyspark.sql import functions as F

from filigree.functions import predicates as P
from filigree.functions import scalars as X
from filigree.functions import texts as T
from filigree.functions.catalogue import CONCEPTS, EIGHTK_ITEMS, STATEMENTS, alias_concepts, statement_lines


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("v")).first().v


def test_catalogue_sizes():
    assert [len(STATEMENTS[s]) for s in ("income", "balance", "cashflow")] == [16, 19, 17]
    assert len(CONCEPTS) == 51 and sum(len(v.split()) for v in CONCEPTS.values()) == 170 and len(EIGHTK_ITEMS) == 32
    assert alias_concepts("us-gaap:Cash")[1] == "Cash" and alias_concepts("R&D")[0] == "ResearchAndDevelopmentExpense" and alias_concepts("nothing") is None
    assert {s for s, *_ in statement_lines("cash-flow")} == {"cashflow"}
    with pytest.raises(ValueError):
        statement_lines("notes")


@pytest.mark.parametrize("n,d,want", [(1.0, 4.0, 0.25), (1.0, 0.0, None), (1.0, 1e-17, None), (1.0, -2.0, -0.5)])
def test_safe_div(spark, n, d, want):
    assert one(spark, X.safe_div(F.col("n"), F.col("d")), n=n, d=d) == want


def test_growth_and_cash(spark):
    assert one(spark, X.growth(F.col("a"), F.col("b")), a=-80.0, b=-100.0) == pytest.approx(0.2)
    assert one(spark, X.growth(F.col("a"), F.col("b")), a=10.0, b=0.0) is None
    assert one(spark, X.free_cash_flow(F.col("a"), F.col("b")), a=10.0, b=-3.0) == 7.0


def test_plain_text_both_ways(spark):
    s = "<p>a&nbsp;&amp;lt; <script>x<y</script>b &#233;&#x1F600; &#39;c&#39;</p>\n\t<style>q</style>d &#0; &#xD800;"
    got = one(spark, X.plain_text(F.col("s")), s=s)
    assert got.startswith("a &lt; b é😀 'c' d".replace("&lt;", "<")) and T.plain(s).startswith("a < b é😀 'c' d")


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5, 7, 100, None])
def test_truncate(spark, limit):
    s = "aé😀z"
    want = s if limit is None else s.encode()[:limit].decode(errors="ignore")
    assert one(spark, X.truncate_utf8(F.col("s"), limit), s=s) == want and T.cut_bytes(s, limit)[0] == want


def test_small_helpers(spark):
    assert one(spark, X.comparable_name(F.col("s")), s="The Acme, Co. Holdings Inc.") == "the acme holdings"
    assert one(spark, X.normalize_href(F.col("s")), s="x.xsd#us-gaap_Net_Income") == "us-gaap:Net:Income"
    assert one(spark, X.accession_from_filename(F.col("s")), s="edgar/data/1/0001-22-3.txt") == "0001-22-3"
    assert one(spark, X.accession_from_filename(F.col("s")), s="edgar/none.txt") is None
    assert one(spark, X.safe_path_part(F.col("s")), s="a b/ç.x") == "a_b__.x"
    assert [one(spark, X.boolish(F.col("s")), s=v) for v in ("Yes", "0", "7", "maybe")] == [True, False, True, None]
    assert one(spark, X.daily_index_url(F.lit("2024-06-09").cast("date"))).endswith("2024/QTR2/master.20240607.idx")
    assert one(spark, X.display_value(F.lit(0.256), F.lit("ratio"))) == "25.60%"
    assert one(spark, X.known_auditor(F.col("s")), s="by Grant  Thornton LLP.") == "Grant Thornton LLP" and T.auditor("EY LLP") == "EY LLP"
    assert one(spark, X.known_underwriters(F.col("s")), s="hsbc and Nomura") == ["HSBC", "Nomura"]
    assert one(spark, X.bar(F.lit(6.0), F.lit(12.0))) == "######......"
    assert one(spark, X.capture_label(F.col("s"), "Agent"), s="Agent: Jane  Roe") == "Jane Roe"


def test_predicates(spark):
    ok = lambda _x, **v: one(spark, _x, **v)
    assert ok(P.form_is(F.col("f"), "10-k", True), f="10-K/A") and not ok(P.form_is(F.col("f"), "10-K/A", True), f="10-K")
    assert ok(P.date_in(F.col("d"), "2024-01-01", "2024-01-31"), d="2024-01-31") and not ok(P.date_in(F.col("d"), "2024-01-01", None), d="2023-12-31") and ok(P.date_in(F.col("d"), "2024-01-01", None), d="unknown")
    assert ok(P.concept_is("cash", F.col("c")), c="Cash") and not ok(P.concept_is("cash", F.col("c")), c="RestrictedCash") and ok(P.concept_is("restr", F.col("c")), c="RestrictedCash")
    assert ok(P.in_family(F.col("f"), "prospectus"), f="424B8") and ok(P.is_exhibit(F.col("t")), t=" ex-99.1")
    assert ok(P.inline_concept_is(F.col("n"), "Revenue"), n="us:revenue") and not ok(P.inline_concept_is(F.col("n"), "dei:Revenue"), n="us:Revenue")
    assert P.schedule13_forms("13g/a") == ["SC 13G/A"] and P.schedule13_forms(None) == ["SC 13D", "SC 13G"]
    with pytest.raises(ValueError):
        P.schedule13_forms("10-K")


def test_search_and_sections():
    t = "Item 1A. Risk Factors\nWe face many supply risks. <b>Supply</b> chains break."
    assert [h["offset"] for h in T.search(t, "SUPPLY")] == [t.index("supply"), t.index("Supply")] and T.search(t, "supply")[0]["section"].startswith("Item 1A. Risk Factors")
    assert T.search("é alpha then beta", "alpha-beta", 10)[0]["offset"] == 3 and T.search("alpha", "alpha gamma") == []
    assert "b>" not in T.search("x <b class='q'>supply</b>", "supply", 4)[0]["snippet"]
    doc = "Item 1A. Risk Factors 5 Item 1B. None 6 Item 1A. Risk Factors Long body of risks here. Item 1B. Unresolved"
    s = T.section(doc, "risk-factors")[0]
    assert s["content"] == "Item 1A. Risk Factors Long body of risks here." and s["end_offset"] - s["start_offset"] >= s["byte_length"]
    with pytest.raises(ValueError):
        T.section(doc, "99")


def test_tables():
    t = T.tables("<p>Intro. Key figures</p><table></table><table><tr><th>A</th><th></th><th>B</th></tr><tr><td>1</td><td>é &amp; 2</td></tr></table>", limit_rows=1)
    assert t == [{"table_index": 2, "title_hint": "Key figures", "row_count": 2, "column_count": 2, "returned_rows": 1, "truncated": True, "headers": ["A", "B"], "rows": [["A", "B"]]}]
