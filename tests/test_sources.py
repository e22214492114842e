import pytest
from pyspark.sql import functions as F

from filigree.sources import documents, filings, xmlforms

SUB = "<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<DESCRIPTION>main <b>\n<TEXT>\n<html>x <text>in</TEXT> y</html>\n</TEXT>\n</DOCUMENT><document><type>EX-99.1\n<sequence>2\n<TEXT>plain</TEXT></document><DOCUMENT><TYPE>lost"


def test_submission(spark):
    d = documents.split_submission(SUB)
    assert [x["document_type"] for x in d] == ["10-K", "EX-99.1"] and d[0]["content"] == "<html>x <text>in</TEXT> y</html>" and d[0]["description"] == "main" and d[1]["filename"] is None
    docs = documents.submission_documents(spark.createDataFrame([(1, SUB)], "accession long, text string"), ["accession"])
    assert [r.content_type for r in docs.orderBy("pos").collect()] == ["html", "text"]
    assert documents.document_content(docs, ["accession"], limit_bytes=4).first().content == "x in" and documents.document_content(docs, ["accession"], sequence="2").first().content == "plain"
    assert documents.of_type(docs, "ex-99.1").count() == 1 and documents.primary(docs).count() == 1


def test_bad_documents_give_an_error_row(spark):
    df = spark.createDataFrame([(1, "<a><b></a>"), (2, "<informationTable><infoTable><value>1,200</value></infoTable></informationTable>")], "k long, content string")
    rows = {r.k: r for r in xmlforms.parse_column(df, ["k"], "holdings").collect()}
    assert "malformed" in rows[1]._error and rows[2].value == 1200 and rows[2]._error is None


def test_submissions_and_facts_json(spark):
    js = '{"name": "Acme", "filings": {"recent": {"accessionNumber": ["1-2-3", "4-5-6"], "form": ["10-K", "4"], "filingDate": ["2024-01-02", "x"], "reportDate": ["", "2023-12-31"], "primaryDocument": ["a.htm", ""], "isXBRL": [1, 0, 1], "isInlineXBRL": [true, false]}}}'
    r = filings.submissions(spark.createDataFrame([(7, js)], "cik long, json string")).orderBy("pos").collect()
    assert len(r) == 2 and r[0].report_date is None and r[0].is_xbrl is True and r[1].is_inline_xbrl is False and r[0].source_url.endswith("/7/123/1-2-3-index.html")
    assert filings.filings(filings.submissions(spark.createDataFrame([(7, js)], "cik long, json string")), latest=0).count() == 0
    js = '{"entityName": "A", "facts": {"us-gaap": {"Cash": {"label": "c", "units": {"USD": [{"val": 5, "fy": 2020, "accn": "a"}, {"val": "7"}, {"val": 1.5}, {"val": true}]}}}}}'
    f = {r.pos: r for r in filings.company_facts(spark.createDataFrame([(7, js)], "cik long, json string")).collect()}
    assert [f[i].numeric_value for i in range(4)] == [5.0, None, 1.5, None] and f[1].value == "7" and f[0].accession == "a"


def test_daily_index_tickers_and_hits(spark):
    lines = ["Description", "-----", "CIK|Company Name|Form Type|Date Filed|Filename", "-----", "12|Acme|8-K|20240102|edgar/data/12/0001-24-1.txt", "x|b|c|d|e", "1|2|3|4"]
    r = filings.daily_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(x.cik, x.accession) for x in r] == [(12, "0001-24-1")]
    t = filings.tickers(spark.createDataFrame([('{"0": {"cik_str": 9, "ticker": "brk.b", "title": "B"}, "1": {"cik_str": 4, "ticker": "X", "title": "x"}}',)], "json string"))
    assert filings.with_cik(spark.createDataFrame([("BRK.B",), ("?",)], "ticker string"), t).where("cik = 9").count() == 1
    h = '{"hits": {"hits": [{"_id": "1-2-3:a.htm", "_score": 2.5, "_source": {"ciks": ["0000000012"], "display_names": ["Acme Corp  (CIK 0000000012)"], "form": "8-K", "file_date": "2024-01-02", "period_ending": "", "adsh": "1-2-3"}}]}}'
    x = filings.search_hits(spark.createDataFrame([(h,)], "json string")).first()
    assert (x.cik, x.company, x.document, x.period_ending) == (12, "Acme Corp", "a.htm", None)
    assert "size=100" in filings.efts_url("q", size=500) and "ciks=0000000012" in filings.efts_url("q", ciks=[12])


FORM4 = "<ownershipDocument><periodOfReport>2024-01-01</periodOfReport><issuer><issuerName>I</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerName>One</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>maybe</isOfficer></reportingOwnerRelationship></reportingOwner><derivativeTable><derivativeTransaction><securityTitle><value>Opt</value></securityTitle><transactionCoding><transactionCode>M</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1,000</value></transactionShares></transactionAmounts></derivativeTransaction></derivativeTable></ownershipDocument>"


def test_xml_forms():
    r = xmlforms.form4(FORM4)[0]
    assert (r["owner_name"], r["is_director"], r["is_officer"], r["derivative"], r["code"], r["shares"], r["security_title"]) == ("One", True, None, True, "M", 1000.0, "Opt")
    s = xmlforms.report_summary("<edgarSubmission><periodOfReport>09-30-2022</periodOfReport><coverPage><filingManager><name>M</name><address><city>C</city></address></filingManager></coverPage><summaryPage><tableEntryTotal>3</tableEntryTotal><otherManager2><otherManager><name>N</name></otherManager></otherManager2></summaryPage></edgarSubmission>")[0]
    assert (s["report_date"], s["manager"], s["city"], s["entry_total"], s["other_managers"]) == ("2022-09-30", "M", "C", 3, ["N"])
    f = xmlforms.fund_report("<edgarSubmission><regName>R</regName><totAssets>10.5</totAssets><invstOrSec><name>a</name><valUSD>3</valUSD><isRestrictedSec>N</isRestrictedSec></invstOrSec><invstOrSec><name>b</name></invstOrSec><netAssets>9</netAssets><proxyVote><issuerName>v</issuerName><sharesVoted>5</sharesVoted></proxyVote></edgarSubmission>", 1)[0]
    assert (f["registrant"], f["holdings_count"], f["net_assets"], f["holdings"][0]["restricted"], f["proxy_votes"][0]["shares"]) == ("R", 1, 9.0, False, 5.0)
    links = xmlforms.linkbase('<linkbase xmlns:x="http://x"><presentationLink x:role="r"><loc x:label="a" x:href="s.xsd#us-gaap_A"/><loc x:label="b" x:href="s.xsd#us-gaap_B"/><presentationArc x:from="a" x:to="b" order="2"/></presentationLink><labelLink x:role="r"><loc x:label="a" x:href="#us-gaap_A"/><label x:label="l" x:role="std">Name</label><labelArc x:from="a" x:to="l"/></labelLink></linkbase>')
    assert [(x["linkbase"], x.get("parent"), x["child"], x.get("label"), x["ord"]) for x in links] == [("presentation", "us-gaap:A", "us-gaap:B", None, 2.0), ("label", None, "us-gaap:A", "Name", None)]
    i = xmlforms.inline_facts('<div><ix:nonFraction name="us:Rev" contextRef="c" unitRef="u" scale="3" sign="-" id="f1">1,2<b>34</b></ix:nonFraction> <ix:nonNumeric name="dei:N" contextRef="c">outer <ix:nonFraction name="x:Y" contextRef="c">5</ix:nonFraction></ix:nonNumeric>')
    assert [(x["name"], x["numeric_value"]) for x in i] == [("us:Rev", -1234000.0), ("dei:N", None), ("x:Y", 5.0)] and i[1]["value"] == "outer 5"


def test_content_selector_plan(spark):
    docs = documents.submission_documents(spark.createDataFrame([(1, SUB)], "accession long, text string"), ["accession"])
    assert docs.select(F.sum("byte_length")).first()[0] > 0


PARSED = {"prospectus_parts": "part", "all_sections": "part", "foreign_parts": "customer", "schedule13": "customer", "prospectus": "part", "foreign_issuers": "customer", "proxy_shapes": "customer", "mixed_forms": "orders", "sections": "orders", "inline_facts": "orders", "search_snippets": "part", "exhibits_8k": "customer", "typed_documents": "customer", "form13f_summary": "supplier", "proxy_proposals": "supplier"}


@pytest.mark.parametrize("query", PARSED)
def test_one_short_file_is_parsed_by_many_tasks(spark, tmp_path, query):
    from filigree.plans import disclosed, forms, landing

    columns = {"part": "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 7 AS p_size", "customer": "id AS c_custkey, 'm' AS c_mktsegment, 3 AS c_nationkey", "orders": "id AS o_orderkey, id AS o_custkey, 2.5D AS o_totalprice, '1-URGENT' AS o_orderpriority", "supplier": "id AS s_suppkey, 'n' AS s_name, 2 AS s_nationkey"}
    spark.range(0, 40, 1, 1).selectExpr(*columns[PARSED[query]].split(", ")).write.parquet(f"{tmp_path}/{PARSED[query]}.parquet")
    out = (disclosed.QUERIES | forms.QUERIES | landing.QUERIES)[query](spark, str(tmp_path))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_prefilters_lose_no_match():
    from filigree.functions import texts

    assert texts.lacks("net sales", "risk") and not texts.lacks("RISK", "risk") and not texts.lacks("ri\u017fk", "risk")
    assert texts.plain("a<\u017fcript>x</\u017fcript>b &amp; c") == "a b & c" and texts.plain("<STYLE>x</STYLE> a&nbsp;b &#65;") == "a b A"
    assert texts.tables("<TABLE><tr><td>a</td></tr></TABLE>")[0]["rows"] == [["a"]] and texts.tables("no") == []
    long = "x" * 120 + " Ri\u017f\u212a Factors are many, in all of our markets."
    assert texts.excerpt(long, "Risk Factors", "Item")["byte_length"] > 40
    report = "Item 1A. Risk Factors one Item 2. Properties two"
    for _ in range(2):
        assert texts.section(report, "risk")[0]["content"] == "Item 1A. Risk Factors one" and texts.section(report + "!", "2")[0]["content"] == "Item 2. Properties two!"


def test_records_of_many_holdings():
    from time import process_time

    row = "<a:infoTable><a:nameOfIssuer> A  B </a:nameOfIssuer><a:cusip><a:value>C{0}</a:value></a:cusip><a:cusip>late</a:cusip><a:value>1,{0}</a:value><a:shrsOrPrnAmt><a:sshPrnamt>2</a:sshPrnamt></a:shrsOrPrnAmt><a:putCall/></a:infoTable>"
    table = "<a:informationTable xmlns:a='a'>" + "".join(row.format(n) for n in range(100, 600)) + "</a:informationTable>"
    start = process_time()
    out = xmlforms.information_table(table)
    root_time = process_time() - start
    assert [(x["issuer"], x["cusip"], x["value"], x["shares"], x["put_call"], x["voting_sole"]) for x in out[:2]] == [("A B", "C100", 1100, 2.0, None, None), ("A B", "C101", 1101, 2.0, None, None)]
    fund = "<f xmlns:p='p'><regName>R</regName>" + "<p:invstOrSec><p:name>N</p:name><p:name>second</p:name><p:valUSD>7</p:valUSD><x><cusip>inner</cusip></x></p:invstOrSec>" * 500 + "</f>"
    r = xmlforms.fund_report(fund, 2)[0]
    assert (r["registrant"], r["holdings_count"]) == ("R", 2) and r["holdings"][1]["name"] == "N" and r["holdings"][1]["value_usd"] == 7 and r["holdings"][1]["cusip"] is None
    # Names of elements are resolved once each: 500 holdings take a small part of a second.
    assert root_time < 1 and xmlforms.local.cache_info().hits > 4000


def test_fund_reports_are_parsed_by_all_cores(spark):
    from filigree.plans.forms import fund_holdings

    out = fund_holdings(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() > 0
    # Dealing the orders by customer is the grouping's own exchange.
    assert out._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2 and out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
