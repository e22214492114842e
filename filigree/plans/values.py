"""Registered queries of filters, formats and look-ups, over the whole star-schema tables; SQL spells the expected values out."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from filigree.functions import predicates as P
from filigree.functions import scalars as X
from filigree.functions.catalogue import FORM_FAMILIES
from filigree.operators import holdings
from filigree.plans.queries import holdings_diff
from filigree.plans.statements import statement_order
from filigree.sources import filings


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _nth(values: list[str | None], key: str) -> Column:
    """One of the values by a key's remainder, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


FORMS = [" 4/a ", "10-K", "def 14a", "SC 13G/A", "424B9", "424b5", "6-k", "497K", "N-PX/A", "X-17", None]
NUMBERS = [" 1,234 ", "", "x", "-5.5", "1e3", "12", None, "007"]
FLAGS = ["TRUE", " no ", "2", "0", "maybe", "", "Y", None]
KINDS = ["EX-10.1", " ex-99 ", "10-K", None, "GRAPHIC", "exhibit"]
TOPICS = ["debt_maturity", "debt", "revenue_by_segment", "leases"]


def form_families(s, d):
    """The family of each form, however it is spelled, and whether it is a prospectus."""
    o = _table(s, d, "orders").withColumn("form", _nth(FORMS, "o_orderkey"))
    kind = F.coalesce(*[F.when(P.in_family(F.col("form"), k), F.lit(k)) for k, *_ in FORM_FAMILIES])
    return o.select("o_orderkey", kind.alias("kind"), P.in_family(F.col("form"), "prospectus").alias("prospectus"))


def display_values(s, d):
    n = F.col("l_linenumber") % 4
    value = F.when(n == 0, F.col("l_discount")).when(n == 1, F.col("l_quantity") + 0.25).when(n == 2, F.floor("l_extendedprice") + 0.25).otherwise(F.col("l_quantity") + 0.125)
    unit = F.when(n == 0, "ratio").when(n == 1, "multiple").when(n == 2, "USD").otherwise("count")
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.display_value(value, unit).alias("shown"))


def daily_urls(s, d):
    return _table(s, d, "orders").select("o_orderkey", X.daily_index_url(F.col("o_orderdate").cast("date")).alias("url"))


def decoded_values(s, d):
    raw, flag = _nth(NUMBERS, "o_orderkey"), _nth(FLAGS, "o_custkey")
    return _table(s, d, "orders").select("o_orderkey", X.parse_number(raw).alias("number"), X.parse_long(raw).alias("whole"), X.boolish(flag).alias("flag"))


def concept_filters(s, d):
    """Linkbase and inline concept filters on references that name a part's size."""
    name = F.concat(F.lit("us-gaap:Part"), F.col("p_size").cast("string"))
    href = F.concat(F.lit("schema.xsd#us-gaap_Part_"), F.col("p_size").cast("string"))
    p = _table(s, d, "part").select("p_partkey", name.alias("name"), X.normalize_href(href).alias("concept"))
    return p.select("p_partkey", "concept", P.xbrl_concept_is(F.col("concept"), "US-GAAP_part_1").alias("linked"), P.inline_concept_is(F.col("name"), "part7").alias("local"), P.inline_concept_is(F.col("name"), "US-GAAP:Part7").alias("full"), P.part_of(F.col("name"), "PART2").alias("part"))


def labelled_values(s, d):
    """A label's value, the known auditor and underwriters, and a safe file name of a customer's letter."""
    text = F.concat(F.lit("Letter\nIssuer agent :  "), "c_name", F.lit(" \t and  Sons\nAudited by Ernst  & Young LLP.\nSold by morgan stanley"), F.when(F.col("c_custkey") % 2 == 0, " and Jefferies").otherwise(""))
    c = _table(s, d, "customer").withColumn("text", text)
    return c.select("c_custkey", X.capture_label(F.col("text"), "issuer agent").alias("agent"), X.known_auditor(F.col("text")).alias("auditor"), F.array_join(X.known_underwriters(F.col("text")), "|").alias("underwriters"), X.safe_path_part(F.concat("c_name", F.lit(" /é.htm"))).alias("path"))


def report_cells(s, d):
    return _table(s, d, "part").select("p_partkey", X.grouped(F.col("p_partkey") * 1000).alias("grouped"), X.bar(F.col("p_size").cast("double"), F.lit(40.0)).alias("bar"))


def exhibit_filter(s, d):
    o = _table(s, d, "orders").withColumn("topic", _nth(TOPICS, "o_custkey"))
    return o.where(P.is_exhibit(_nth(KINDS, "o_orderkey")) & P.topic_is(F.col("topic"), " Debt")).select("o_orderkey", "topic")


def schedule_forms(s, d):
    """Orders whose form is one of those that a loosely spelled schedule means."""
    form = F.concat(F.lit("SC 13"), _nth(["D", "G", "D/A", "G/A", "E3"], "o_orderkey"))
    o = _table(s, d, "orders").select("o_orderkey", form.alias("form"))
    return o.select("o_orderkey", F.col("form").isin(*P.schedule13_forms("all")).alias("both"), F.col("form").isin(*P.schedule13_forms("schedule 13g/a")).alias("amended"), F.col("form").isin(*P.schedule13_forms("sc13d")).alias("d"))


def ticker_ciks(s, d):
    """Suppliers' tickers to ciks, by way of a ticker map's JSON a nation."""
    one = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("brk."), (F.col("c_custkey") % 97).cast("string")).alias("ticker"), F.col("c_name").alias("title"))
    raw = _table(s, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), one)))).alias("json"))
    mine = _table(s, d, "supplier").select("s_suppkey", F.concat(F.lit(" Brk-"), (F.col("s_suppkey") % 120).cast("string"), F.lit(" ")).alias("ticker"))
    return filings.with_cik(mine, filings.tickers(raw)).select("s_suppkey", "ticker", "cik")


def search_responses(s, d):
    """Hits of one search response a nation; every third has no accession of its own."""
    k = F.col("c_custkey")
    source = F.struct(
        F.array(F.lpad(k.cast("string"), 10, "0")).alias("ciks"), F.array(F.concat("c_name", F.lit("  (CIK 0000"), k.cast("string"), F.lit(")"))).alias("display_names"), F.lit("8-K").alias("form"), F.lit("2024-01-02").alias("file_date"),
        F.when(k % 2 == 0, F.lit("2023-12-31")).otherwise(" ").alias("period_ending"), F.when(k % 3 != 0, F.concat(F.lit("A-"), k.cast("string"))).alias("adsh"), k.alias("sequence"), F.lit("EX-99").alias("file_type"),
    )
    hit = F.struct(F.concat(F.lit("B-"), k.cast("string"), F.when(k % 5 == 0, F.lit("")).otherwise(":doc.htm")).alias("_id"), (k / 2).alias("_score"), source.alias("_source"))
    raw = _table(s, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))).alias("json"))
    return filings.search_hits(raw).select("accession", "cik", "company", "form", "filing_date", "period_ending", "sequence", "file_type", "document", "score")


def statement_sequence(s, d):
    """Places of lines in each company's printed statements."""
    lines = _table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cik"), _nth(["balance", "cashflow", "income", "other"], "o_orderkey").alias("statement"), (F.col("o_orderkey") % 3).alias("line_order"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("end"))
    return lines.select("o_orderkey", F.row_number().over(Window.partitionBy("cik").orderBy(*statement_order())).alias("place"))


def diff_sequence(s, d):
    """Places of the changes of each portfolio: changed positions first, then by size of the change."""
    w = Window.partitionBy("cik").orderBy(*holdings.diff_order(), "class", "put_call")
    return holdings_diff(s, d).select("cik", "cusip", "class", "put_call", "change_type", F.row_number().over(w).alias("place"))


QUERIES = {f.__name__: f for f in (form_families, display_values, daily_urls, decoded_values, concept_filters, labelled_values, report_cells, exhibit_filter, schedule_forms, ticker_ciks, search_responses, statement_sequence, diff_sequence)}


def oracles(holdings_diff_sql: str) -> dict[str, str]:
    return {
        "form_families": """SELECT o_orderkey, kind, CASE WHEN o_orderkey % 11 < 10 THEN o_orderkey % 11 IN (4, 5) END AS prospectus FROM orders JOIN (VALUES (0, 'form4'), (1, 'company_report'), (2, 'proxy'), (3, 'schedule13'), (4, 'prospectus'), (5, 'prospectus'),
  (6, 'foreign_issuer'), (7, 'fund_disclosure'), (8, 'fund_disclosure'), (9, NULL), (10, NULL)) AS t(k, kind) ON o_orderkey % 11 = k""",
        "display_values": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN printf('%.2f%%', l_discount * 100) WHEN 1 THEN printf('%.2fx', l_quantity + 0.25) WHEN 2 THEN floor(l_extendedprice)::BIGINT::VARCHAR
  ELSE floor(l_quantity)::BIGINT || '.1250' END AS shown FROM lineitem""",
        "daily_urls": """WITH x AS (SELECT o_orderkey, o_orderdate::DATE - CASE isodow(o_orderdate) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS d FROM orders)
SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/daily-index/' || year(d) || '/QTR' || ((month(d) - 1) // 3 + 1) || '/master.' || strftime(d, '%Y%m%d') || '.idx' AS url FROM x""",
        "decoded_values": """SELECT o_orderkey, number, whole, flag FROM orders JOIN (VALUES (0, 1234::DOUBLE, 1234::BIGINT), (1, NULL, NULL), (2, NULL, NULL), (3, -5.5, NULL), (4, 1000, NULL), (5, 12, 12), (6, NULL, NULL), (7, 7, 7)) AS t(k, number, whole) ON o_orderkey % 8 = k
  JOIN (VALUES (0, true), (1, false), (2, true), (3, false), (4, NULL), (5, NULL), (6, true), (7, NULL)) AS f(j, flag) ON o_custkey % 8 = j""",
        "concept_filters": "SELECT p_partkey, 'us-gaap:Part:' || p_size AS concept, p_size::VARCHAR LIKE '1%' AS linked, p_size = 7 AS local, p_size = 7 AS \"full\", p_size::VARCHAR LIKE '2%' AS part FROM part",
        "labelled_values": "SELECT c_custkey, c_name || ' and Sons' AS agent, 'Ernst & Young LLP' AS auditor, 'Morgan Stanley' || CASE WHEN c_custkey % 2 = 0 THEN '|Jefferies' ELSE '' END AS underwriters, replace(c_name, '#', '_') || '___.htm' AS path FROM customer",
        "report_cells": "WITH x AS (SELECT p_partkey, least(12, round(p_size * 12 / 40.0))::INT AS n FROM part) SELECT p_partkey, format('{:,}', p_partkey * 1000) AS grouped, repeat('#', n) || repeat('.', 12 - n) AS bar FROM x",
        "exhibit_filter": "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'debt_maturity' ELSE 'debt' END AS topic FROM orders WHERE o_orderkey % 6 IN (0, 1) AND o_custkey % 4 IN (0, 1)",
        "schedule_forms": "SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS \"both\", o_orderkey % 5 = 3 AS amended, o_orderkey % 5 = 0 AS d FROM orders",
        "ticker_ciks": "SELECT s_suppkey, 'BRK-' || s_suppkey % 120 AS ticker, (SELECT MIN(c_custkey) FROM customer WHERE c_custkey % 97 = s_suppkey % 120) AS cik FROM supplier",
        "search_responses": """SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'A-' ELSE 'B-' END || c_custkey AS accession, c_custkey AS cik, c_name AS company, '8-K' AS form, '2024-01-02' AS filing_date, CASE WHEN c_custkey % 2 = 0 THEN '2023-12-31' END AS period_ending,
  c_custkey AS sequence, 'EX-99' AS file_type, CASE WHEN c_custkey % 5 <> 0 THEN 'doc.htm' END AS document, c_custkey / 2::DOUBLE AS score FROM customer""",
        "statement_sequence": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 9 END, o_orderkey % 3, o_orderdate DESC, o_orderkey DESC) AS place FROM orders",
        "diff_sequence": f"SELECT cik, cusip, class, put_call, change_type, row_number() OVER (PARTITION BY cik ORDER BY change_type = 'unchanged', abs(value_change) DESC, cusip NULLS FIRST, class NULLS FIRST, put_call NULLS FIRST) AS place FROM ({holdings_diff_sql}) AS x",
    }
