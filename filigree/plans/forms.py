"""Registered queries of form parsers: documents are made from the whole star-schema tables, SQL states what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions import texts
from filigree.operators import disclosures
from filigree.sources import xmlforms
from filigree.sources.parse import dealt, parsed


def _text(pattern: str, **cols) -> Column:
    """The pattern with each {name} replaced by a column as text."""
    out: list[Column] = []
    for i, part in enumerate(pattern.split("{")):
        name, _, rest = part.partition("}") if i else ("", "", part)
        out += ([F.col(name).cast("string") if name not in cols else cols[name].cast("string")] if i else []) + [F.lit(rest)]
    return F.concat(*out)


def _joined(of: DataFrame, by: str, order: str, one: Column, head: str, tail: str) -> DataFrame:
    """One document (by, content) a group: its rows' texts in order between head and tail."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("x")))), lambda e: e["x"])
    return of.groupBy(by).agg(F.array_join(rows, "").alias("x")).select(by, _text(head + "{x}" + tail).alias("content"))


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _dealt(s, d, name, key):
    """A table of which each row becomes a document, spread before the documents are made."""
    return dealt(_table(s, d, name), key)


def inline_facts(s, d):
    """A number and a name an order, of which every third number is negative."""
    sign = F.when(F.col("o_orderkey") % 3 == 0, ' sign="-"').otherwise("")
    doc = _text('<div><ix:nonFraction name="us-gaap:Revenues" contextRef="c{o_custkey}" unitRef="USD" scale="3" decimals="-3"{sign}>${k},000</ix:nonFraction><p><ix:nonNumeric contextRef="c0" name="dei:EntityRegistrantName"><b>A &amp; B</b> {o_orderkey}</ix:nonNumeric></p></div>', sign=sign, k=F.floor("o_totalprice"))
    facts = xmlforms.parse_column(_dealt(s, d, "orders", "o_orderkey").select("o_orderkey", doc.alias("content")), ["o_orderkey"], "inline")
    return facts.select("o_orderkey", "pos", "name", "namespace", "local_name", "context_ref", "unit_ref", "scale", "decimals", "sign", "value", "numeric_value")


def linkbase_edges(s, d):
    """A presentation linkbase a region, an arc a nation."""
    one = _text('<l:loc x:label="n{n_nationkey}" x:href="s.xsd#us-gaap_N{n_nationkey}"/><l:presentationArc x:from="p" x:to="n{n_nationkey}" order="{n_nationkey}" x:arcrole="parent-child" preferredLabel="total"/>')
    docs = _joined(_table(s, d, "nation"), "n_regionkey", "n_nationkey", one, '<l:linkbase xmlns:l="l" xmlns:x="x"><l:presentationLink x:role="role/{n_regionkey}"><l:loc x:label="p" x:href="s.xsd#us-gaap_R{n_regionkey}"/>', "</l:presentationLink></l:linkbase>")
    return xmlforms.parse_column(docs, ["n_regionkey"], "links").select("n_regionkey", "pos", "linkbase", "role", "relationship", "parent", "child", "ord", "preferred_label")


def fund_holdings(s, d):
    """A fund report a customer, a holding an order."""
    one = _text("<invstOrSec><name>Order {o_orderkey}</name><balance>{o_custkey}</balance><valUSD>{k}</valUSD><assetCat>EC</assetCat><isRestrictedSec>{r}</isRestrictedSec></invstOrSec>", k=F.floor("o_totalprice"), r=F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N"))
    docs = _joined(_dealt(s, d, "orders", "o_custkey"), "o_custkey", "o_orderkey", one, "<f:edgarSubmission xmlns:f='f'><regName>Fund {o_custkey}</regName><repPdEnd>2023-12-31</repPdEnd><totAssets>1,000.5</totAssets>", "</f:edgarSubmission>")
    h = xmlforms.parse_column(docs, ["o_custkey"], "fund").select("o_custkey", "registrant", "period_end", "total_assets", "holdings_count", F.posexplode("holdings").alias("pos", "h"))
    return h.select("o_custkey", "registrant", "period_end", "total_assets", "holdings_count", "pos", "h.name", "h.balance", "h.value_usd", "h.asset_category", "h.restricted")


def form13f_summary(s, d):
    """A report summary a supplier."""
    doc = _text("<edgarSubmission><periodOfReport>03-31-2024</periodOfReport><filingManager><name>{s_name}</name><address><city>C{s_nationkey}</city><stateOrCountry>NY</stateOrCountry></address></filingManager><reportType>13F HOLDINGS REPORT</reportType><otherManager2><otherManager><name>M{s_suppkey}</name></otherManager></otherManager2><otherManager2><otherManager><name>Second &amp; Co</name></otherManager></otherManager2><otherIncludedManagersCount>2</otherIncludedManagersCount><tableEntryTotal>{s_suppkey}</tableEntryTotal><tableValueTotal>{v}</tableValueTotal><signatureBlock><name>Signer {s_suppkey}</name><signatureDate>05-01-2024</signatureDate></signatureBlock></edgarSubmission>", v=F.col("s_suppkey") * 1000)
    r = xmlforms.parse_column(_dealt(s, d, "supplier", "s_suppkey").select("s_suppkey", doc.alias("content")), ["s_suppkey"], "summary")
    return r.select("s_suppkey", "report_date", "report_type", "manager", "city", "state", "other_managers_count", "entry_total", "value", "signer", "signature_date", F.array_join("other_managers", "|").alias("other_managers"))


def sections(s, d):
    """Risk factors of an annual report an order: a contents list, then bodies."""
    doc = _text("Item 1. Business Item 1A. Risk Factors Item 2. Properties\nItem 1. Business We sell.\nItem 1A. Risk Factors Orders such as {o_orderkey} of {o_orderpriority} may be late — or lost.\nItem 2. Properties None.")
    return parsed(_dealt(s, d, "orders", "o_orderkey").select("o_orderkey", doc.alias("content")), ["o_orderkey"], "content", lambda t: texts.section(t, "risk_factors", 40), texts.SECTION).drop("_error")


def prospectus(s, d):
    """A prospectus a part: every other one offers shares to the public for the first time."""
    doc = _text("<p>This is {kind} of {n},000 shares of our Class A common stock between ${p_size}.00 and ${hi}.50 a share on the {market}.</p><p>Use of Proceeds We build part {p_partkey}.</p>", kind=F.when(F.col("p_partkey") % 2 == 0, "an initial public offering").otherwise("a resale"), n=F.col("p_size") + 100, hi=F.col("p_size") + 2, market=F.when(F.col("p_partkey") % 3 == 0, "NYSE American").otherwise("Nasdaq Capital Market"))
    r = disclosures.records(_dealt(s, d, "part", "p_partkey").select("p_partkey", doc.alias("content")), ["p_partkey"], "prospectus")
    return r.select("p_partkey", "mentions_ipo", "exchange", "price_range", "shares_offered", "tables")


def foreign_issuers(s, d):
    """A foreign issuer's report a customer."""
    doc = _text("<p>Our shares trade on the {market}. We {what}.</p>", market=F.when(F.col("c_nationkey") % 2 == 0, "London Stock Exchange").otherwise("Toronto Stock Exchange"), what=F.when(F.col("c_custkey") % 3 == 0, "paid a dividend after the press release").when(F.col("c_custkey") % 3 == 1, "made an acquisition").otherwise("did nothing"))
    r = disclosures.records(_dealt(s, d, "customer", "c_custkey").select("c_custkey", doc.alias("content")), ["c_custkey"], "foreign")
    return r.select("c_custkey", "exchange", F.array_join("event_signals", ",").alias("event_signals"))


def schedule13(s, d):
    """An ownership schedule a customer, with the rows of the printed cover."""
    doc = _text("<p>Part {c_custkey} Corp (Name of Issuer)</p><p>1. Name of Reporting Person: Holder {c_custkey} LP</p><p>7. Sole Voting Power: {n},000</p><p>8. Shared Voting Power: 0</p><p>9. Sole Dispositive Power: {n},000</p><p>10. Shared Dispositive Power: 5</p><p>11. Aggregate Amount Beneficially Owned by Each Reporting Person: {n},005</p><p>13. Percent of Class Represented by Amount in Row (11): {k}.5%</p><p>Item 4. Purpose of Transaction. Holder {c_custkey} means to talk to the board.</p><p>/s/ Ann Lee</p>", n=F.col("c_nationkey") + 100, k=F.col("c_nationkey") + 5)
    r = disclosures.records(_dealt(s, d, "customer", "c_custkey").select("c_custkey", doc.alias("content")), ["c_custkey"], "13d")
    return r.select("c_custkey", "filing_type", "activist_intent", "issuer_name", F.array_join("reporting_persons", "|").alias("reporting_persons"), "sole_voting_power", "shared_voting_power", "sole_dispositive_power", "shared_dispositive_power", "beneficially_owned", "percent_of_class", F.array_join("signatures", "|").alias("signatures"))


def proxy_proposals(s, d):
    """A proxy statement a supplier: a table of proposals with the board's votes."""
    row = lambda n, t, v: f"<tr><td>{n}</td><td>{t}</td><td>{v}</td></tr>"
    rows = row("No", "Proposal", "Vote") + row(1, "Election of Directors", "FOR") + row(2, "Ratify the auditor of plant {s_nationkey}", "FOR") + row(3, "Advisory vote on executive compensation", "{vote}") + row(4, "Report on item {s_suppkey}", "AGAINST")
    doc = _text(f"<p>The annual meeting is on May 5, 2024.</p><table>{rows}</table>", vote=F.when(F.col("s_suppkey") % 2 == 0, "FOR").otherwise("AGAINST"))
    r = disclosures.records(_dealt(s, d, "supplier", "s_suppkey").select("s_suppkey", doc.alias("content")), ["s_suppkey"], "proxy")
    return r.select("s_suppkey", "meeting_date", "has_say_on_pay", F.explode("proposals").alias("p")).select("s_suppkey", "meeting_date", "has_say_on_pay", "p.*")


QUERIES = {f.__name__: f for f in (inline_facts, linkbase_edges, fund_holdings, form13f_summary, sections, prospectus, foreign_issuers, schedule13, proxy_proposals)}

ORACLES = {
    "inline_facts": """SELECT o_orderkey, 0 AS pos, 'us-gaap:Revenues' AS name, 'us-gaap' AS namespace, 'Revenues' AS local_name, 'c' || o_custkey AS context_ref, 'USD' AS unit_ref, 3 AS scale, '-3' AS decimals, CASE WHEN o_orderkey % 3 = 0 THEN '-' END AS sign,
  '$' || floor(o_totalprice)::BIGINT || ',000' AS value, floor(o_totalprice) * 1000000 * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS numeric_value FROM orders
UNION ALL SELECT o_orderkey, 1, 'dei:EntityRegistrantName', 'dei', 'EntityRegistrantName', 'c0', NULL, NULL, NULL, NULL, 'A & B ' || o_orderkey, NULL FROM orders""",
    "linkbase_edges": "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, 'presentation' AS linkbase, 'role/' || n_regionkey AS role, 'parent-child' AS relationship, 'us-gaap:R' || n_regionkey AS parent, 'us-gaap:N' || n_nationkey AS child, n_nationkey::DOUBLE AS ord, 'total' AS preferred_label FROM nation",
    "fund_holdings": "SELECT o_custkey, 'Fund ' || o_custkey AS registrant, '2023-12-31' AS period_end, 1000.5::DOUBLE AS total_assets, COUNT(*) OVER (PARTITION BY o_custkey) AS holdings_count, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, 'Order ' || o_orderkey AS name, o_custkey::DOUBLE AS balance, floor(o_totalprice) AS value_usd, 'EC' AS asset_category, o_orderkey % 2 = 0 AS restricted FROM orders",
    "form13f_summary": "SELECT s_suppkey, '2024-03-31' AS report_date, '13F HOLDINGS REPORT' AS report_type, s_name AS manager, 'C' || s_nationkey AS city, 'NY' AS state, 2::BIGINT AS other_managers_count, s_suppkey AS entry_total, s_suppkey * 1000 AS value, 'Signer ' || s_suppkey AS signer, '2024-05-01' AS signature_date, 'M' || s_suppkey || '|Second & Co' AS other_managers FROM supplier",
    "sections": """WITH x AS (SELECT o_orderkey, 'Item 1. Business Item 1A. Risk Factors Item 2. Properties' || chr(10) || 'Item 1. Business We sell.' || chr(10) AS a, 'Item 1A. Risk Factors Orders such as ' || o_orderkey || ' of ' || o_orderpriority || ' may be late — or lost.' AS b FROM orders)
SELECT o_orderkey, '1A' AS item, 'Risk Factors' AS title, strlen(a) AS start_offset, strlen(a) + strlen(b) + 1 AS end_offset, left(b, 40) AS content, strlen(b) AS byte_length, 40::BIGINT AS returned_bytes, true AS truncated FROM x""",
    "prospectus": "SELECT p_partkey, p_partkey % 2 = 0 AS mentions_ipo, CASE WHEN p_partkey % 3 = 0 THEN 'NYSE American' ELSE 'Nasdaq Capital Market' END AS exchange, '$' || p_size || '.00 and $' || (p_size + 2) || '.50' AS price_range, (p_size + 100) || ',000 shares' AS shares_offered, 0 AS tables FROM part",
    "foreign_issuers": "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'London Stock Exchange' ELSE 'Toronto Stock Exchange' END AS exchange, CASE c_custkey % 3 WHEN 0 THEN 'press_release,dividend' WHEN 1 THEN 'acquisition' ELSE '' END AS event_signals FROM customer",
    "schedule13": """SELECT c_custkey, '13d' AS filing_type, true AS activist_intent, 'Part ' || c_custkey || ' Corp' AS issuer_name, 'Holder ' || c_custkey || ' LP' AS reporting_persons, (c_nationkey + 100) * 1000::DOUBLE AS sole_voting_power, 0::DOUBLE AS shared_voting_power,
  (c_nationkey + 100) * 1000::DOUBLE AS sole_dispositive_power, 5::DOUBLE AS shared_dispositive_power, (c_nationkey + 100) * 1000::DOUBLE + 5 AS beneficially_owned, c_nationkey + 5.5::DOUBLE AS percent_of_class, 'Ann Lee' AS signatures FROM customer""",
    "proxy_proposals": """SELECT s_suppkey, 'May 5, 2024' AS meeting_date, true AS has_say_on_pay, n::BIGINT AS number, category, title || CASE n WHEN 2 THEN s_nationkey::VARCHAR WHEN 4 THEN s_suppkey::VARCHAR ELSE '' END AS title, CASE WHEN n = 3 AND s_suppkey % 2 = 1 THEN 'AGAINST' ELSE vote END AS recommendation
  FROM supplier, (VALUES (1, 'director_election', 'Election of Directors', 'FOR'), (2, 'auditor_ratification', 'Ratify the auditor of plant ', 'FOR'), (3, 'say_on_pay', 'Advisory vote on executive compensation', 'FOR'), (4, 'other', 'Report on item ', 'AGAINST')) AS t(n, category, title, vote)""",
}
