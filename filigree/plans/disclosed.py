"""Registered queries of narrative filings in several shapes: notices, headings, excerpts, exhibits, snippets, sections, fund votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions import texts
from filigree.operators import disclosures
from filigree.plans.forms import _dealt, _joined, _table, _text
from filigree.sources import xmlforms
from filigree.sources.documents import of_type, submission_documents
from filigree.sources.parse import parsed


def _shape(key: str, shapes: list[str], **cols: Column) -> Column:
    """One of several texts by a key's remainder."""
    k = F.col(key) % len(shapes)
    return F.coalesce(*[F.when(k == i, _text(s, **cols)) for i, s in enumerate(shapes)])


#: A notice with votes, headings with votes in sentences, and a statement without proposals.
PROXIES = [
    "<p>Notice of Annual Meeting. The annual meeting will be held on June {day}, 2024. The record date is April 2, 2024. Items of business 1 Election of Directors: Ann Lee, Bo Chen and Cy Roe FOR 2 Ratify the auditor of {c_mktsegment} FOR 3 Adopt an equity plan AGAINST Other business may come.</p><p>Audited by KPMG LLP.</p>",
    "<p>Proposal 1: Election of Directors. The Board recommends that you vote FOR Proposal 1, as ever.</p><p>Proposal No. 2: Shareholder report on plant {c_nationkey}; text. We recommend that you vote AGAINST Proposal 2, as before.</p><table><tr><th>Name</th><th>Salary</th><th>Total</th></tr><tr><td>Jane Roe Chief</td><td>1</td><td>{c_custkey}</td></tr></table>",
    "<p>The annual meeting is held by customer {c_custkey}.</p>",
]


def proxy_shapes(s, d):
    """Proposals, people and dates of proxies of three shapes."""
    c = _dealt(s, d, "customer", "c_custkey")
    doc = c.select("c_custkey", _shape("c_custkey", PROXIES, day=F.col("c_nationkey") + 1).alias("content"))
    r = disclosures.records(doc, ["c_custkey"], "proxy")
    shown = F.array_join(F.transform("proposals", lambda p: F.concat_ws("/", p["number"].cast("string"), p["category"], p["title"], F.coalesce(p["recommendation"], F.lit("-")))), "; ")
    return r.select("c_custkey", "meeting_date", "record_date", shown.alias("proposals"), F.array_join("director_nominees", "|").alias("nominees"), F.array_join("named_executives", "|").alias("executives"), "auditor", "has_say_on_pay")


_PAD = "This registration statement is not yet complete and may be changed; please read it with care before you buy any part of it. "
PROSPECTUSES = [
    _PAD + "<p>Our Class B common stock trades under the symbol \"P{p_partkey}\". The aggregate offering price is up to ${p_size},500.25 for it.</p><table><tr><td>other</td></tr></table><p>Use of Proceeds We spend it on part {p_partkey} and more.</p><p>Risk Factors Sales may fall — é.</p><p>Underwriting Goldman Sachs and Jefferies.</p><table><tr><th>Use of proceeds</th><th>Amount</th></tr><tr><td>Plant</td><td>{p_size}</td></tr></table>",
    "Risk Factors early and short. " + _PAD + "<p>We offer notes due 2031 and preferred stock.</p><p>Dilution You lose ${p_size} a share at once.</p>",
]


def prospectus_parts(s, d):
    """Excerpts, amounts, underwriters and relevant tables of prospectuses of two shapes."""
    doc = _dealt(s, d, "part", "p_partkey").select("p_partkey", _shape("p_partkey", PROSPECTUSES).alias("content"))
    r = disclosures.records(doc, ["p_partkey"], "prospectus")
    return r.select("p_partkey", "proposed_ticker", "offering_amount", F.array_join("securities_offered", "|").alias("securities"), F.array_join("underwriters", "|").alias("underwriters"), "tables", F.col("use_of_proceeds.content").alias("proceeds"), F.col("risk_factors.content").alias("risks"), F.col("risk_factors.byte_length").alias("risk_bytes"), F.col("dilution.content").alias("dilution"), F.col("business").isNull().alias("no_business"))


FOREIGN = [
    _PAD + "<p>Ticker symbol: F{c_custkey} on the London Stock Exchange. Audited by Deloitte LLP.</p><p>Operating and Financial Review Sales of customer {c_custkey} grew.</p><p>Controls and Procedures They work well.</p><p>Item 19 Exhibits</p>",
    _PAD + "<p>Management's Discussion and Analysis Nation {c_nationkey} did well.</p><p>Financial Statements Follow here now.</p>",
]


def foreign_parts(s, d):
    """Excerpts of foreign issuers' reports of two shapes."""
    doc = _dealt(s, d, "customer", "c_custkey").select("c_custkey", _shape("c_custkey", FOREIGN).alias("content"))
    r = disclosures.records(doc, ["c_custkey"], "foreign")
    return r.select("c_custkey", "symbol", "auditor", F.col("operating_review.content").alias("review"), F.col("operating_review.title").alias("review_title"), F.col("controls.content").alias("controls"), F.col("financial_statements.returned_bytes").alias("statement_bytes"), F.col("risk_factors").isNull().alias("no_risks"))


def exhibits_8k(s, d):
    """Exhibits of one submission a customer: texts, categories and whether they are furnished."""
    doc = _text("<DOCUMENT>\n<TYPE>8-K\n<SEQUENCE>1\n<TEXT>Item 8.01 Other</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99.1\n<SEQUENCE>2\n<FILENAME>r{c_custkey}.htm\n<DESCRIPTION>Quarter results\n<TEXT><p>Sales &amp; profit of {c_custkey} rose</p></TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-10.1\n<SEQUENCE>3\n<FILENAME>a.htm\n<TEXT>Lease {c_nationkey}</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-101.INS\n<SEQUENCE>4\n<FILENAME>x.xml\n<TEXT><a/></TEXT>\n</DOCUMENT>\n")
    docs = submission_documents(_dealt(s, d, "customer", "c_custkey").select("c_custkey", doc.alias("text")), ["c_custkey"])
    return disclosures.eightk_exhibits(docs, limit_bytes=12).select("c_custkey", "sequence", "document_type", "category", "is_furnished", "content", "byte_length", "truncated")


def typed_documents(s, d):
    """Documents of one type, in any case, with what they hold."""
    doc = _text("<document>\n<type>10-k\n<sequence>1\n<text>{c_custkey}</text>\n</document>\n<DOCUMENT>\n<TYPE>EX-21\n<SEQUENCE>2\n<TEXT>sub {c_nationkey}</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-21\n<SEQUENCE>3\n<TEXT>open")
    docs = submission_documents(_dealt(s, d, "customer", "c_custkey").select("c_custkey", doc.alias("text")), ["c_custkey"])
    return of_type(docs, "ex-21").unionByName(of_type(docs, "10-K")).select("c_custkey", "pos", "document_type", "sequence", "content")


def search_snippets(s, d):
    """Places of a phrase with what stands around them and the item that they stand in."""
    doc = _text("Item 1. Business\nof part {p_partkey}\n<b>Item 7. Discussion of {p_brand}</b> where net sales rose and <i title='net sales'>again</i> NET SALES of {p_size} fell")
    docs = _dealt(s, d, "part", "p_partkey").select("p_partkey", doc.alias("content"))
    return parsed(docs, ["p_partkey"], "content", lambda t: texts.search(t, "net sales", 14), texts.SEARCH).select("p_partkey", "snippet", "section", (F.col("offset") > 60).alias("late"))


#: Sections by name, each with the text that its document holds.
_REPORT = "Item 1. Business Item 1A. Risk Factors Item 2. Properties Item 7. Management's Discussion and Analysis Item 8. Financial Statements Item 9. Changes\nItem 1. Business We make {p_name}.\nItem 1A. Risk Factors None of {p_size}.\nItem 2. Properties A plant.\nItem 3. Legal Proceedings No suits.\nItem 4. Mine Safety None.\nItem 7. Management's Discussion and Analysis Sales of {p_partkey} rose.\nItem 7A. Market Risk Little.\nItem 8. Financial Statements Follow é.\nItem 9. Changes None."


def all_sections(s, d):
    """Seven sections of an annual report by their various names."""
    names = ["business", "risk", "Legal Proceedings", "mda", "7A", "financial_statements", "cybersecurity"]
    docs = _dealt(s, d, "part", "p_partkey").select("p_partkey", _text(_REPORT).alias("content"))
    return parsed(docs, ["p_partkey"], "content", lambda t: [x for n in names for x in texts.section(t, n)], texts.SECTION).select("p_partkey", "item", "title", "content", "byte_length", "truncated")


def fund_votes(s, d):
    """Votes of a fund report a nation, and the first two of its holdings."""
    vote = _text("<proxyTable><issuerName>Issuer {s_suppkey}</issuerName><meetingDate>2024-05-0{m}</meetingDate><voteCast>{v}</voteCast><sharesVoted>{s_suppkey}</sharesVoted></proxyTable><invstOrSec><name>H{s_suppkey}</name><valUSD>{s_suppkey}</valUSD></invstOrSec>", m=F.col("s_suppkey") % 9 + 1, v=F.when(F.col("s_suppkey") % 2 == 0, "FOR").otherwise("AGAINST"))
    docs = _joined(_table(s, d, "supplier"), "s_nationkey", "s_suppkey", vote, "<edgarSubmission><registrantName>Nation {s_nationkey}</registrantName>", "</edgarSubmission>")
    r = parsed(docs, ["s_nationkey"], "content", lambda t: xmlforms.fund_report(t, 2), xmlforms.FUND)
    return r.select("s_nationkey", "registrant", "holdings_count", "votes_count", F.array_join(F.transform("holdings", lambda h: h["name"]), "|").alias("held"), F.explode("proxy_votes").alias("v")).select("s_nationkey", "registrant", "holdings_count", "votes_count", "held", "v.issuer", "v.meeting_date", "v.vote", F.col("v.shares").alias("shares"))


def disclosure_types(s, d):
    """Labels of forms: kinds of prospectuses and foreign reports, and whether an offering is the first."""
    form = F.element_at(F.array(*[F.lit(f) for f in ("424B4", "F-1/A", "S-1", "6-K", "40-F/A", "20-F")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _table(s, d, "orders").select("o_orderkey", disclosures.prospectus_type(form).alias("prospectus"), disclosures.foreign_type(form).alias("foreign"), disclosures.is_ipo_related(form, F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 4 == 0)).alias("ipo"))


QUERIES = {f.__name__: f for f in (proxy_shapes, prospectus_parts, foreign_parts, exhibits_8k, typed_documents, search_snippets, all_sections, fund_votes, disclosure_types)}

_PADDED = "'Use of Proceeds We spend it on part ' || p_partkey || ' and more.'"

ORACLES = {
    "proxy_shapes": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'June ' || (c_nationkey + 1) || ', 2024' END AS meeting_date, CASE c_custkey % 3 WHEN 0 THEN 'April 2, 2024' END AS record_date,
  CASE c_custkey % 3 WHEN 0 THEN '1/director_election/Election of Directors/FOR; 2/auditor_ratification/Ratify the auditor of ' || c_mktsegment || '/FOR; 3/equity_plan/Adopt an equity plan/AGAINST'
    WHEN 1 THEN '1/director_election/Election of Directors/FOR; 2/shareholder_proposal/Shareholder report on plant ' || c_nationkey || '/AGAINST' ELSE '' END AS proposals,
  CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee|Bo Chen|Cy Roe' ELSE '' END AS nominees, CASE c_custkey % 3 WHEN 1 THEN 'Jane Roe' ELSE '' END AS executives, CASE c_custkey % 3 WHEN 0 THEN 'KPMG LLP' END AS auditor, false AS has_say_on_pay FROM customer""",
    "prospectus_parts": f"""WITH x AS (SELECT *, p_partkey % 2 = 0 AS a FROM part) SELECT p_partkey, CASE WHEN a THEN 'P' || p_partkey END AS proposed_ticker, CASE WHEN a THEN '$' || p_size || ',500.25' END AS offering_amount, CASE WHEN a THEN 'Class B common stock|common stock' ELSE 'preferred stock|notes due 2031' END AS securities,
  CASE WHEN a THEN 'Goldman Sachs|Jefferies' ELSE '' END AS underwriters, a::INT AS tables, CASE WHEN a THEN {_PADDED} END AS proceeds, CASE WHEN a THEN 'Risk Factors Sales may fall — é.' END AS risks, CASE WHEN a THEN 35::BIGINT END AS risk_bytes, CASE WHEN NOT a THEN 'Dilution You lose $' || p_size || ' a share at once.' END AS dilution, true AS no_business FROM x""",
    "foreign_parts": """WITH x AS (SELECT *, c_custkey % 2 = 0 AS a FROM customer) SELECT c_custkey, CASE WHEN a THEN 'F' || c_custkey END AS symbol, CASE WHEN a THEN 'Deloitte LLP' END AS auditor, CASE WHEN a THEN 'Operating and Financial Review Sales of customer ' || c_custkey || ' grew.' ELSE 'Management''s Discussion and Analysis Nation ' || c_nationkey || ' did well.' END AS review,
  CASE WHEN a THEN 'Operating and Financial Review' ELSE 'Management''s Discussion and Analysis' END AS review_title, CASE WHEN a THEN 'Controls and Procedures They work well.' END AS controls, CASE WHEN NOT a THEN 37::BIGINT END AS statement_bytes, true AS no_risks FROM x""",
    "exhibits_8k": """SELECT c_custkey, sequence, document_type, category, sequence = '2' AS is_furnished, left(t, 12) AS content, length(t)::BIGINT AS byte_length, length(t) > 12 AS truncated FROM (SELECT c_custkey, sequence, document_type, category, CASE sequence WHEN '2' THEN 'Sales & profit of ' || c_custkey || ' rose' WHEN '3' THEN 'Lease ' || c_nationkey ELSE '' END AS t
  FROM customer, (VALUES ('2', 'EX-99.1', 'earnings_release'), ('3', 'EX-10.1', 'material_contract'), ('4', 'EX-101.INS', 'xbrl')) AS v(sequence, document_type, category))""",
    "typed_documents": "SELECT c_custkey, 0 AS pos, '10-k' AS document_type, '1' AS sequence, c_custkey::VARCHAR AS content FROM customer UNION ALL SELECT c_custkey, 1, 'EX-21', '2', 'sub ' || c_nationkey FROM customer",
    "search_snippets": "SELECT p_partkey, CASE k WHEN 0 THEN right(p_brand, 3) || ' where net sales rose and' WHEN 1 THEN 'and again NE' ELSE 'again NET SALES of ' || p_size || ' fell' END AS snippet, 'Item 7. Discussion of ' || p_brand AS section, true AS late FROM part, (SELECT unnest([0, 1, 2]) AS k)",
    "all_sections": """SELECT p_partkey, item, title, content, strlen(content) AS byte_length, false AS truncated FROM (SELECT p_partkey, item, title, CASE item WHEN '1' THEN 'Item 1. Business We make ' || p_name || '.' WHEN '1A' THEN 'Item 1A. Risk Factors None of ' || p_size || '.' WHEN '7' THEN 'Item 7. Management''s Discussion and Analysis Sales of ' || p_partkey || ' rose.' ELSE body END AS content
  FROM part, (VALUES ('1', 'Business', NULL), ('1A', 'Risk Factors', NULL), ('3', 'Legal Proceedings', 'Item 3. Legal Proceedings No suits.'), ('7', 'Management''s Discussion and Analysis', NULL), ('7A', 'Quantitative and Qualitative Disclosures About Market Risk', 'Item 7A. Market Risk Little.'), ('8', 'Financial Statements and Supplementary Data', 'Item 8. Financial Statements Follow é.')) AS v(item, title, body))""",
    "fund_votes": """WITH h AS (SELECT s_nationkey, string_agg('H' || s_suppkey, '|' ORDER BY s_suppkey) AS held, count(*) AS kept FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2) GROUP BY 1)
SELECT s_nationkey, 'Nation ' || s_nationkey AS registrant, kept AS holdings_count, count(*) OVER (PARTITION BY s_nationkey) AS votes_count, held, 'Issuer ' || s_suppkey AS issuer, '2024-05-0' || (s_suppkey % 9 + 1) AS meeting_date, CASE WHEN s_suppkey % 2 = 0 THEN 'FOR' ELSE 'AGAINST' END AS vote, s_suppkey::DOUBLE AS shares FROM supplier JOIN h USING (s_nationkey)""",
    "disclosure_types": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'final_or_supplemental_prospectus' WHEN 1 THEN 'foreign_issuer_registration' ELSE 'registration_statement' END AS prospectus, CASE o_orderkey % 6 WHEN 3 THEN 'foreign_private_issuer_current_report' WHEN 4 THEN 'canadian_annual_report' ELSE 'foreign_private_issuer_annual_report' END AS "foreign",
  o_orderkey % 6 IN (1, 2) OR o_custkey % 4 = 0 AS ipo FROM orders""",
}
