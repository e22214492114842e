"""Registered queries of landed submissions, the archive and the pass over mixed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.plans.archive import archive_filings, archived_files
from filigree.plans.forms import _dealt, _table, _text
from filigree.plans.registry import parse_filings
from filigree.sources import documents
from filigree.sources.landed import land, landed_documents as read_landed
from filigree.sources.shared import shared_folder

#: Forms dealt to conversations.
FORMS = ["10-K", "8-K/A", "SC 13D"]


def _submissions(s, d):
    """A complete submission a conversation, a document a turn."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("conv_id") % 3 + 1).cast("int"))
    one = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), F.upper("role"), F.lit("\n<SEQUENCE>"), F.col("turn").cast("string"), F.lit("\n<FILENAME>t"), F.col("turn").cast("string"), F.lit(".txt\n<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    sub = _table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("x")))), lambda e: e["x"]), "").alias("x"))
    head = F.concat(F.lit("<SEC-DOCUMENT>"), F.col("conv_id").cast("string"), F.lit(".txt\n<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: "), form, F.lit("\n</SEC-HEADER>\n"))
    return sub.select(form.alias("form"), (F.col("conv_id") % 7).alias("cik"), F.col("conv_id").cast("string").alias("accession"), F.concat(head, "x", F.lit("</SEC-DOCUMENT>\n")).alias("text"))


def _landed(s, d, **only):
    """Submissions landed in the shared folder, read by ranges of 2 kB."""
    root = shared_folder(s, "landed")
    land(_submissions(s, d), root)
    return read_landed(s, root, 2048, **only)


def landed_documents(s, d):
    """Two forms of the landed submissions; files of the third are not listed."""
    docs = _landed(s, d, form=["10-K", "SC 13D"]).where("cik > 0")
    return docs.select("form", "cik", "accession", "document_type", "sequence", "filename", "content_type", "byte_length", F.md5(F.col("content").cast("binary")).alias("digest"))


def landed_order(s, d):
    """The documents of each submission in the order of their bytes."""
    docs = _landed(s, d, form=["8-K/A"])
    return docs.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_offset", "sequence"))), lambda x: x["sequence"]), ",").alias("sequences"))


def document_selected(s, d):
    """One document a filing: the primary one where there is one, else the first; cut to 60 bytes."""
    docs = _landed(s, d).withColumn("pos", F.col("file_offset"))
    return documents.document_content(docs, ["accession"], limit_bytes=60).select("accession", "sequence", "filename", "content", "byte_length", "returned_bytes", "truncated")


def document_named(s, d):
    """The document of a given name, of the filings that have it."""
    docs = _landed(s, d, filename=["t2.txt", "t3.txt"]).withColumn("pos", F.col("file_offset"))
    return documents.document_content(docs, ["accession"], filename="T2.TXT").select("accession", "sequence", "filename", "content", "returned_bytes", "truncated")


def _archive(s, d, **how):
    docs = documents.submission_documents(_submissions(s, d), ["form", "cik", "accession"])
    docs = docs.select("*", F.concat(F.lit("Company "), F.col("cik").cast("string")).alias("company"), F.lit("2024-05-01").alias("filing_date"), F.concat(F.lit("s/"), "accession").alias("source_url"), F.concat(F.lit("t/"), "accession").alias("text_url"), F.concat(F.lit("d/"), "filename").alias("document_url"))
    root = shared_folder(s, "archive")
    return root, archive_filings(docs, root, **how)


def archive_records(s, d):
    """The archive's own records, joined to what lies in its files."""
    root, filings = _archive(s, d, limit_bytes=200)
    entries = filings.select("accession", "company", "form", F.explode("documents").alias("e")).select("accession", "company", "form", F.element_at(F.split("e.path", "/"), -1).alias("name"), "e.document_type", "e.byte_length", "e.written_bytes", "e.truncated", "e.is_primary")
    files = archived_files(s, root, empty=True).select(F.col("folder").alias("accession"), "name", F.col("bytes").alias("file_bytes"), F.md5("content").alias("digest"))
    return entries.join(files, ["accession", "name"], "full")


def archive_manifest(s, d):
    """The root manifest of an archive of primary documents."""
    root, _ = _archive(s, d, primary_only=True, latest=5)
    m = s.read.option("multiLine", True).json(f"{root}/manifest.json")
    return m.select("filing_count", "document_count", "primary_only", "latest", F.explode("filings").alias("f")).select("filing_count", "document_count", "primary_only", "latest", "f.accession", "f.company", F.size("f.documents").alias("documents"))


#: A form of each family, its document's type and sequence, and its text.
MIXED = [
    ("10-K/A", "10-K/A", "1", "<h2>Other</h2><table><tr><td>a</td><td>b</td></tr></table><h2>Net sales by reportable segment {o_custkey}</h2><table><tr><th>Segment</th><th>Revenue</th></tr><tr><td>Parts</td><td>{k}</td></tr></table>"),
    ("4", "4", "7", "<XML><ownershipDocument><issuer><issuerName>Issuer {o_custkey}</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerName>o</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionAmounts><transactionShares><value>{k}</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument></XML>"),
    ("8-k", "8-K", "1", "<p>Item 2.02 Results of order {o_custkey} were good.</p><p>Item 9.01 Exhibits are {k} pages.</p>"),
    ("SC 13G", "SC 13G", "1", "<p>Part {o_custkey} Corp (Name of Issuer)</p><p>5. Sole Voting Power: {k}</p><p>Item 4. Ownership.</p>"),
    ("DEF 14A", "DEF 14A", "1", "<p>The annual meeting is on May 5, 2024 about executive compensation {k}.</p>"),
    ("424B3", "424B3", "1", "<p>We offer {n},000 shares on the New York Stock Exchange.</p>"),
    ("6-K", "6-K", "1", "<p>Traded on the London Stock Exchange, a dividend of {k} was declared.</p>"),
    ("NPORT-P", "NPORT-P", "1", "<edgarSubmission><regName>Fund {o_custkey}</regName><totAssets>{k}</totAssets></edgarSubmission>"),
    ("13F-HR", "INFORMATION TABLE", "2", "<informationTable><infoTable><nameOfIssuer>A</nameOfIssuer><cusip>C{o_custkey}</cusip><value>{k}</value></infoTable><infoTable><nameOfIssuer>B</nameOfIssuer><cusip>D{o_custkey}</cusip><value>1</value></infoTable></informationTable>"),
    ("10-D", "10-D", "1", "no parser reads {k}"),
    ("13F-HR/A", "13F-HR/A", "1", "the cover without a table {k}"),
    ("5", "5", "1", "<ownershipDocument><broken {k}"),
]


def mixed_forms(s, d):
    """All families of forms dealt to orders, parsed in one pass into variant records."""
    o = _dealt(s, d, "orders", "o_orderkey").withColumn("_i", (F.col("o_orderkey") % len(MIXED)).cast("int"))
    pick = lambda at: F.element_at(F.array(*[F.lit(m[at]) for m in MIXED]), F.col("_i") + 1)
    content = F.coalesce(*[F.when(F.col("_i") == i, _text(m[3], k=F.floor("o_totalprice"), n=F.col("o_custkey") + 100)) for i, m in enumerate(MIXED)])
    docs = o.select("o_orderkey", pick(0).alias("form"), pick(1).alias("document_type"), pick(2).alias("sequence"), content.alias("content"))
    r = parse_filings(docs, ["o_orderkey"])
    name = F.coalesce(*[F.try_variant_get("record", f"$.{p}", "string") for p in ("topic", "issuer_name", "item", "meeting_date", "exchange", "registrant", "cusip")])
    amount = F.coalesce(*[F.try_variant_get("record", f"$.{p}", "double") for p in ("confidence", "shares", "sole_voting_power", "total_assets", "value")])
    return r.select("o_orderkey", "kind", "pos", name.alias("name"), amount.alias("amount"), F.col("error").startswith("ValueError: malformed XML").alias("failed"))


QUERIES = {f.__name__: f for f in (landed_documents, landed_order, document_selected, document_named, archive_records, archive_manifest, mixed_forms)}

_TURNS = r"""WITH t AS (SELECT conv_id, conv_id::VARCHAR AS accession, conv_id % 7 AS cik, CASE conv_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K/A' ELSE 'SC 13D' END AS form, turn, upper(role) AS document_type, turn::VARCHAR AS sequence, 't' || turn || '.txt' AS filename,
  regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS content FROM conversations) """
_CUT = "CASE WHEN strlen(content) <= {n} THEN content ELSE substr(content, 1, list_max(list_filter(range(0, {n} + 1), lambda i: strlen(substr(content, 1, i)) <= {n}))) END"

ORACLES = {
    "landed_documents": _TURNS + "SELECT form, cik, accession, document_type, sequence, filename, 'text' AS content_type, strlen(content) AS byte_length, md5(content) AS digest FROM t WHERE form <> '8-K/A' AND cik > 0",
    "landed_order": _TURNS + "SELECT accession, string_agg(sequence, ',' ORDER BY turn, document_type) AS sequences FROM t WHERE form = '8-K/A' GROUP BY 1",
    "document_selected": _TURNS + f", one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY accession ORDER BY sequence <> '1', turn) = 1), c AS (SELECT *, {_CUT.format(n=60)} AS short FROM one) SELECT accession, sequence, filename, short AS content, strlen(content) AS byte_length, strlen(short) AS returned_bytes, strlen(short) < strlen(content) AS truncated FROM c",
    "document_named": _TURNS + "SELECT accession, sequence, filename, content, strlen(content) AS returned_bytes, false AS truncated FROM t WHERE filename = 't2.txt'",
    "archive_records": _TURNS + f", p AS (SELECT *, {_CUT.format(n=200)} AS short, row_number() OVER (PARTITION BY accession ORDER BY turn) AS pos FROM t) SELECT accession, lpad(pos::VARCHAR, 3, '0') || '-' || sequence || '-' || filename AS name, 'Company ' || cik AS company, form, document_type, strlen(content) AS byte_length, strlen(short) AS written_bytes, strlen(short) < strlen(content) AS truncated, sequence = '1' AS is_primary, strlen(short) AS file_bytes, md5(short) AS digest FROM p",
    "archive_manifest": _TURNS + "SELECT (SELECT COUNT(DISTINCT accession) FROM t WHERE sequence = '1') AS filing_count, (SELECT COUNT(*) FROM t WHERE sequence = '1') AS document_count, true AS primary_only, 5::BIGINT AS latest, accession, 'Company ' || cik AS company, COUNT(*)::INT AS documents FROM t WHERE sequence = '1' GROUP BY accession, cik",
    "mixed_forms": """WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS i, o_custkey::VARCHAR AS c, floor(o_totalprice)::DOUBLE AS k FROM orders)
SELECT o_orderkey, kind, pos, CASE i WHEN 0 THEN 'segment_revenue' WHEN 1 THEN 'Issuer ' || c WHEN 2 THEN CASE pos WHEN 0 THEN '2.02' ELSE '9.01' END WHEN 3 THEN 'Part ' || c || ' Corp' WHEN 4 THEN 'May 5, 2024' WHEN 5 THEN 'New York Stock Exchange' WHEN 6 THEN 'London Stock Exchange' WHEN 7 THEN 'Fund ' || c WHEN 8 THEN CASE pos WHEN 0 THEN 'C' ELSE 'D' END || c END AS name,
  CASE i WHEN 0 THEN 0.875 WHEN 1 THEN k WHEN 3 THEN k WHEN 7 THEN k WHEN 8 THEN CASE pos WHEN 0 THEN k ELSE 1 END END::DOUBLE AS amount, CASE WHEN i = 11 THEN true END AS failed
FROM o JOIN (VALUES (0, 'company_report', 1), (1, 'form4_transaction', 0), (2, 'eightk_event', 0), (2, 'eightk_event', 1), (3, 'schedule13', 0), (4, 'proxy_statement', 0), (5, 'prospectus', 0), (6, 'foreign_issuer', 0), (7, 'fund_disclosure', 0), (8, 'thirteenf_holding', 0), (8, 'thirteenf_holding', 1), (11, 'form4_transaction', NULL)) AS t(f, kind, pos) ON i = f""",
}
