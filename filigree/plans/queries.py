"""The registered queries: operators over domain inputs made from the whole star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import scalars as X
from filigree.functions import texts
from filigree.functions.catalogue import EIGHTK_CATEGORIES, EIGHTK_ITEMS, FORM_FAMILIES, statement_lines
from filigree.functions.predicates import known_item
from filigree.operators import disclosures, holdings, insiders, names, trees
from filigree.plans.metrics import financial_metrics
from filigree.plans.scores import health_scores
from filigree.plans.statements import facts, financial_statements, stitched_statements
from filigree.sources import adapters, documents, filings, xmlforms
from filigree.sources.parse import parsed
from filigree.streaming.daily import window_counts


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _filings(s, d):
    return adapters.run(s, d, adapters.FILINGS)


def filings_latest(s, d):
    rows = filings.filings(_filings(s, d), latest=3, order=[F.col("filing_date").desc(), F.col("pos")])
    return rows.select("cik", "accession", "form", "filing_date", X.text_url(F.col("cik"), F.col("accession")).alias("text_url"))


def filings_form_amend(s, d):
    return filings.filings(_filings(s, d), form="10-k", amendments=True).select("cik", "accession", "form", "filing_date")


def filings_date_range(s, d):
    return filings.filings(_filings(s, d), start="1996-03-01", end="1997-02-28").select("cik", "accession", "form", "filing_date")


def daily_company_filter(s, d):
    f = _filings(s, d)
    line = F.concat_ws("|", F.col("cik").cast("string"), "company", "form", "filing_date", F.concat(F.lit("edgar/data/"), F.col("cik").cast("string"), F.lit("/0-"), "accession", F.lit(".txt")))
    rows = filings.daily_index(f.select(line.alias("value")).union(s.sql("SELECT * FROM VALUES ('CIK|Company Name|Form Type|Date Filed|Filename'), ('-----'), ('1|a|b|c')")))
    return filings.daily_filings(rows, form="8-K", company="customer#00000001", amendments=True).select("cik", "company", "form", "filing_date", "accession", "filename")


def merge_distinct(s, d):
    f = _filings(s, d).select("cik", "accession", "form", "filing_date")
    return filings.merge_distinct(f.where("form LIKE 'SC 13D%' OR form LIKE '8-K%'"), f.where("form LIKE 'SC 13D%' OR form LIKE '10-Q%'"))


def submissions_json(s, d):
    """Filings by way of the parallel arrays of a submissions document a company."""
    f = _filings(s, d)
    arrays = F.array_sort(F.collect_list(F.struct("pos", "accession", "form", "filing_date")))
    doc = f.groupBy("cik", "company").agg(arrays.alias("r"))
    col = lambda c: F.transform("r", lambda x: x[c].cast("string"))
    js = F.to_json(F.struct(F.col("company").alias("name"), F.struct(F.struct(col("accession").alias("accessionNumber"), col("form").alias("form"), col("filing_date").alias("filingDate"), F.transform("r", lambda x: F.lit("")).alias("reportDate"), F.transform("r", lambda x: (x["pos"] % 2).cast("string")).alias("isXBRL")).alias("recent")).alias("filings")))
    return filings.submissions(doc.select("cik", js.alias("json"))).select("cik", "company", "accession", "form", "filing_date", "report_date", "is_xbrl", F.col("pos").cast("int").alias("pos"))


def company_facts_json(s, d):
    """Facts by way of the nested maps of a company facts document."""
    f = adapters.facts(s, d)
    unit = f.groupBy("cik", "concept").agg(F.array_sort(F.collect_list(F.struct(F.col("filed"), F.col("accession").alias("accn"), F.col("numeric_value").cast("long").alias("val"), "fy", "fp", "form", "end"))).alias("rows"))
    one = unit.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.lit("x").alias("label"), F.create_map(F.lit("USD"), F.col("rows")).alias("units"))))).alias("m"))
    js = F.to_json(F.struct(F.lit("c").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts")))
    return filings.company_facts(one.select("cik", js.alias("json"))).select("cik", "taxonomy", "concept", "unit", "numeric_value", "fy", "form", "filed", "end", "accession")


def facts_by_alias(s, d):
    return facts(adapters.facts(s, d), concept="us-gaap:Revenue").select("cik", "concept", "numeric_value", "form", "filed", "end", "fact_id")


def facts_topk(s, d):
    return facts(adapters.facts(s, d), concept="liabilities", unit="usd", form="10-K", latest=3).select("cik", "concept", "numeric_value", "form", "filed", "end", "accession")


def statement_lines_priority(s, d):
    return financial_statements(adapters.facts(s, d), "income", form="10-K", latest=100).select("cik", "line_item", "line_order", "concept", "numeric_value", "form", "filed", "end")


def statement_topk(s, d):
    return financial_statements(adapters.facts(s, d), latest=2).select("cik", "statement", "line_item", "line_order", "concept", "numeric_value", "form", "filed", "end")


def stitch_best_form(s, d):
    df = stitched_statements(adapters.facts(s, d), latest=4)
    return df.select("cik", "statement", "line_item", "end", "form", "filed", "numeric_value", "period_kind", F.array_join("duplicate_forms", ",").alias("duplicate_forms"), "source_count")


def metrics_long(s, d):
    return financial_metrics(adapters.facts(s, d), latest=4).select("cik", "period_end", "metric", "unit", F.round("value", 9).alias("value"))


def scores(s, d):
    df = health_scores(adapters.facts(s, d), latest=4)
    passed = F.aggregate("signals", F.lit(0), lambda a, x: a + F.coalesce(x["passed"].cast("int"), F.lit(0)))
    return df.select("cik", "period_end", "score_name", F.round("score", 8).alias("score"), "rating", F.when(F.col("score_name") == "piotroski_f_score", passed).alias("passed"))


def source_urls(s, d):
    f = financial_statements(adapters.facts(s, d), "income", latest=3)
    return f.groupBy("cik").agg(F.array_join(F.array_sort(F.collect_set("source_url")), "|").alias("urls"))


def holdings_scaled(s, d):
    h = adapters.run(s, d, adapters.HOLDINGS).withColumn("report_date", F.when(F.col("report_date") < "1998", F.col("report_date")).when(F.col("report_date") < "2000", F.lit("2022-12-31")))
    return holdings.scaled(h).groupBy("cik", "value_scale").agg(F.sum("value_usd").alias("value_usd"), F.count("*").alias("n"))


def _aggregated(s, d):
    h = holdings.scaled(adapters.run(s, d, adapters.HOLDINGS))
    return holdings.aggregate(h)


def holdings_aggregate(s, d):
    return _aggregated(s, d).select("cik", "accession", "cusip", "class", "put_call", "value_usd", "shares", "row_count", "report_date")


def holdings_diff(s, d):
    df = holdings.newest_changes(_aggregated(s, d))
    return df.select("cik", "cusip", "class", "put_call", "change_type", "value_usd", "previous_value_usd", F.col("value_change").cast("long").alias("value_change"), "shares", "previous_shares", "share_change")


def thirteenf_xml(s, d):
    """Holdings by way of one information table document a report."""
    h = adapters.run(s, d, adapters.HOLDINGS)
    tag = lambda t, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{t}>"), F.col(c).cast("string"), F.lit(f"</{t}>"))).otherwise(F.lit(""))
    one = F.concat(F.lit("<n1:infoTable>"), tag("nameOfIssuer", "cusip"), tag("titleOfClass", "class"), tag("cusip", "cusip"), tag("value", "value"), F.lit("<shrsOrPrnAmt>"), tag("sshPrnamt", "shares"), F.lit("<sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt>"), tag("putCall", "put_call"), F.lit("</n1:infoTable>"))
    docs = h.groupBy("cik", "accession").agg(F.concat(F.lit('<n1:informationTable xmlns:n1="http://x">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda e: e["x"]), ""), F.lit("</n1:informationTable>")).alias("content"))
    return xmlforms.parse_column(docs, ["cik", "accession"], "holdings").groupBy("cik", "accession", "class", "put_call").agg(F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.count("*").alias("n"))


def insider_transactions(s, d):
    return insiders.transactions(adapters.run(s, d, adapters.INSIDERS)).select("owner", "pos", "code", "transaction_type", "shares", "price", "value", "derivative")


def insider_summary(s, d):
    return insiders.summary(adapters.run(s, d, adapters.INSIDERS), ["owner"])


def form4_xml(s, d):
    """Transactions by way of one ownership document an owner."""
    t = adapters.run(s, d, adapters.INSIDERS)
    v = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{n}><value>"), F.col(c).cast("string"), F.lit(f"</value></{n}>"))).otherwise(F.lit(""))
    one = F.concat(F.lit("<nonDerivativeTransaction><transactionCoding><transactionCode>"), "code", F.lit("</transactionCode></transactionCoding><transactionAmounts>"), v("transactionShares", "shares"), v("transactionPricePerShare", "price"), v("transactionAcquiredDisposedCode", "acquired_disposed"), F.lit("</transactionAmounts></nonDerivativeTransaction>"))
    docs = t.groupBy("owner").agg(F.concat(F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>o</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda e: e["x"]), ""), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("content"))
    p = xmlforms.parse_column(docs, ["owner"], "form4")
    return insiders.summary(p, ["owner"]).select("owner", "transaction_count", "purchase_count", "sale_count", "acquired_shares", "disposed_shares", "net_shares", "net_value")


def tree_roots(s, d):
    return trees.roots(adapters.run(s, d, adapters.EDGES), ["role"]).select("role", "node")


def _tree(s, d):
    return trees.preorder(adapters.run(s, d, adapters.EDGES), ["role"])


def tree_preorder(s, d):
    return _tree(s, d).select("node", "parent", F.col("depth").cast("int").alias("depth"), F.col("line_order").cast("long").alias("line_order"), "path")


def _checks(s, d):
    return trees.calculation_checks(adapters.run(s, d, adapters.EDGES), adapters.run(s, d, adapters.NODE_VALUES), ["role"], tolerance=0.5)


_CHECK = ["parent", "parent_value", "calculated_value", "difference", "child_count", "matched_children", "status"]


def calc_checks(s, d):
    return trees.calculation_checks(adapters.run(s, d, adapters.EDGES).withColumn("_by", F.lit(0)), adapters.run(s, d, adapters.NODE_VALUES).withColumn("_by", F.lit(0)).drop("role"), ["_by"], tolerance=0.5).select(*_CHECK, F.size("missing_children").alias("missing"))


def statement_render(s, d):
    values = adapters.run(s, d, adapters.NODE_VALUES).drop("role").withColumn("_by", F.lit(0))
    edges = adapters.run(s, d, adapters.EDGES).withColumn("_by", F.lit(0))
    checks = trees.calculation_checks(edges, values, ["_by"], tolerance=0.5)
    tree = trees.preorder(edges, ["_by"])
    v = values.select("*", F.lit("USD").alias("unit"), F.concat(F.lit("L "), "concept").alias("label"), F.lit(0).alias("pos"))
    return trees.render(tree, v, checks, None, ["_by"]).select("node", F.col("depth").cast("int").alias("depth"), "label", "value", "unit", "calculation_status")


def search_exact(s, d):
    found = texts.may_match(F.col("text"), "in the")
    return parsed(_table(s, d, "documents").where(found), ["doc_id"], "text", lambda t: texts.search(t, "in the", 40, exact=True), texts.SEARCH).groupBy("doc_id").agg(F.count("*").alias("matches"), F.min("offset").alias("first"))


def search_token_window(s, d):
    docs = _table(s, d, "documents").where(texts.may_match(F.col("text"), "that, with") | texts.may_match_words(F.col("text"), "that, with"))
    return parsed(docs, ["doc_id"], "text", lambda t: texts.search(t, "that, with", 100), texts.SEARCH).select("doc_id", "offset")


def text_truncate(s, d):
    t = F.col("text")
    cut = X.truncate_utf8(t, 101)
    return _table(s, d, "documents").select("doc_id", F.octet_length(t).alias("byte_length"), cut.alias("content"), (F.octet_length(cut) < F.octet_length(t)).alias("truncated"))


def plain_text(s, d):
    p = X.plain_text(F.col("html"))
    return _table(s, d, "pages").select("page_id", F.md5(p.cast("binary")).alias("digest"), F.length(p).alias("chars"))


def html_tables(s, d):
    """Tables by way of one HTML page a region."""
    n = _table(s, d, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td></td><td>"), "n_name", F.lit("</td></tr>"))
    page = n.groupBy("n_regionkey").agg(F.concat(F.lit("<h2>All nations</h2><table></table><table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("x")))), lambda e: e["x"]), ""), F.lit("</table>")).alias("content"))
    t = parsed(page, ["n_regionkey"], "content", texts.tables, texts.TABLES)
    return t.select("n_regionkey", "table_index", "row_count", "column_count", "title_hint", F.array_join(F.transform(F.filter("rows", lambda r, i: i > 0), lambda r: r[1]), ",").alias("names"))


def topic_argmax(s, d):
    p = _table(s, d, "part").withColumn("words", F.concat_ws(" ", "p_name", F.element_at(F.array(*[F.lit(w) for w in TOPIC_WORDS]), (F.col("p_partkey") % len(TOPIC_WORDS) + 1).cast("int")), F.element_at(F.array(*[F.lit(w) for w in TOPIC_WORDS]), (F.col("p_size") % len(TOPIC_WORDS) + 1).cast("int"))))
    t = p.select("p_partkey", F.col("words").alias("title_hint"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"))
    return disclosures.company_topics(t).select("p_partkey", "topic", "confidence")


#: Words that make topics out of parts.
TOPIC_WORDS = ["business segment sales", "china net sales", "product revenue by", "debt maturities thereafter", "commitments payments due", "leases future minimum", "treasury stock shares", "income tax rate", "plain"]


def exhibit_category(s, d):
    o = _table(s, d, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in EXHIBITS]), (F.col("o_orderkey") % len(EXHIBITS) + 1).cast("int"))
    return o.select("o_orderkey", disclosures.exhibit_category(kind, F.col("o_orderpriority"), F.when(F.col("o_custkey") % 5 == 0, "q2-results.htm").when(F.col("o_custkey") % 5 == 1, "press release.htm"), True).alias("category"))


#: Exhibit types dealt to orders.
EXHIBITS = ["EX-99.1", "EX-10.1", "EX-2.1", "EX-3.1", "EX-4.1", "EX-16.1", "EX-101.INS", "EX-21", "GRAPHIC"]


def eightk_events(s, d):
    """Events by way of one current report a customer: a contents list, then bodies."""
    f = _filings(s, d).withColumn("item", F.element_at(F.array(*[F.lit(i) for i in EIGHTK_ITEMS]), (F.col("pos") % len(EIGHTK_ITEMS) + 1).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "item")))
    doc = f.groupBy("cik").agg(parts.alias("p")).select("cik", F.concat(F.lit("<html><p>"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("Item "), x["item"])), " "), F.lit("</p>"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("<p>Item "), x["item"], F.lit(" Body of filing "), x["pos"].cast("string"), F.lit(" with more words.</p>"))), ""), F.lit("</html>")).alias("content"))
    return disclosures.records(doc, ["cik"], "events").select("cik", "item", "title", "category", "is_furnished")


def sgml_documents(s, d):
    """Documents by way of one complete submission a conversation."""
    c = _table(s, d, "conversations")
    one = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), F.upper("role"), F.lit("\n<SEQUENCE>"), F.col("turn").cast("string"), F.lit("\n<FILENAME>t"), F.col("turn").cast("string"), F.lit(".txt\n<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    sub = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("x")))), lambda e: e["x"]), "").alias("text"))
    docs = documents.submission_documents(sub, ["conv_id"])
    return docs.select("conv_id", "document_type", "sequence", "filename", "byte_length", "content_type")


def name_match(s, d):
    a = _table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.regexp_replace("s_name", "Supplier#", "Trading House "), F.lit(", Inc.")).alias("name"))
    b = _table(s, d, "customer").select(F.col("c_custkey").alias("other_id"), F.concat(F.lit("The "), F.regexp_replace("c_name", "Customer#", "Trading-House "), F.lit(" Company of "), F.lower("c_mktsegment")).alias("other_name"))
    return names.match(a, b)


def known_items(s, d):
    o = _table(s, d, "orders").withColumn("item", F.concat_ws(".", (F.col("o_orderkey") % 10).cast("string"), F.lpad((F.col("o_custkey") % 9).cast("string"), 2, "0")))
    category = F.coalesce(*[F.when(F.substring("item", 1, 1) == k, F.lit(v)) for k, v in EIGHTK_CATEGORIES.items()], F.lit("unknown"))
    return o.where(known_item(F.col("item"))).groupBy("item").agg(F.count("*").alias("n"), F.first(category).alias("category"))


def supported_forms(s, d):
    """The forms that parsers read, with the filings of each among those given."""
    rows = ", ".join(f"('{k}', '{c}', '{f}', '{r}')" for k, c, forms, r in FORM_FAMILIES for f in forms)
    known = s.sql(f"SELECT * FROM VALUES {rows} AS t(kind, canonical_form, form, record_kind)")
    filed = _filings(s, d).groupBy("form").agg(F.count("*").alias("filings"))
    return known.join(filed, "form", "left").select("kind", "canonical_form", "form", "record_kind", F.coalesce("filings", F.lit(0)).cast("long").alias("filings"))


def concept_catalogue(s, d):
    """Lines and candidate concepts of each statement, with the candidates and facts found among those given."""
    rows = ", ".join(f"('{a}', {o}, '{i}', '{c}', {p})" for a, o, i, c, p in statement_lines())
    known = s.sql(f"SELECT * FROM VALUES {rows} AS t(statement, line_order, line_item, concept, priority)")
    found = adapters.facts(s, d).groupBy("concept").agg(F.count("*").alias("n"))
    return known.join(found, "concept", "left").groupBy("statement").agg(F.countDistinct("line_item").alias("lines"), F.count("*").alias("candidates"), F.count("n").alias("used"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("facts"))


def daily_window_counts(s, d):
    return window_counts(_table(s, d, "events").select(F.col("ts"), F.col("event_type").alias("form")), "1 day").select(F.col("start").cast("string").alias("start"), "form", "n")


QUERIES = {f.__name__: f for f in (
    filings_latest, filings_form_amend, filings_date_range, daily_company_filter, merge_distinct, submissions_json, company_facts_json, facts_by_alias, facts_topk, statement_lines_priority, statement_topk, stitch_best_form,
    metrics_long, scores, source_urls, holdings_scaled, holdings_aggregate, holdings_diff, thirteenf_xml, insider_transactions, insider_summary, form4_xml, tree_roots, tree_preorder, calc_checks, statement_render,
    search_exact, search_token_window, text_truncate, plain_text, html_tables, topic_argmax, exhibit_category, eightk_events, sgml_documents, name_match, known_items, supported_forms, concept_catalogue, daily_window_counts,
)}
