"""Dispatch from a form to its parser, and company resolution with an injected model."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions import texts
from filigree.functions.catalogue import FORM_FAMILIES
from filigree.functions.predicates import topic_is
from filigree.operators import disclosures
from filigree.operators.disclosures import company_topics, records
from filigree.operators.resolver import answer_json
from filigree.sources import documents, xmlforms
from filigree.sources.parse import parsed


def family_of(form: str) -> tuple[str, str] | None:
    """(parser kind, record kind) of a form, however it is spelled in case."""
    name = form.strip().upper()
    return next(((kind, record) for kind, _, forms, record in FORM_FAMILIES if name in forms), None)


def parse_form(docs: DataFrame, form: str, keys: list[str]) -> DataFrame:
    """{kind, record} rows of the documents (document_type, sequence, content ...) of filings of one form."""
    found = family_of(form)
    if found is None:
        raise ValueError(f"no parser for form {form!r}")
    kind, record = found
    main = documents.primary(docs)
    by: dict[str, Callable[[], DataFrame]] = {
        "company_report": lambda: company_topics(records(main, keys, "tables")),
        "form4": lambda: xmlforms.parse_column(documents.ownership_xml(docs), keys, "form4"),
        "eight_k": lambda: records(main, keys, "events"),
        "schedule13": lambda: records(main, keys, "13d" if "13D" in form.upper() else "13g"),
        "proxy": lambda: records(main, keys, "proxy"),
        "prospectus": lambda: records(main, keys, "prospectus"),
        "foreign_issuer": lambda: records(main, keys, "foreign"),
        "fund_disclosure": lambda: xmlforms.parse_column(main, keys, "fund"),
        "thirteen_f": lambda: xmlforms.parse_column(documents.information_tables(docs), keys, "holdings"),
    }
    return by[kind]().select(F.lit(record).alias("kind"), F.to_json(F.struct("*")).alias("record"))


def family_column(form: Column) -> Column:
    """The parser kind of a form in any spelling of case; null where there is none."""
    names = F.create_map(*[F.lit(x) for kind, _, forms, _ in FORM_FAMILIES for name in forms for x in (name, kind)])
    return F.element_at(names, F.upper(F.trim(form)))


#: Parsers by kind; a schedule's depends on its letter.
PARSERS: dict[str, Callable[[str], list[dict]]] = {
    "company_report": texts.tables, "form4": xmlforms.form4, "eight_k": disclosures.eightk_events, "13d": disclosures.schedule13("13d"), "13g": disclosures.schedule13("13g"), "proxy": disclosures.proxy,
    "prospectus": disclosures.prospectus, "foreign_issuer": disclosures.foreign_issuer, "fund_disclosure": xmlforms.fund_report, "thirteen_f": xmlforms.information_table,
}


def _topic_words(table: dict) -> str:
    """The words of ``disclosures.topic_corpus``, cases kept."""
    return " ".join([*([] if table["title_hint"] is None else [table["title_hint"]]), " ".join(table["headers"]), " ".join(c for r in table["rows"][:8] for c in r)])


def _wanted(family: Column) -> Column:
    """Which document of a filing its family's parser reads."""
    text, kind = F.lower("content"), F.upper(F.trim(F.coalesce("document_type", F.lit(""))))
    return F.when(family == "form4", F.contains(text, F.lit("<ownershipdocument"))).when(family == "thirteen_f", (kind == "INFORMATION TABLE") | F.contains(text, F.lit("<informationtable"))).otherwise(F.trim("sequence") == "1")


def parse_filings(docs: DataFrame, keys: list[str], topic: str | None = None) -> DataFrame:
    """Records of filings of all forms in one pass: (keys, kind, pos, record variant, error).

    ``docs`` has form, document_type, sequence and content. The form chooses the
    document and the parser within one scan and one Arrow stage; documents that no
    parser reads never leave the JVM. Forms without a parser give no rows, documents
    that a parser cannot read one row with their error.
    """
    family = F.when(F.col("_family") != "schedule13", F.col("_family")).when(F.contains(F.upper("form"), F.lit("13D")), "13d").otherwise("13g")
    routed = docs.withColumn("_family", family_column(F.col("form"))).where(F.col("_family").isNotNull() & F.coalesce(_wanted(F.col("_family")), F.lit(False)))
    # The parser's name travels at the head of the text, up to the first line's end.
    routed = routed.select(*keys, "_family", F.concat(family, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("_doc"))

    def parse(doc: str) -> list[dict]:
        name, _, content = doc.partition("\n")
        words = _topic_words if name == "company_report" else lambda x: None
        return [{"pos": i, "body": json.dumps(x, ensure_ascii=False), "_words": words(x)} for i, x in enumerate(PARSERS[name](content))]

    rows = parsed(routed, [*keys, "_family"], "_doc", parse, "pos int, body string, _words string")
    # Tables of company reports get their topic, by the same scores as in a plan of their own. Their words come from the
    # parser as a column: taken from the body, it would be read again for each of the terms.
    scored = rows.withColumn("_b", F.when(F.col("_words").isNotNull(), disclosures.topic_scores(F.lower("_words"))))
    scored = scored.where(F.col("_b").isNull() | (F.col("_b.score") >= 3) & topic_is(F.col("_b.topic"), topic))
    labelled = F.to_json(F.struct(F.col("_b.topic").alias("topic"), F.least(F.col("_b.score") / 8.0, F.lit(1.0)).alias("confidence")))
    body = F.when(F.col("_b").isNull(), F.col("body")).otherwise(F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(", "), F.substring(labelled, 2, 1 << 20)))
    record = F.element_at(F.create_map(*[F.lit(x) for kind, _, _, r in FORM_FAMILIES for x in (kind, r)]), F.col("_family"))
    return scored.select(*keys, record.alias("kind"), "pos", F.parse_json(body).alias("record"), F.col("_error").alias("error"))


def resolve(query: str, ask: Callable[[str], str], known: Callable[[int], str | None]) -> list[dict]:
    """Candidate companies that a model proposes, each checked by ``known`` (cik to name); one round of repair."""
    answer = ask(f"List companies as a JSON array of objects with name and cik for: {query}")
    try:
        found = answer_json(answer)
    except ValueError:
        found = answer_json(ask(f"Give only the JSON array from this: {answer}"))
    found = found.get("candidates", []) if isinstance(found, dict) else found
    out = []
    for c in found:
        cik = int(c["cik"]) if str(c.get("cik", "")).isdigit() else None
        name = known(cik) if cik is not None else None
        out.append({"name": c.get("name"), "cik": cik, "status": "validated" if name else "unverified", "matched_name": name, "next_commands": [f"filings --cik {cik}"] if name else []})
    return out
