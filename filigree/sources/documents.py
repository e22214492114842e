"""Complete submissions: the documents in one text, their kinds, selectors and contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.scalars import plain_text, truncate_utf8
from filigree.sources.parse import parsed

_OPEN, _CLOSE = re.compile(r"<document>", re.I), re.compile(r"</document>", re.I)
_TEXT = re.compile(r"<(/?)text>", re.I)


def _field(raw: str, tag: str) -> str | None:
    m = re.search(rf"<{tag}>([^\r\n<]*)", raw, re.I)
    return (m[1].strip() or None) if m else None


def _body(raw: str) -> str:
    """What the outermost TEXT element holds; the whole block where it is missing or open."""
    depth, start = 0, None
    for m in _TEXT.finditer(raw):
        if m[1]:
            if depth == 1:
                return raw[start : m.start()]
            depth = max(0, depth - 1)
        else:
            if start is None:
                start = m.end()
            depth += 1
    return raw


def document_of(raw: str) -> dict:
    """A document of what lies between its marks."""
    return {"document_type": _field(raw, "TYPE"), "sequence": _field(raw, "SEQUENCE"), "filename": _field(raw, "FILENAME"), "description": _field(raw, "DESCRIPTION"), "content": _body(raw).strip()}


def split_submission(text: str) -> list[dict]:
    """Documents of a complete submission; an unterminated one and all after it are left out."""
    out, at = [], 0
    while (a := _OPEN.search(text, at)) and (b := _CLOSE.search(text, a.end())):
        out.append({"pos": len(out)} | document_of(text[a.end() : b.start()]))
        at = b.end()
    return out


def submission_documents(submissions: DataFrame, keys: list[str], content: str = "text") -> DataFrame:
    docs = parsed(submissions, keys, content, split_submission, "pos int, document_type string, sequence string, filename string, description string, content string")
    return docs.withColumn("content_type", content_type()).withColumn("byte_length", F.octet_length("content").cast("long"))


def content_type() -> Column:
    ext = F.lower(F.substring_index("filename", ".", -1))
    head = F.lower(F.ltrim(F.substring("content", 1, 200)))
    return (
        F.when(F.contains("filename", F.lit(".")) & ext.isin("htm", "html"), "html").when(F.contains("filename", F.lit(".")) & ext.isin("xml", "xsd"), "xml").when(F.contains("filename", F.lit(".")) & (ext == "txt"), "text")
        .when(head.startswith("<?xml") | head.startswith("<xml"), "xml").when(F.contains(head, F.lit("<html")) | head.startswith("<!doctype html"), "html").otherwise("text")
    )


def primary(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("sequence") == "1")


def of_type(docs: DataFrame, kind: str) -> DataFrame:
    return docs.where(F.upper("document_type") == kind.upper())


def ownership_xml(docs: DataFrame) -> DataFrame:
    return docs.where(F.contains(F.lower("content"), F.lit("<ownershipdocument")))


def information_tables(docs: DataFrame) -> DataFrame:
    return docs.where((F.upper("document_type") == "INFORMATION TABLE") | F.contains(F.lower("content"), F.lit("<informationtable")))


def document_content(docs: DataFrame, keys: list[str], filename: str | None = None, sequence: str | None = None, limit_bytes: int | None = None, plain: bool = True) -> DataFrame:
    """One document a filing: by name, else by sequence, else the primary, else the first; cut to whole characters."""
    rank = F.when(F.lit(filename is not None) & (F.lower("filename") == F.lower(F.lit(filename))), 0).when(F.lit(filename is None and sequence is not None) & (F.col("sequence") == F.lit(sequence)), 0).when(F.lit(filename is None and sequence is None) & (F.col("sequence") == "1"), 1).when(F.lit(filename is None and sequence is None), 2)
    cols = [c for c in docs.columns if c not in keys]
    one = docs.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("_rank", "pos")).alias("_d")).select(*keys, "_d.*")
    text = F.when(F.col("content_type") == "html", plain_text(F.col("content"))).otherwise(F.col("content")) if plain else F.col("content")
    one = one.withColumn("_text", text).withColumn("content", truncate_utf8(F.col("_text"), limit_bytes))
    return one.withColumn("returned_bytes", F.octet_length("content").cast("long")).withColumn("truncated", F.octet_length("content") < F.octet_length("_text")).drop("_text")
