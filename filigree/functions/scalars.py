"""Scalar functions of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.catalogue import AUDITORS, LEGAL_SUFFIXES, UNDERWRITERS

EPSILON = 2.220446049250313e-16


def safe_div(n: Column, d: Column) -> Column:
    """Null where the denominator is null or within one machine epsilon of 0."""
    return F.when(F.abs(d) >= EPSILON, n / d)


def growth(current: Column, previous: Column) -> Column:
    return safe_div(current - previous, F.abs(previous))


def free_cash_flow(ocf: Column, capex: Column) -> Column:
    return ocf - F.abs(capex)


def tax_rate(tax: Column, pretax: Column) -> Column:
    return F.least(F.greatest(F.coalesce(safe_div(tax, pretax), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def round4(x: Column) -> Column:
    return F.round(x * 10000) / 10000


def nonempty(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def clean_text(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def plain_text(html: Column) -> Column:
    """Tags to spaces, named then numeric entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(numeric_entities(t), r"(?U)\s+", " "))


def numeric_entities(t: Column) -> Column:
    """&#N; and &#xN; (lower-case x) to their characters; impossible ones stay."""
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});"), F.lit(0)))

    def char(e: Column) -> Column:
        hexa = F.contains(e, F.lit("#x"))
        digits = F.regexp_replace(e, "[&#x;]", "")
        code = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        bytes_ = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.when(ok, F.decode(bytes_, "UTF-32")).otherwise(e)

    return F.when(F.contains(t, F.lit("&#")), F.aggregate(found, t, lambda acc, e: F.replace(acc, e, char(e)))).otherwise(t)


def truncate_utf8(text: Column, limit: int | None) -> Column:
    """At most ``limit`` bytes, back to a character boundary."""
    if limit is None:
        return text
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit("")) if limit == 0 else text
    raw = text.cast("binary")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, max(limit - i, 0)).cast("string")) for i in range(4)])
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def parse_number(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def parse_long(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("long")


def boolish(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("1", "true", "yes", "y"), F.lit(True)).when(v.isin("0", "false", "no", "n"), F.lit(False)).when(v.try_cast("long").isNotNull(), v.try_cast("long") != 0)


def comparable_name(name: Column) -> Column:
    """Lower-case words without punctuation and legal suffixes, single spaces."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_SUFFIXES)), " ")


def normalize_href(href: Column) -> Column:
    """Fragment of a locator reference with every underscore as a colon."""
    return F.replace(F.substring_index(href, "#", -1), F.lit("_"), F.lit(":"))


def normalize_concept(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(":")), r"^(?i)(us-gaap|dei|srt):", ""))


def capture_label(text: Column, label: str) -> Column:
    """Two to 120 characters after the label and a colon or hyphen, cleaned."""
    return clean_text(F.nullif(F.regexp_extract(text, rf"(?i){label}\s*[:\-]\s*([^\n\r]{{2,120}})", 1), F.lit("")))


def known_auditor(text: Column) -> Column:
    return F.coalesce(*[clean_text(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit(""))) for p in AUDITORS])


def known_underwriters(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(u) for u in UNDERWRITERS]), lambda u: F.contains(low, F.lower(u)))


def accession_from_filename(name: Column) -> Column:
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"\.txt$", "")
    return F.when(F.contains(base, F.lit("-")), base)


def safe_path_part(x: Column) -> Column:
    y = F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")
    return F.when(F.coalesce(y, F.lit("")) == "", F.lit("unknown")).otherwise(y)


def display_value(value: Column, unit: Column) -> Column:
    return F.when(unit == "ratio", F.format_string("%.2f%%", value * 100)).when(unit == "multiple", F.format_string("%.2fx", value)).when(unit == "USD", F.format_string("%.0f", value)).otherwise(F.format_string("%.4f", value))


def period_kind(fp: Column) -> Column:
    return F.when(F.upper(fp) == "FY", "annual").when(F.upper(fp).startswith("Q"), "quarterly").otherwise("other")


def index_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.html"))


def text_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit(".txt"))


def document_url(cik: Column, accession: Column, name: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), F.ltrim(name, F.lit("/")))


def daily_index_url(day: Column) -> Column:
    """Master index of the last weekday up to the given date."""
    d = F.date_sub(day, F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0))
    return F.format_string("https://www.sec.gov/Archives/edgar/daily-index/%d/QTR%d/master.%s.idx", F.year(d), F.quarter(d), F.date_format(d, "yyyyMMdd"))


def grouped(x: Column) -> Column:
    return F.format_number(x, 0)


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), grouped(x))


def signed_dollars(x: Column) -> Column:
    return F.when(x < 0, F.concat(F.lit("-$"), grouped(-x))).otherwise(F.concat(F.lit("+$"), grouped(x)))


def compact_number(x: Column) -> Column:
    """Grouped where it is whole, else with two decimals."""
    y = x.cast("double")
    return F.when(y == F.floor(y), F.concat(F.when(y < 0, "-").otherwise(""), grouped(F.abs(y)))).otherwise(F.format_string("%.2f", y))


def signed_number(x: Column) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), compact_number(x))


def cell(x: Column) -> Column:
    """Text within a table's row."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def bar(value: Column, most: Column, width: int = 12) -> Column:
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.round(F.coalesce(safe_div(value, most), F.lit(0.0)) * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))
