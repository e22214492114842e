"""Filings: submissions JSON, company facts JSON, ticker map, daily index text, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.predicates import date_in, form_is, part_of
from filigree.functions.scalars import accession_from_filename, boolish, index_url, nonempty, text_url

_TEXTS = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription", "isXBRL", "isInlineXBRL"]
SUBMISSIONS = "name string, filings struct<recent: struct<" + ", ".join(f"{c}: array<string>" for c in _TEXTS) + ">>"
FACT = "struct<accn: string, val: variant, fy: long, fp: string, form: string, filed: string, start: string, end: string, frame: string>"
COMPANY_FACTS = f"entityName string, facts map<string, map<string, struct<label: string, description: string, units: map<string, array<{FACT}>>>>>"


def submissions(raw: DataFrame) -> DataFrame:
    """Filing rows of (cik, json): parallel arrays side by side, in their order (pos)."""
    s = raw.select("cik", F.from_json("json", SUBMISSIONS).alias("s")).select("cik", "s.name", "s.filings.recent")
    # Flag arrays may be longer or shorter than the others: rows are those of the accession numbers.
    one = s.select("cik", F.col("name").alias("company"), F.posexplode("recent.accessionNumber").alias("pos", "accession"), "recent")
    at = lambda c: F.get(F.col(f"recent.{c}"), F.col("pos"))
    rows = one.select(
        "accession", "cik", "company", at("form").alias("form"), at("filingDate").alias("filing_date"), nonempty(at("reportDate")).alias("report_date"), nonempty(at("primaryDocument")).alias("primary_document"),
        nonempty(at("primaryDocDescription")).alias("description"), boolish(at("isXBRL")).alias("is_xbrl"), boolish(at("isInlineXBRL")).alias("is_inline_xbrl"), "pos",
    )
    return rows.withColumn("source_url", index_url(F.col("cik"), F.col("accession"))).withColumn("text_url", text_url(F.col("cik"), F.col("accession")))


def filings(source: DataFrame, form: str | None = None, start: str | None = None, end: str | None = None, amendments: bool = False, latest: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Filings of a form and date range; the first ``latest`` of each company in source order, 0 for none."""
    rows = source.where(form_is(F.col("form"), form, amendments) & date_in(F.col("filing_date"), start, end))
    if latest is None:
        return rows
    w = Window.partitionBy("cik").orderBy(*(order or [F.col("pos")]))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest).drop("_n")


def company_facts(raw: DataFrame) -> DataFrame:
    """Long fact rows of (cik, json); pos is the place in its unit's array, later is newer."""
    f = raw.select("cik", F.from_json("json", COMPANY_FACTS).alias("f")).select("cik", F.col("f.entityName").alias("company"), F.explode("f.facts").alias("taxonomy", "concepts"))
    f = f.select("cik", "company", "taxonomy", F.explode("concepts").alias("concept", "c"))
    f = f.select("cik", "company", "taxonomy", "concept", "c.label", F.explode("c.units").alias("unit", "rows"))
    f = f.select("cik", "company", "taxonomy", "concept", "label", "unit", F.posexplode("rows").alias("pos", "r"))
    number = F.when(F.schema_of_variant("r.val").isin("BIGINT", "DOUBLE") | F.schema_of_variant("r.val").startswith("DECIMAL"), F.try_variant_get("r.val", "$", "double"))
    return f.select("cik", "company", "taxonomy", "concept", "label", "unit", "pos", F.col("r.val").cast("string").alias("value"), number.alias("numeric_value"), "r.fy", "r.fp", "r.form", "r.filed", "r.start", "r.end", F.col("r.accn").alias("accession"), "r.frame")


def tickers(raw: DataFrame) -> DataFrame:
    """(cik, ticker, title) of the ticker map's JSON."""
    t = raw.select(F.explode(F.from_json("json", "map<string, struct<cik_str: long, ticker: string, title: string>>")).alias("k", "t"))
    return t.select(F.col("t.cik_str").alias("cik"), normal_ticker(F.col("t.ticker")).alias("ticker"), "t.title")


def normal_ticker(x: Column) -> Column:
    return F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-"))


def with_cik(rows: DataFrame, ticker_table: DataFrame) -> DataFrame:
    """Rows with a ``ticker`` get their cik; of equal tickers the smallest cik."""
    one = ticker_table.groupBy("ticker").agg(F.min("cik").alias("cik"))
    return rows.withColumn("ticker", normal_ticker(F.col("ticker"))).join(one, "ticker", "left")


def daily_index(lines: DataFrame) -> DataFrame:
    """Rows of a master index's lines (value): five fields by bars, the first a number."""
    p = F.split("value", r"\|")
    rows = lines.where(F.size(p) == 5).select(F.get(p, 0).try_cast("long").alias("cik"), F.trim(F.get(p, 1)).alias("company"), F.trim(F.get(p, 2)).alias("form"), F.trim(F.get(p, 3)).alias("filing_date"), F.trim(F.get(p, 4)).alias("filename"))
    rows = rows.where("cik IS NOT NULL").withColumn("accession", accession_from_filename(F.col("filename")))
    return rows.withColumn("text_url", F.concat(F.lit("https://www.sec.gov/Archives/"), F.col("filename"))).withColumn("source_url", index_url(F.col("cik"), F.col("accession")))


def daily_filings(rows: DataFrame, form: str | None = None, company: str | None = None, amendments: bool = False) -> DataFrame:
    return rows.where(form_is(F.col("form"), form, amendments) & part_of(F.col("company"), company))


HITS = "hits struct<hits: array<struct<_id: string, _score: double, _source: struct<ciks: array<string>, display_names: array<string>, form: string, file_date: string, period_ending: string, adsh: string, sequence: long, file_description: string, file_type: string>>>>"


def search_hits(raw: DataFrame) -> DataFrame:
    """Rows of a full-text search response's JSON."""
    h = raw.select(F.explode(F.from_json("json", HITS)["hits"]["hits"]).alias("h")).select("h.*")
    s = F.col("_source")
    name = F.get(s["display_names"], 0)
    return h.select(
        F.coalesce(s["adsh"], F.substring_index("_id", ":", 1)).alias("accession"), F.get(s["ciks"], 0).try_cast("long").alias("cik"), F.trim(F.substring_index(name, "(CIK", 1)).alias("company"), s["form"].alias("form"),
        s["file_date"].alias("filing_date"), nonempty(s["period_ending"]).alias("period_ending"), s["sequence"].alias("sequence"), s["file_type"].alias("file_type"), s["file_description"].alias("description"),
        F.when(F.contains("_id", F.lit(":")), F.substring_index("_id", ":", -1)).alias("document"), F.col("_score").alias("score"),
    )


def merge_distinct(one: DataFrame, two: DataFrame) -> DataFrame:
    """Union of filings, each accession once, newest first."""
    w = Window.partitionBy("accession").orderBy(F.col("filing_date").desc(), "form", "cik")
    return one.unionByName(two).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_feeds(feeds: list[DataFrame], latest: int) -> DataFrame:
    """Filings of several feeds, each accession once: the newest ``latest`` of a company, by date and accession, with their place.

    Each feed is cut to its first ``latest`` rows of a company before the merge, and the merge before anything reads documents.
    """
    first = Window.partitionBy("cik").orderBy("pos")
    merged = None
    for i, feed in enumerate(feeds):
        part = feed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= latest).drop("_n").withColumn("_feed", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    once = merged.groupBy("cik", "accession").agg(F.min_by(F.struct(*[c for c in merged.columns if c not in ("cik", "accession", "_feed")]), F.struct("_feed", "pos")).alias("_f")).select("cik", "accession", "_f.*")
    newest = Window.partitionBy("cik").orderBy(F.col("filing_date").desc(), F.col("accession").desc())
    return once.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= latest)


SEARCH = "https://efts.sec.gov/LATEST/search-index"


def efts_url(query: str, forms: list[str] | None = None, ciks: list[int] | None = None, start: str | None = None, end: str | None = None, size: int | None = None) -> str:
    """Search address; sizes up to 100, ciks of ten digits."""
    from urllib.parse import urlencode

    p = {"q": query.strip(), "from": 0} | ({} if size is None else {"size": min(size, 100)}) | {"dateRange": "custom" if start or end else "all"}
    p |= {k: v for k, v in (("startdt", start), ("enddt", end), ("forms", ",".join(forms or [])), ("ciks", ",".join(f"{c:010d}" for c in ciks or []))) if v}
    return f"{SEARCH}?{urlencode(p)}"


def search_pages(requests: DataFrame) -> DataFrame:
    """The addresses that a batch of searches asks for, one a page of 100 hits: requests with page, offset and url.

    ``requests`` has query, forms and ciks (arrays), start, end and size; the lists of
    forms and companies go to the server, as a semi-join would filter its answer.
    """
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    offsets = F.when(F.col("size").isNull() | (F.col("size") <= 0), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(100)))
    r = requests.select("*", F.posexplode(offsets).alias("page", "offset"))
    dated = F.col("start").isNotNull() | F.col("end").isNotNull()
    ciks = F.array_join(F.transform("ciks", lambda c: F.when(c < 10**10, F.lpad(c.cast("string"), 10, "0")).otherwise(c.cast("string"))), ",")
    pairs = [
        F.concat(F.lit("q="), coded(F.trim("query"))), F.concat(F.lit("from="), F.col("offset").cast("string")), F.when(F.col("size").isNotNull(), F.concat(F.lit("size="), F.least(F.col("size") - F.col("offset"), F.lit(100)).cast("string"))),
        F.when(dated, F.lit("dateRange=custom")).otherwise("dateRange=all"), F.concat(F.lit("startdt="), F.col("start")), F.concat(F.lit("enddt="), F.col("end")),
        F.when(F.size("forms") > 0, F.concat(F.lit("forms="), coded(F.array_join("forms", ",")))), F.when(F.size("ciks") > 0, F.concat(F.lit("ciks="), coded(ciks))),
    ]
    return r.withColumn("url", F.concat(F.lit(f"{SEARCH}?"), F.concat_ws("&", *pairs)))
