"""Facts, financial statements and stitched statements for many companies at once.

A fact table has one row a reported value: cik, taxonomy, concept, label, unit,
value, numeric_value, fy, fp, form, filed, start, end, accession, pos. All
windows below are partitioned by (cik, statement, line_item), so one exchange
serves the choice of concept, the newest rows and the stitching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.functions.catalogue import STATEMENT_RANK, statement_lines
from filigree.functions.predicates import concept_is, form_is, unit_is
from filigree.functions.scalars import document_url, index_url, period_kind


def line_table(spark: SparkSession, statement: str = "all") -> DataFrame:
    """The statement lines and their candidate concepts: a fixed table of under 200 rows."""
    rows = ", ".join(f"('{s}', {o}, '{i}', '{c}', {p})" for s, o, i, c, p in statement_lines(statement))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(statement, line_order, line_item, concept, priority)")


def newest(*more: Column) -> list[Column]:
    return [F.col("filed").desc(), F.col("end").desc(), F.col("accession").desc(), F.col("unit"), F.col("pos").desc(), *more]


def fact_id() -> Column:
    return F.concat(F.col("taxonomy"), F.lit(":"), F.col("concept"), F.lit(":"), F.col("accession"), F.lit(":"), F.col("unit"))


def facts(source: DataFrame, concept: str | None = None, unit: str | None = None, form: str | None = None, latest: int | None = None) -> DataFrame:
    """Facts of a concept or short name, the newest ``latest`` of each company."""
    keep = form_is(F.col("form"), form, True) & unit_is(F.col("unit"), unit)
    if concept is not None:
        keep = keep & concept_is(concept, F.col("concept"), F.col("label"))
    out = source.where(keep).withColumn("fact_id", fact_id()).withColumn("concept", F.concat_ws(":", "taxonomy", "concept"))
    if latest is None:
        return out
    w = Window.partitionBy("cik").orderBy(*newest(F.col("concept"), F.col("value")))
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest).drop("_n")


def financial_statements(source: DataFrame, statement: str = "all", form: str | None = None, unit: str | None = None, latest: int = 1) -> DataFrame:
    """The newest rows of each line: of its candidates, the first concept with any row after the filters."""
    lines = line_table(source.sparkSession, statement)
    rows = source.where(form_is(F.col("form"), form, True) & unit_is(F.col("unit"), unit)).join(F.broadcast(lines), "concept")
    line = Window.partitionBy("cik", "statement", "line_item")
    chosen = rows.withColumn("_best", F.min(F.struct("taxonomy", "priority")).over(line)).where(F.col("_best") == F.struct("taxonomy", "priority"))
    ranked = chosen.withColumn("_n", F.row_number().over(line.orderBy(*newest(F.col("value")))))
    return ranked.where(F.col("_n") <= latest).withColumn("fact_id", fact_id()).withColumn("source_url", index_url(F.col("cik"), F.col("accession"))).drop("_best", "_n", "priority")


def statement_order() -> list[Column]:
    """Order of a printed statement."""
    rank = F.coalesce(*[F.when(F.col("statement") == s, F.lit(r)) for s, r in STATEMENT_RANK.items()], F.lit(9))
    return [F.col("cik"), rank, F.col("line_order"), F.col("filed").desc(), F.col("end").desc()]


def form_rank() -> Column:
    """10-K of a full year first, then its amendment, 10-Q, its amendment, other 10-K, others."""
    form, year = F.col("form"), F.col("fp") == "FY"
    return F.when((form == "10-K") & year, 0).when((form == "10-K/A") & year, 1).when(form == "10-Q", 2).when(form == "10-Q/A", 3).when(form == "10-K", 4).otherwise(9)


def stitched_statements(source: DataFrame, statement: str = "all", form: str | None = None, unit: str | None = None, latest: int = 4) -> DataFrame:
    """One row a line and period: the best-ranked report, with all forms that report it."""
    rows = financial_statements(source, statement, form, unit, max(3 * latest, 12)).withColumn("_period", F.coalesce("end", "filed", F.lit("unknown")))
    period = Window.partitionBy("cik", "statement", "line_item", "_period")
    best = period.orderBy(form_rank(), *newest(F.col("value")))
    every = period.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = rows.withColumn("_n", F.row_number().over(best)).withColumn("duplicate_forms", F.array_sort(F.collect_set("form").over(every))).withColumn("source_count", F.count("*").over(every)).where("_n = 1")
    line = Window.partitionBy("cik", "statement", "line_item").orderBy(F.col("end").desc(), F.col("filed").desc())
    return one.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= latest).withColumn("period_kind", period_kind(F.col("fp"))).drop("_n", "_period")


def with_urls(filings: DataFrame) -> DataFrame:
    return filings.withColumn("source_url", index_url(F.col("cik"), F.col("accession"))).withColumn("document_url", document_url(F.col("cik"), F.col("accession"), F.col("primary_document")))
