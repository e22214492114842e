"""Structured Streaming over daily filing feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.sources.filings import daily_filings, daily_index


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """New master index files of a folder as a stream of filings."""
    rows = daily_index(spark.readStream.text(folder))
    return rows.withColumn("ts", F.try_to_timestamp(F.col("filing_date"), F.lit("yyyyMMdd")))


def new_filings(stream: DataFrame, form: str | None = None, company: str | None = None, delay: str = "3 days") -> DataFrame:
    """Each accession once within the watermark."""
    return daily_filings(stream, form, company, True).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["accession"])


def window_counts(rows: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    """Filings by form in tumbling windows; the same for a stream and a table."""
    r = rows.withWatermark("ts", delay) if delay and rows.isStreaming else rows
    return r.groupBy(F.window("ts", width).alias("w"), "form").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "form", "n")
