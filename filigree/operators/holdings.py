"""Institutional holdings: scaling, aggregation, comparison of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reports up to this date give values in thousands.
THOUSANDS_UNTIL = "2022-09-30"
KEYS = ["cusip", "class", "put_call"]


def value_scale(report_date: Column) -> Column:
    return F.when(report_date <= THOUSANDS_UNTIL, "thousands").otherwise("dollars")


def scaled(rows: DataFrame) -> DataFrame:
    """Holdings with value_scale and value_usd; values that would overflow stop at the largest long."""
    scale = value_scale(F.col("report_date"))
    most = F.lit(9223372036854775807)
    usd = F.when(scale == "dollars", F.col("value")).otherwise(F.coalesce(F.try_multiply(F.col("value"), F.lit(1000).cast("long")), most))
    return rows.withColumn("value_scale", scale).withColumn("value_usd", usd)


def aggregate(rows: DataFrame) -> DataFrame:
    """One row a report and security, nulls grouped; descriptions come from the first row (pos)."""
    numbers = ["value_usd", "shares", "voting_sole", "voting_shared", "voting_none"]
    present = [c for c in numbers if c in rows.columns]
    first = [c for c in ("issuer", "report_date", "company", "filing_date", "source_url") if c in rows.columns]
    one = F.min_by(F.struct(*first), "pos").alias("_first") if first else F.lit(None).alias("_first")
    out = rows.groupBy("cik", "accession", *KEYS).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in present], F.count("*").alias("row_count"), one)
    return out.select("cik", "accession", *KEYS, *present, "row_count", *[F.col("_first")[c].alias(c) for c in first])


def two_newest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aggregated holdings of each manager's newest and second newest report date."""
    w = Window.partitionBy("cik").orderBy(F.col("report_date").desc())
    ranked = rows.withColumn("_r", F.dense_rank().over(w))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r = 2").drop("_r")


def diff(current: DataFrame, previous: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Null-safe full outer comparison; the class of a change is judged by shares alone."""
    by = by or ["cik"]
    keys = [*by, *KEYS]
    a, b = current.alias("a"), previous.alias("b")
    on = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = c if on is None else on & c
    j = a.join(b, on, "full_outer")
    here, there = F.col("a.row_count").isNotNull(), F.col("b.row_count").isNotNull()
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    ds = F.coalesce(F.col("a.shares").cast("double"), F.lit(0.0)) - F.coalesce(F.col("b.shares").cast("double"), F.lit(0.0))
    kind = F.when(~there, "new").when(~here, "exited").when(F.abs(ds) <= 2.220446049250313e-16, "unchanged").when(ds > 0, "increased").otherwise("reduced")
    pick = lambda k: F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k)
    return j.select(*[pick(k) for k in keys], kind.alias("change_type"), n("a.value_usd").alias("value_usd"), n("b.value_usd").alias("previous_value_usd"), (n("a.value_usd").cast("decimal(20,0)") - n("b.value_usd").cast("decimal(20,0)")).alias("value_change"), n("a.shares").cast("double").alias("shares"), n("b.shares").cast("double").alias("previous_shares"), ds.alias("share_change"))


def newest_changes(rows: DataFrame) -> DataFrame:
    """The comparison of each manager's two newest report dates without a join: dates are ranked once, then one
    aggregation by position meets both sides, on the ranking's partitions. Reports of one date count together."""
    ranked = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("cik").orderBy(F.col("report_date").desc()))).where("_r <= 2")
    of = lambda r, c: F.sum(F.when(F.col("_r") == r, F.col(c)))
    g = ranked.groupBy("cik", *KEYS).agg(F.bool_or(F.col("_r") == 1).alias("here"), F.bool_or(F.col("_r") == 2).alias("there"), *[F.coalesce(of(r, c), F.lit(0)).alias(f"{c}_{r}") for c in ("value_usd", "shares") for r in (1, 2)])
    now, before = F.col("shares_1").cast("double"), F.col("shares_2").cast("double")
    kind = F.when(~F.col("there"), "new").when(~F.col("here"), "exited").when(F.abs(now - before) <= 2.220446049250313e-16, "unchanged").when(now > before, "increased").otherwise("reduced")
    value = F.col("value_usd_1").cast("decimal(20,0)") - F.col("value_usd_2").cast("decimal(20,0)")
    return g.select("cik", *KEYS, kind.alias("change_type"), F.col("value_usd_1").alias("value_usd"), F.col("value_usd_2").alias("previous_value_usd"), value.alias("value_change"), now.alias("shares"), before.alias("previous_shares"), (now - before).alias("share_change"))


def diff_order() -> list[Column]:
    return [F.col("change_type") == "unchanged", F.abs("value_change").desc(), F.col("cusip")]
