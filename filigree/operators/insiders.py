"""Insider transactions: labels, values and per-report tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.scalars import round4

# Labels of transaction codes and of the acquired or disposed flag.
CODES = {"P": "purchase", "S": "sale", "A": "grant/award", "M": "option exercise/conversion", "G": "gift", "F": "tax withholding/payment", "D": "disposition", "V": "voluntary report"}
FLAGS = {"A": "acquisition", "D": "disposition"}


def transaction_type(code: Column, flag: Column) -> Column:
    """By code, else by the acquired or disposed flag, else null."""
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in CODES.items()], *[F.when(flag == k, F.lit(v)) for k, v in FLAGS.items()])


def transactions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("transaction_type", transaction_type(F.col("code"), F.col("acquired_disposed"))).withColumn("value", F.col("shares") * F.col("price"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and acquired and disposed sums of each report; values only where shares and price are known."""
    got, gone = F.upper("acquired_disposed") == "A", F.upper("acquired_disposed") == "D"
    sums = lambda c, when: round4(F.sum(F.when(when, F.col(c)).otherwise(F.lit(0.0))))
    value = F.col("shares") * F.col("price")
    out = rows.withColumn("_v", value).groupBy(*by).agg(
        F.count("*").alias("transaction_count"), F.sum(F.when(F.col("derivative"), 1).otherwise(0)).alias("derivative_count"), F.sum(F.when(F.upper("code") == "P", 1).otherwise(0)).alias("purchase_count"), F.sum(F.when(F.upper("code") == "S", 1).otherwise(0)).alias("sale_count"),
        sums("shares", got).alias("acquired_shares"), sums("shares", gone).alias("disposed_shares"), sums("_v", got).alias("acquired_value"), sums("_v", gone).alias("disposed_value"),
    )
    return out.withColumn("net_shares", round4(F.col("acquired_shares") - F.col("disposed_shares"))).withColumn("net_value", round4(F.col("acquired_value") - F.col("disposed_value")))
