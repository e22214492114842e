"""Domain inputs from the star-schema tables, as SQL that several engines read alike.

A template names tables in braces; ``run`` binds them to the parquet tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FILINGS = """
SELECT CAST(o_orderkey AS STRING) AS accession, c_custkey AS cik, c_name AS company,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-Q' WHEN '3' THEN '8-K' WHEN '4' THEN 'SC 13D' ELSE 'DEF 14A' END || CASE WHEN o_orderstatus = 'P' THEN '/A' ELSE '' END AS form,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS filing_date, o_orderkey AS pos
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: Cents and counts by nation and year, all whole numbers.
MEASURES = """
SELECT c_nationkey AS cik, year(o_orderdate) AS yr,
  SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS gross,
  SUM(CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)) AS disc,
  SUM(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS tax,
  SUM(CAST(floor(l_quantity) AS BIGINT)) AS qty,
  SUM(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS ret,
  SUM(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS fin,
  COUNT(*) AS n
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
GROUP BY c_nationkey, year(o_orderdate)
"""

#: (concept, expression over MEASURES, condition)
FACT_ROWS = [
    ("Revenues", "gross", "true"), ("SalesRevenueNet", "gross + 1", "cik % 3 = 0"), ("CostOfRevenue", "gross - 5 * disc", "true"), ("GrossProfit", "5 * disc", "true"), ("ResearchAndDevelopmentExpense", "disc", "cik % 4 <> 0"),
    ("SellingGeneralAndAdministrativeExpense", "tax", "true"), ("OperatingIncomeLoss", "3 * disc - tax", "true"), ("InterestExpense", "n * 100", "cik % 5 <> 0"), ("IncomeLossFromContinuingOperationsBeforeIncomeTaxes", "2 * disc - tax", "true"),
    ("IncomeTaxExpenseBenefit", "tax - disc", "true"), ("NetIncomeLoss", "disc - n * 300", "true"), ("WeightedAverageNumberOfDilutedSharesOutstanding", "qty", "true"),
    ("CashAndCashEquivalentsAtCarryingValue", "fin - ret", "true"), ("MarketableSecuritiesCurrent", "ret", "cik % 2 = 0"), ("AccountsReceivableNetCurrent", "tax * 3", "true"), ("InventoryNet", "ret", "true"), ("AssetsCurrent", "fin + ret", "true"),
    ("PropertyPlantAndEquipmentNet", "gross", "true"), ("Goodwill", "disc * 2", "cik % 6 <> 0"), ("Assets", "2 * gross + fin", "true"), ("LiabilitiesCurrent", "ret + tax", "true"), ("LongTermDebtCurrent", "tax", "cik % 7 <> 0"),
    ("LongTermDebt", "ret", "cik % 8 <> 0"), ("Liabilities", "gross + ret", "true"), ("StockholdersEquity", "gross - ret + fin", "true"), ("RetainedEarningsAccumulatedDeficit", "fin - disc", "true"),
    ("DepreciationDepletionAndAmortization", "tax * 2", "true"), ("NetCashProvidedByUsedInOperatingActivities", "3 * disc - n * 100", "true"), ("PaymentsToAcquirePropertyPlantAndEquipment", "disc", "true"), ("PaymentsOfDividends", "n * 100", "cik % 2 = 1"), ("PaymentsForRepurchaseOfCommonStock", "0 - n * 50", "cik % 3 = 1"),
]


#: (form, period name, added to the value, day filed in the next year, condition)
FACT_FORMS = [("10-K", "FY", 0, "-02-15", "true"), ("10-K/A", "FY", 7, "-06-01", "yr % 3 = 0"), ("10-Q", "Q4", 3, "-01-20", "cik % 2 = 0")]


def _facts() -> str:
    """The facts as a union, for engines without array functions of one kind."""
    parts = []
    for concept, value, where in FACT_ROWS:
        for form, fp, extra, filed, cond in FACT_FORMS:
            parts.append(f"SELECT CAST(cik AS BIGINT) AS cik, 'us-gaap' AS taxonomy, '{concept}' AS concept, CAST(({value}) + {extra} AS DOUBLE) AS numeric_value, CAST(yr AS BIGINT) AS fy, '{fp}' AS fp, '{form}' AS form, CAST(yr + 1 AS STRING) || '{filed}' AS filed, CAST(yr AS STRING) || '-12-31' AS period, CAST(cik AS STRING) || '-' || CAST(yr AS STRING) || '-{form[3:]}{fp}' AS accession, CAST(0 AS INT) AS pos FROM m WHERE {where} AND {cond}")
    return f"WITH m AS ({MEASURES}) " + " UNION ALL ".join(parts)


FACTS = _facts()

HOLDINGS = """
SELECT l_suppkey AS cik, CAST(l_suppkey AS STRING) || '-' || CAST(year(l_shipdate) AS STRING) AS accession, CAST(l_partkey % 20 AS STRING) AS cusip, l_returnflag AS class, nullif(l_linestatus, 'O') AS put_call,
  CAST(year(l_shipdate) AS STRING) || '-12-31' AS report_date, CAST(floor(l_extendedprice) AS BIGINT) AS value, CAST(l_quantity AS DOUBLE) AS shares,
  l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS pos
FROM {lineitem}
"""

INSIDERS = """
SELECT user_id AS owner, event_id AS pos, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'click' THEN 'S' WHEN 'signup' THEN 'A' WHEN 'error' THEN 'X' ELSE 'M' END AS code,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'A' WHEN event_type = 'view' THEN NULL ELSE 'D' END AS acquired_disposed,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 100) AS DOUBLE) END AS shares, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS price, event_id % 4 = 0 AS derivative
FROM {events}
"""

EDGES = """
SELECT 'geo' AS role, 'R' || CAST(r_regionkey AS STRING) AS parent, 'N' || CAST(n_nationkey AS STRING) AS child, CAST(n_nationkey % 7 AS DOUBLE) AS ord, CAST(1 AS DOUBLE) AS weight FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geo', 'N' || CAST(c_nationkey AS STRING), 'C' || CAST(c_custkey AS STRING), CAST(c_custkey % 13 AS DOUBLE), CAST(CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE 1 END AS DOUBLE) FROM {customer}
"""

#: Whole cents of each node: customers their balance, nations the weighted sum with an error where their key is divisible by 5, three regions.
NODE_VALUES = """
WITH c AS (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS v FROM {customer})
SELECT 'geo' AS role, 'C' || CAST(c_custkey AS STRING) AS concept, CAST(v AS DOUBLE) AS numeric_value FROM c WHERE c_custkey % 17 <> 0
UNION ALL
SELECT 'geo', 'N' || CAST(c_nationkey AS STRING), CAST(SUM(CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 10 = 0 THEN 0 - v ELSE v END) * CASE WHEN c_nationkey % 5 = 0 THEN 3 ELSE 1 END AS DOUBLE) FROM c GROUP BY c_nationkey
UNION ALL
SELECT 'geo', 'R' || CAST(r_regionkey AS STRING), CAST(r_regionkey AS DOUBLE) FROM {region} WHERE r_regionkey < 3
"""


def plain_sql(template: str) -> str:
    """The template over tables of their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", template)


def run(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", template))
    return spark.sql(template, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACTS from one pass over the measures: each row is exploded into its facts."""
    m = run(spark, sf_dir, MEASURES)
    rows = F.array(*[F.when(F.expr(w), F.struct(F.lit(c).alias("concept"), F.expr(f"CAST({v} AS BIGINT)").alias("v"))) for c, v, w in FACT_ROWS])
    forms = F.array(*[F.when(F.expr(w), F.struct(F.lit(f).alias("form"), F.lit(fp).alias("fp"), F.lit(x).alias("x"), F.lit(day).alias("day"))) for f, fp, x, day, w in FACT_FORMS])
    e = m.select("cik", "yr", F.explode(F.array_compact(rows)).alias("r"), forms.alias("forms")).select("cik", "yr", "r", F.explode(F.array_compact("forms")).alias("f"))
    value = (F.col("r.v") + F.col("f.x")).cast("double")
    year = F.col("yr").cast("string")
    return e.select(
        F.col("cik").cast("long").alias("cik"), F.lit("us-gaap").alias("taxonomy"), "r.concept", F.lit(None).cast("string").alias("label"), F.lit("USD").alias("unit"), F.lit(0).alias("pos"), value.cast("string").alias("value"), value.alias("numeric_value"),
        F.col("yr").cast("long").alias("fy"), "f.fp", "f.form", F.concat((F.col("yr") + 1).cast("string"), "f.day").alias("filed"), F.lit(None).cast("string").alias("start"), F.concat(year, F.lit("-12-31")).alias("end"),
        F.concat(F.col("cik").cast("string"), F.lit("-"), year, F.lit("-"), F.substring("f.form", 4, 10), "f.fp").alias("accession"),
    )
