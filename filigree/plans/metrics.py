"""Ratio and growth metrics: one wide row a period, then one row a metric.

The wide row comes from one aggregation with a conditional newest value for
each of the statement lines (keys are known, so no pivot discovery); derived
inputs and all metrics are column expressions on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.catalogue import STATEMENTS
from filigree.functions.scalars import display_value, free_cash_flow, growth, safe_div, tax_rate
from filigree.plans.statements import financial_statements

KEYS = [(s, item) for s, lines in STATEMENTS.items() for item, _ in lines]

# Name, category, kind, numerator, denominator. Inputs are statement lines as i_ (income), b_ (balance), c_ (cash flow), or derived d_.
METRICS: list[tuple[str, str, str, str, str | None]] = [
    ("gross_margin", "profitability", "ratio", "i_gross_profit", "i_revenue"),
    ("operating_margin", "profitability", "ratio", "i_operating_income", "i_revenue"),
    ("net_margin", "profitability", "ratio", "i_net_income", "i_revenue"),
    ("revenue_growth", "growth", "growth", "i_revenue", None),
    ("net_income_growth", "growth", "growth", "i_net_income", None),
    ("free_cash_flow", "cashflow", "USD", "d_free_cash_flow", None),
    ("working_capital", "liquidity", "USD", "d_working_capital", None),
    ("total_debt", "leverage", "USD", "d_total_debt", None),
    ("net_debt", "leverage", "USD", "d_net_debt", None),
    ("free_cash_flow_margin", "cashflow", "ratio", "d_free_cash_flow", "i_revenue"),
    ("return_on_assets", "returns", "ratio", "i_net_income", "b_total_assets"),
    ("return_on_equity", "returns", "ratio", "i_net_income", "b_stockholders_equity"),
    ("current_ratio", "liquidity", "multiple", "b_current_assets", "b_current_liabilities"),
    ("quick_ratio", "liquidity", "multiple", "d_quick_assets", "b_current_liabilities"),
    ("cash_ratio", "liquidity", "multiple", "b_cash_and_equivalents", "b_current_liabilities"),
    ("liabilities_to_assets", "leverage", "ratio", "b_total_liabilities", "b_total_assets"),
    ("cash_to_assets", "liquidity", "ratio", "b_cash_and_equivalents", "b_total_assets"),
    ("debt_to_equity", "leverage", "ratio", "d_total_debt", "b_stockholders_equity"),
    ("debt_to_assets", "leverage", "ratio", "d_total_debt", "b_total_assets"),
    ("net_debt_to_equity", "leverage", "ratio", "d_net_debt", "b_stockholders_equity"),
    ("interest_coverage", "solvency", "multiple", "i_operating_income", "i_interest_expense"),
    ("effective_tax_rate", "profitability", "ratio", "i_income_tax_expense", "i_income_before_tax"),
    ("roic", "returns", "ratio", "d_nopat", "d_invested_capital"),
    ("asset_turnover", "efficiency", "multiple", "i_revenue", "b_total_assets"),
    ("operating_cash_flow_margin", "cashflow", "ratio", "c_operating_cash_flow", "i_revenue"),
    ("free_cash_flow_to_net_income", "cashflow", "ratio", "d_free_cash_flow", "i_net_income"),
    ("capex_to_revenue", "capital_intensity", "ratio", "d_absolute_capex", "i_revenue"),
    ("dividend_payout_ratio", "capital_return", "ratio", "d_absolute_dividends_paid", "i_net_income"),
    ("share_repurchases_to_revenue", "capital_return", "ratio", "d_absolute_share_repurchases", "i_revenue"),
    ("share_repurchases_to_free_cash_flow", "capital_return", "ratio", "d_absolute_share_repurchases", "d_free_cash_flow"),
    ("cost_of_revenue_margin", "profitability", "ratio", "i_cost_of_revenue", "i_revenue"),
    ("rd_to_revenue", "expense_intensity", "ratio", "i_research_and_development", "i_revenue"),
    ("sga_to_revenue", "expense_intensity", "ratio", "i_selling_general_admin", "i_revenue"),
    ("operating_expense_ratio", "expense_intensity", "ratio", "i_operating_expenses", "i_revenue"),
    ("pretax_margin", "profitability", "ratio", "i_income_before_tax", "i_revenue"),
    ("cash_flow_return_on_assets", "returns", "ratio", "c_operating_cash_flow", "b_total_assets"),
    ("cash_flow_to_debt", "solvency", "ratio", "c_operating_cash_flow", "d_total_debt"),
    ("equity_ratio", "leverage", "ratio", "b_stockholders_equity", "b_total_assets"),
    ("debt_to_capital", "leverage", "ratio", "d_total_debt", "d_total_capital"),
    ("working_capital_to_assets", "liquidity", "ratio", "d_working_capital", "b_total_assets"),
    ("working_capital_to_revenue", "liquidity", "ratio", "d_working_capital", "i_revenue"),
    ("inventory_to_current_assets", "efficiency", "ratio", "b_inventory", "b_current_assets"),
    ("receivables_to_revenue", "efficiency", "ratio", "b_accounts_receivable", "i_revenue"),
    ("fcf_to_debt", "solvency", "ratio", "d_free_cash_flow", "d_total_debt"),
    ("lease_liabilities_to_assets", "leverage", "ratio", "b_operating_lease_liabilities", "b_total_assets"),
    ("goodwill_to_assets", "asset_quality", "ratio", "b_goodwill", "b_total_assets"),
    ("intangibles_to_assets", "asset_quality", "ratio", "b_intangible_assets", "b_total_assets"),
    ("marketable_securities_to_assets", "liquidity", "ratio", "b_marketable_securities_current", "b_total_assets"),
    ("cash_and_securities_to_assets", "liquidity", "ratio", "d_cash_and_securities", "b_total_assets"),
    ("capex_to_operating_cash_flow", "capital_intensity", "ratio", "d_absolute_capex", "c_operating_cash_flow"),
    ("cash_conversion", "cashflow", "multiple", "c_operating_cash_flow", "i_net_income"),
    ("inventory_turnover", "efficiency", "multiple", "i_cost_of_revenue", "b_inventory"),
    ("receivables_turnover", "efficiency", "multiple", "i_revenue", "b_accounts_receivable"),
    ("cash_and_securities_coverage", "liquidity", "multiple", "d_cash_and_securities", "b_current_liabilities"),
]


def key_column(statement: str, item: str) -> str:
    return f"{statement[0]}_{item}"


def sum_present(*xs: Column) -> Column:
    """Sum of the inputs that are present; null only if none is."""
    total = xs[0]
    for x in xs[1:]:
        total = F.when(total.isNull(), x).when(x.isNull(), total).otherwise(total + x)
    return total


def period_frame(statements: DataFrame) -> DataFrame:
    """One row a company and period: the newest value of each line, and the derived inputs."""
    rows = statements.withColumn("period", F.coalesce("end", "filed", F.lit("unknown"))).withColumn("_newest", F.struct("filed", "end", "accession", "pos"))
    line = lambda s, i: (F.col("statement") == s) & (F.col("line_item") == i)
    # The first row of a line and period holds, also where its value is null.
    values = [F.max_by(F.struct("numeric_value"), F.when(line(s, i), F.col("_newest"))).alias(key_column(s, i)) for s, i in KEYS]
    first = F.min(F.struct(F.when(F.col("statement") == "income", 0).when(F.col("statement") == "balance", 1).otherwise(2).alias("r"), "line_order", "fy", "fp", "form", "filed", "accession")).alias("_meta")
    wide = rows.groupBy("cik", "period").agg(*values, first, F.array_sort(F.collect_set("source_url")).alias("source_urls"))
    names = [key_column(s, i) for s, i in KEYS]
    wide = wide.select("cik", "period", *[F.col(n)["numeric_value"].alias(n) for n in names], *[F.col("_meta")[x].alias(x) for x in ("fy", "fp", "form", "filed", "accession")], "source_urls")
    c = F.col
    debt = sum_present(c("b_current_debt"), c("b_long_term_debt"))
    net = debt - c("b_cash_and_equivalents")
    derived = {
        "d_quick_assets": sum_present(c("b_cash_and_equivalents"), c("b_marketable_securities_current"), c("b_accounts_receivable")),
        "d_cash_and_securities": sum_present(c("b_cash_and_equivalents"), c("b_marketable_securities_current")),
        "d_total_debt": debt,
        "d_total_capital": sum_present(debt, c("b_stockholders_equity")),
        "d_working_capital": c("b_current_assets") - c("b_current_liabilities"),
        "d_net_debt": net,
        "d_invested_capital": sum_present(net, c("b_stockholders_equity")),
        "d_free_cash_flow": free_cash_flow(c("c_operating_cash_flow"), c("c_capital_expenditures")),
        "d_nopat": F.when(c("i_income_tax_expense").isNotNull() & c("i_income_before_tax").isNotNull(), c("i_operating_income") * (F.lit(1.0) - tax_rate(c("i_income_tax_expense"), c("i_income_before_tax")))),
        "d_absolute_capex": F.abs("c_capital_expenditures"),
        "d_absolute_dividends_paid": F.abs("c_dividends_paid"),
        "d_absolute_share_repurchases": F.abs("c_share_repurchases"),
    }
    return wide.select("*", *[v.alias(k) for k, v in derived.items()])


def company_periods() -> Window:
    return Window.partitionBy("cik").orderBy(F.col("period").desc())


def metric_columns(frame: DataFrame) -> DataFrame:
    """The period frame with its rank (newest first), the previous values that growth needs, and all metrics as m_ columns."""
    w = company_periods()
    grown = [m for m in METRICS if m[2] == "growth"]
    df = frame.select("*", F.row_number().over(w).alias("_rank"), *[F.lead(m[3]).over(w).alias(f"_prev_{m[3]}") for m in grown])

    def value(kind: str, num: str, den: str | None) -> Column:
        if kind == "growth":
            return growth(F.col(num), F.col(f"_prev_{num}"))
        return F.col(num) if den is None else safe_div(F.col(num), F.col(den))

    return df.select("*", *[value(kind, num, den).alias(f"m_{name}") for name, _, kind, num, den in METRICS])


def metrics_from(frame: DataFrame, latest: int) -> DataFrame:
    wide = metric_columns(frame).where(F.col("_rank") <= latest)
    parts = []
    for name, category, kind, num, den in METRICS:
        other = F.col(f"_prev_{num}") if kind == "growth" else F.col(den) if den else F.lit(None).cast("double")
        unit = "ratio" if kind == "growth" else kind
        parts.append(F.struct(F.lit(name).alias("metric"), F.lit(category).alias("category"), F.lit(unit).alias("unit"), F.col(f"m_{name}").alias("value"), F.array(F.struct(F.lit(num).alias("key"), F.col(num).alias("value")), F.struct(F.lit(den or num).alias("key"), other.alias("value"))).alias("components")))
    long = wide.select("cik", F.col("period").alias("period_end"), "fy", "fp", "form", "filed", "accession", "source_urls", F.explode(F.array(*parts)).alias("x"))
    return long.select("cik", "period_end", "fy", "fp", "form", "filed", "accession", "source_urls", "x.*").where("value IS NOT NULL").withColumn("display_value", display_value(F.col("value"), F.col("unit")))


def financial_metrics(source: DataFrame, form: str | None = None, unit: str | None = None, latest: int = 4) -> DataFrame:
    """All metrics of the newest ``latest`` periods of each company."""
    return metrics_from(period_frame(financial_statements(source, "all", form, unit, max(latest + 1, 2))), latest)
