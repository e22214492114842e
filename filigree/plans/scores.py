"""Piotroski, Altman and Beneish scores from the metric frame and its previous period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.scalars import safe_div
from filigree.plans.metrics import company_periods, metric_columns, period_frame
from filigree.plans.statements import financial_statements

_BEFORE = ["m_return_on_assets", "m_liabilities_to_assets", "m_current_ratio", "m_gross_margin", "m_asset_turnover", "m_receivables_to_revenue", "m_sga_to_revenue", "i_shares_diluted", "i_revenue", "b_current_assets", "b_property_plant_equipment", "b_total_assets", "c_depreciation_amortization"]


def _asset_quality(p: str = "") -> Column:
    a = F.col(f"{p}b_total_assets")
    return safe_div(a - F.col(f"{p}b_current_assets") - F.col(f"{p}b_property_plant_equipment"), a)


def _depreciation_rate(p: str = "") -> Column:
    d, ppe = F.abs(F.col(f"{p}c_depreciation_amortization")), F.abs(F.col(f"{p}b_property_plant_equipment"))
    return safe_div(d, d + ppe)


def score_columns(frame: DataFrame) -> DataFrame:
    """The metric frame with the signals and values of the three scores."""
    w = company_periods()
    df = metric_columns(frame)
    df = df.select("*", *[F.lead(c).over(w).alias(f"p_{c}") for c in _BEFORE])
    c = F.col
    up = lambda m: c(m) > c(f"p_{m}")
    signals = {
        "positive_net_income": c("i_net_income") > 0,
        "positive_operating_cash_flow": c("c_operating_cash_flow") > 0,
        "improving_roa": up("m_return_on_assets"),
        "accrual_quality": c("c_operating_cash_flow") > c("i_net_income"),
        "lower_leverage": c("m_liabilities_to_assets") < c("p_m_liabilities_to_assets"),
        "higher_current_ratio": up("m_current_ratio"),
        "no_share_dilution": c("i_shares_diluted") <= c("p_i_shares_diluted"),
        "higher_gross_margin": up("m_gross_margin"),
        "higher_asset_turnover": up("m_asset_turnover"),
    }
    f_score = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in signals.values()), F.lit(0)).cast("double")
    z = {
        "working_capital_to_assets": (6.56, c("m_working_capital_to_assets")),
        "retained_earnings_to_assets": (3.26, safe_div(c("b_retained_earnings"), c("b_total_assets"))),
        "ebit_to_assets": (6.72, safe_div(c("i_operating_income"), c("b_total_assets"))),
        "equity_to_liabilities": (1.05, safe_div(c("b_stockholders_equity"), c("b_total_liabilities"))),
    }
    m = {
        "dsri": (0.92, safe_div(c("m_receivables_to_revenue"), c("p_m_receivables_to_revenue"))),
        "gmi": (0.528, safe_div(c("p_m_gross_margin"), c("m_gross_margin"))),
        "aqi": (0.404, safe_div(_asset_quality(), _asset_quality("p_"))),
        "sgi": (0.892, safe_div(c("i_revenue"), c("p_i_revenue"))),
        "depi": (0.115, safe_div(_depreciation_rate("p_"), _depreciation_rate())),
        "sgai": (-0.172, safe_div(c("m_sga_to_revenue"), c("p_m_sga_to_revenue"))),
        "tata": (4.679, safe_div(c("i_net_income") - c("c_operating_cash_flow"), c("b_total_assets"))),
        "lvgi": (-0.327, safe_div(c("m_liabilities_to_assets"), c("p_m_liabilities_to_assets"))),
    }
    weighted = lambda parts, start: sum((w * v for w, v in parts.values()), F.lit(start))
    passed = F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("passed"), F.lit(None).cast("double").alias("value")) for k, v in signals.items()])
    valued = lambda parts: F.array(*[F.struct(F.lit(k).alias("signal"), F.lit(None).cast("boolean").alias("passed"), v.alias("value")) for k, (_, v) in parts.items()])
    return df.select("*", f_score.alias("s_piotroski"), weighted(z, 0.0).alias("s_altman"), weighted(m, -4.84).alias("s_beneish"), passed.alias("g_piotroski"), valued(z).alias("g_altman"), valued(m).alias("g_beneish"))


def piotroski_rating(s: Column) -> Column:
    return F.when(s.isNull(), "insufficient_data").when(s >= 8, "strong").when(s >= 5, "mixed").otherwise("weak")


def altman_rating(s: Column) -> Column:
    return F.when(s.isNull(), "insufficient_data").when(s > 2.6, "safe").when(s >= 1.1, "gray").otherwise("distress")


def beneish_rating(s: Column) -> Column:
    return F.when(s.isNull(), "insufficient_data").when(s > -1.78, "watch").otherwise("low_risk")


def scores_from(frame: DataFrame, latest: int) -> DataFrame:
    df = score_columns(frame).where(F.col("_rank") <= latest)
    kinds = [("piotroski_f_score", "piotroski", 9.0, piotroski_rating), ("altman_z_score_private", "altman", None, altman_rating), ("beneish_m_score", "beneish", None, beneish_rating)]
    parts = [F.struct(F.lit(name).alias("score_name"), F.col(f"s_{k}").alias("score"), F.lit(most).cast("double").alias("max_score"), rate(F.col(f"s_{k}")).alias("rating"), F.col(f"g_{k}").alias("signals")) for name, k, most, rate in kinds]
    return df.select("cik", F.col("period").alias("period_end"), "source_urls", F.explode(F.array(*parts)).alias("x")).select("cik", "period_end", "source_urls", "x.*")


def health_scores(source: DataFrame, form: str | None = None, unit: str | None = None, latest: int = 4) -> DataFrame:
    """The three scores of the newest ``latest`` periods of each company; statements are read once for metrics and scores."""
    return scores_from(period_frame(financial_statements(source, "all", form, unit, max(latest + 2, 3))), latest)
