"""Markdown reports and the agent pack, from small results of distributed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.holdings import diff_order

TREND = ["revenue_growth", "gross_margin", "operating_margin", "net_margin", "free_cash_flow_margin", "current_ratio", "liabilities_to_assets"]


def _cell(v: object) -> str:
    return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")


def table(head: list[str], rows: list[list[object]]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(map(_cell, r)) + " |" for r in rows]])


def signals(now: dict[str, float], before: dict[str, float]) -> list[str]:
    """Rules on the newest period and the one before."""
    out = []
    for m, step in (("revenue_growth", 0.03), ("net_margin", 0.02), ("free_cash_flow_margin", 0.02)):
        if m in now and m in before and abs(now[m] - before[m]) >= step:
            out.append(f"{m} {'improved' if now[m] > before[m] else 'weakened'} by {abs(now[m] - before[m]):.1%}")
    if now.get("current_ratio", 1) < 1:
        out.append("current_ratio is below 1")
    if now.get("liabilities_to_assets", 0) > 0.7:
        out.append("liabilities_to_assets is above 70%")
    return out


def financial(metrics: DataFrame, cik: int, limit: int = 60) -> str:
    rows = metrics.where(F.col("cik") == cik).select("period_end", "metric", "value", "display_value").orderBy(F.desc("period_end"), "metric").collect()
    periods = sorted({r.period_end for r in rows}, reverse=True)
    by = {(r.period_end, r.metric): r for r in rows}
    if not periods:
        return f"# Financial report {cik}\n\nNo data.\n"
    at = lambda p: {m: r.value for (q, m), r in by.items() if q == p}
    latest = [[r.metric, r.display_value] for r in rows if r.period_end == periods[0]][:limit]
    trend = [[m, *[by[p, m].display_value if (p, m) in by else None for p in periods]] for m in TREND]
    found = signals(at(periods[0]), at(periods[1]) if len(periods) > 1 else {})
    return f"# Financial report {cik}\n\n## Latest metrics ({periods[0]})\n\n{table(['metric', 'value'], latest)}\n\n## Trend\n\n{table(['metric', *periods], trend)}\n\n## Signals\n\n" + ("\n".join(f"- {s}" for s in found) or "- none") + "\n"


def insider(summaries: DataFrame, limit: int = 20) -> str:
    cols = [c for c in ("owner", "transaction_count", "acquired_shares", "disposed_shares", "net_shares", "net_value") if c in summaries.columns]
    return "# Insider report\n\n" + table(cols, [list(r) for r in summaries.select(*cols).orderBy(F.abs("net_shares").desc()).limit(limit).collect()]) + "\n"


def portfolio(current: DataFrame, changes: DataFrame, cik: int, limit: int = 10) -> str:
    from filigree.functions.scalars import bar

    mine = current.where(F.col("cik") == cik)
    most = mine.agg(F.max("value_usd"), F.sum("value_usd"), F.count("*")).first()
    top = mine.select("cusip", "class", "value_usd", bar(F.col("value_usd"), F.lit(float(most[0] or 0))).alias("bar")).orderBy(F.desc("value_usd"), "cusip").limit(limit).collect()
    moved = changes.where(F.col("cik") == cik).orderBy(*diff_order()).select("cusip", "class", "change_type", "value_change").limit(limit).collect()
    return f"# Portfolio report {cik}\n\n{most[2]} positions, {most[1] or 0:,} USD\n\n## Top holdings\n\n{table(['cusip', 'class', 'value', 'share'], [list(r) for r in top])}\n\n## Changes\n\n{table(['cusip', 'class', 'change', 'value change'], [list(r) for r in moved])}\n"


def risk(sections: DataFrame, limit_bytes: int = 4000, cik: int | None = None) -> str:
    """Risk factors, and half as many bytes of management's discussion, of one company where sections of several are given."""
    from filigree.functions.texts import cut_bytes

    parts = []
    sections = sections if cik is None else sections.where(F.col("cik") == cik)
    for r in sections.where(F.col("item").isin("1A", "7")).orderBy("item").collect():
        parts.append(f"## {r.title}\n\n{cut_bytes(r.content, limit_bytes if r.item == '1A' else limit_bytes // 2)[0]}\n")
    return "# Risk report\n\n" + "\n".join(parts)


def agent_pack(filings: DataFrame, sections: DataFrame, metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a company with its filings, sections, metrics, scores and source addresses."""
    pack = lambda df, name: df.groupBy("cik").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "cik"])).alias(name))
    out = pack(filings, "filings")
    for df, name in ((sections, "sections"), (metrics, "metrics"), (scores, "scores")):
        out = out.join(pack(df, name), "cik", "left")
    urls = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("metrics", F.array().cast(pack(metrics, "m").schema["m"].dataType)), lambda m: m["source_urls"]))))
    return out.withColumn("source_urls", urls).withColumn("next_commands", F.array(F.format_string("statements --cik %d", "cik"), F.format_string("metrics --cik %d", "cik")))
