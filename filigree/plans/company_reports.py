"""Markdown reports of all companies at once: every report is one row, put together by aggregates.

Rows of a company are ranked and limited before they are gathered, so a list has
at most ``limit`` entries (or the metrics of a few periods); no result passes the
driver. ``subjects`` (cik, subject) names the companies that get a report, also
those without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.scalars import bar, cell, compact_number, dollars, signed_dollars, signed_number
from filigree.operators.holdings import diff_order
from filigree.plans.metrics import METRICS

_NAMES = [m[0] for m in METRICS]
#: Columns of the trend table.
TREND = [("Revenue growth", "revenue_growth"), ("Net margin", "net_margin"), ("FCF margin", "free_cash_flow_margin"), ("ROA", "return_on_assets"), ("ROE", "return_on_equity"), ("Current ratio", "current_ratio"), ("Liabilities/assets", "liabilities_to_assets")]
#: Metrics whose change since the period before is a signal from this step on.
STEPS = [("Revenue growth", "revenue_growth", 0.03), ("Net margin", "net_margin", 0.02), ("Free cash flow margin", "free_cash_flow_margin", 0.02)]


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def opt(c: Column) -> Column:
    return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", "-").otherwise(c.cast("string"))


def row(*cells: Column) -> Column:
    out: list[Column | str] = ["| "]
    for i, c in enumerate(cells):
        out += [c] if i == 0 else [" | ", c]
    return text(*out, " |\n")


def header(title: str) -> Column:
    return text(f"# {title}\n\n- Subject: ", F.col("subject"), "\n- CIK: ", F.col("cik").cast("string"), "\n\n")


def head(*names: str, right: tuple[int, ...] = ()) -> str:
    return "| " + " | ".join(names) + " |\n| " + " | ".join("---:" if i in right else "---" for i in range(len(names))) + " |\n"


def lines(rows: DataFrame, order: list[Column], limit: int, one: Column, name: str) -> DataFrame:
    """(cik, name): the first ``limit`` lines of each company in one text."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy(*order))).where(F.col("_n") <= limit)
    return ranked.groupBy("cik").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("x")))), lambda e: e["x"]), "").alias(name))


def _shown(display: Column, unit: Column, value: Column) -> Column:
    amount = F.when(value < 0, text("-", dollars(F.round(-value)))).otherwise(dollars(F.round(value)))
    return F.when((unit == "USD") & value.isNotNull(), amount).otherwise(F.coalesce(display, F.format_string("%.4f", value), F.lit("-")))


def financial_reports(metrics: DataFrame, subjects: DataFrame, latest: int = 4, limit: int = 60) -> DataFrame:
    """(cik, markdown): the newest period's metrics, a trend over ``latest`` periods, and signals of the two newest."""
    place = F.array_position(F.array(*[F.lit(n) for n in _NAMES]), F.col("metric"))
    c = F.col("components")
    calculation = F.concat_ws(" / ", F.get(c, F.lit(0))["key"], F.get(c, F.lit(1))["key"])
    link = F.when(F.size("source_urls") > 0, text("[SEC](", F.get("source_urls", F.lit(0)), ")")).otherwise("-")
    shown = _shown(F.col("display_value"), F.col("unit"), F.col("value"))
    one = row(F.col("metric"), F.col("category"), shown, F.col("period_end"), cell(calculation), link)
    m = metrics.where(F.col("period_end").isNotNull()).groupBy("cik").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "period_end", "metric", shown.alias("shown"), "value", one.alias("line")))).alias("ms"))
    m = m.withColumn("periods", F.reverse(F.array_sort(F.array_distinct(F.transform("ms", lambda x: x["period_end"])))))
    of = lambda p: F.map_from_entries(F.transform(F.filter("ms", lambda x: x["period_end"] == p), lambda x: F.struct(x["metric"], F.struct(x["shown"].alias("shown"), x["value"].alias("value")))))
    newest = F.slice(F.filter("ms", lambda x: x["period_end"] == F.get("periods", F.lit(0))), 1, limit)
    trend = F.transform(F.slice("periods", 1, latest), lambda p: text("| ", p, *[x for _, k in TREND for x in (" | ", F.coalesce(of(p)[k]["shown"], F.lit("-")))], " |\n"))
    m = m.select("cik", F.size("periods").alias("n"), F.array_join(F.transform(newest, lambda x: x["line"]), "").alias("newest"), F.array_join(trend, "").alias("trend"), of(F.get("periods", F.lit(0))).alias("now"), F.when(F.size("periods") > 1, of(F.get("periods", F.lit(1)))).alias("before"))
    found = []
    for label, k, step in STEPS:
        now, before = F.col("now")[k], F.col("before")[k]
        delta = now["value"] - before["value"]
        found.append(F.when(F.abs(delta) >= step, text(f"- {label} ", F.when(delta > 0, "improved").otherwise("weakened"), ": ", now["shown"], " vs ", before["shown"], " in the prior period.\n")))
    ratio, debt = F.col("now")["current_ratio"], F.col("now")["liabilities_to_assets"]
    found += [F.when(ratio["value"] < 1, text("- Current ratio is below 1.0x at ", ratio["shown"], ".\n")), F.when(debt["value"] > 0.7, text("- Liabilities/assets is elevated at ", debt["shown"], ".\n"))]
    said = F.array_join(F.array_compact(F.array(*found)), "")
    signals = F.when(F.coalesce("n", F.lit(0)) == 0, "- No comparable metric periods were available.\n").when(said == "", "- No threshold-based signals fired for the latest period.\n").otherwise(said)
    body = text(header("Financial Trend Report"), "## Latest metrics\n\n", head("Metric", "Category", "Value", "Period", "Calculation", "Source", right=(2,)), F.coalesce("newest", F.lit("")), "\n## Trend snapshot\n\n", head("Period", *[n for n, _ in TREND], right=tuple(range(1, 8))), F.coalesce("trend", F.lit("")), "\n## Rule-based signals\n\n", signals, "\nUse `sec metrics` for stable JSON with component facts and source URLs.\n")
    return subjects.join(m, "cik", "left").select("cik", body.alias("markdown"))


def insider_reports(reports: DataFrame, subjects: DataFrame, limit: int = 20) -> DataFrame:
    """(cik, markdown) of report summaries (cik, filing_date, period_of_report, owner, role, net_shares, total_value, source_url, pos)."""
    one = row(opt(F.col("filing_date")), opt(F.col("period_of_report")), cell(opt(F.col("owner"))), cell(opt(F.col("role"))), signed_number(F.coalesce("net_shares", F.lit(0.0))), dollars(F.floor(F.coalesce("total_value", F.lit(0.0)))), text("[SEC](", F.col("source_url"), ")"))
    r = lines(reports, [F.col("pos")], limit, one, "lines")
    body = text(header("Insider Activity Report"), "## Form 4 report summaries\n\n", head("Filing date", "Period", "Owner", "Role", "Net shares", "Value", "Source", right=(4, 5)), F.coalesce("lines", F.lit("")), "\nUse `sec form4` for row-level transactions and `sec form4-summary` for stable JSON.\n")
    return subjects.join(r, "cik", "left").select("cik", body.alias("markdown"))


def portfolio_reports(summaries: DataFrame, current: DataFrame, changes: DataFrame, subjects: DataFrame, limit: int = 10) -> DataFrame:
    """(cik, markdown) of the newest report's summary (cik, report_date, report_type, entry_total, value, source_url), its
    aggregated holdings (cik, issuer, cusip, value_usd, shares) and the changes since the report before."""
    most = Window.partitionBy("cik")
    held = current.withColumn("_most", F.max("value_usd").over(most))
    top = lines(held, [F.col("value_usd").desc(), F.col("cusip"), F.col("issuer")], limit, row(cell(opt(F.col("issuer"))), opt(F.col("cusip")), dollars(F.col("value_usd")), compact_number(F.col("shares")), bar(F.col("value_usd").cast("double"), F.col("_most").cast("double"))), "top")
    moved = lines(changes, [*diff_order(), F.col("cusip")], limit, row(F.col("change_type"), cell(opt(F.col("issuer"))), opt(F.col("cusip")), signed_number(F.col("share_change")), signed_dollars(F.col("value_change")), text("[SEC](", opt(F.col("source_url")), ")")), "moved")
    summary = text("## Latest 13F summary\n\n- Report date: ", opt(F.col("report_date")), "\n- Report type: ", opt(F.col("report_type")), "\n- Total holdings: ", opt(F.col("entry_total")), "\n- Total value: ", F.coalesce(dollars(F.col("value")), F.lit("-")), "\n- Source: [SEC](", F.col("source_url"), ")\n\n")
    s = summaries.select("cik", summary.alias("summary"))
    body = text(header("13F Portfolio Report"), F.coalesce("summary", F.lit("")), "## Top holdings\n\n", head("Holding", "CUSIP", "Value", "Shares", "Visual", right=(2, 3)), F.coalesce("top", F.lit("")), "\n## Largest position changes\n\n", head("Change", "Holding", "CUSIP", "Shares delta", "Value delta", "Source", right=(3, 4)), F.coalesce("moved", F.lit("")))
    return subjects.join(s, "cik", "left").join(top, "cik", "left").join(moved, "cik", "left").select("cik", body.alias("markdown"))


def risk_reports(sections: DataFrame, subjects: DataFrame) -> DataFrame:
    """(cik, markdown) of the risk factors and management's discussion (cik, item, form, filing_date, source_url, content, byte_length, returned_bytes), one section each."""
    one = text("- Filing: ", F.col("form"), " ", F.col("filing_date"), "\n- Source: [SEC](", F.col("source_url"), ")\n- Returned bytes: ", F.col("returned_bytes").cast("string"), " / ", F.col("byte_length").cast("string"), "\n\n> ", F.replace("content", F.lit("\n"), F.lit(" ")), "\n\n")
    newest = lambda item: F.max_by(F.when(F.col("item") == item, one), F.when(F.col("item") == item, F.struct("filing_date", "source_url")))
    s = sections.where(F.col("item").isin("1A", "7")).groupBy("cik").agg(newest("1A").alias("risk"), newest("7").alias("mda"))
    part = lambda title, c: text(f"## {title}\n\n", F.coalesce(c, F.lit("No section was extracted for the selected filing.\n\n")))
    body = text(header("10-K Risk and MD&A Report"), part("Risk Factors", F.col("risk")), part("MD&A", F.col("mda")), "Use `sec section --item risk-factors` or `sec section --item mda` for stable JSON excerpts.\n")
    return subjects.join(s, "cik", "left").select("cik", body.alias("markdown"))


def agent_packs(subjects: DataFrame, filings: DataFrame, sections: DataFrame, metrics: DataFrame, scores: DataFrame, form: str, latest: int, metrics_latest: int, requested: list[str]) -> DataFrame:
    """One row a company: its filings, sections, metrics and scores with their counts, all source addresses, and what to ask next.

    The four inputs carry cik and, all but metrics and scores, ``source_url``; these carry ``source_urls``. Each is
    gathered by one aggregation, limited before by whoever made it.
    """
    pack = lambda df, name, url: df.groupBy("cik").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "cik"])).alias(name), F.flatten(F.collect_list(url)).alias(f"_{name}"))
    out = subjects.select("cik")
    for df, name, url in ((filings, "filings", F.array("source_url")), (sections, "sections", F.array("source_url")), (metrics, "metrics", F.col("source_urls")), (scores, "scores", F.col("source_urls"))):
        out = out.join(pack(df, name, url), "cik", "left")
    count = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))), F.lit(0))
    urls = F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(f"_{c}", F.array().cast("array<string>")) for c in ("filings", "sections", "metrics", "scores")]))))
    c = F.col("cik").cast("string")
    commands = F.array(
        text("sec archive --cik ", c, f" --form {form} --latest {latest} --primary-only --out-dir ./archives/", c), text("sec export --kind metrics --cik ", c, f" --period annual --latest {metrics_latest} --format parquet --out metrics.parquet"), text("sec report --cik ", c, f" --kind financial --latest {latest}"),
    )
    return out.select("cik", F.lit(form).alias("form"), F.lit(latest).alias("latest"), F.array(*[F.lit(r) for r in requested]).cast("array<string>").alias("sections_requested"), *[count(n).alias(f"{n[:-1]}_count") for n in ("filings", "sections", "metrics", "scores")], "filings", "sections", "metrics", "scores", urls.alias("source_urls"), commands.alias("next_commands"))


def write_reports(reports: DataFrame, root: str) -> None:
    """Each company's report as a file of its own."""
    from filigree.plans.archive import write_files

    write_files(reports.select(F.concat(F.lit("cik="), F.col("cik").cast("string")).alias("folder"), F.lit("report.md").alias("name"), F.col("markdown").alias("content")), root)
