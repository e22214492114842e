"""Registered queries of reports, the agent pack and exports: what is written or composed for all companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.functions import scalars as X
from filigree.operators import holdings, insiders
from filigree.plans import company_reports as R
from filigree.plans.export import KINDS, as_strings, export, read_arrow, write
from filigree.plans.forms import _table, _text
from filigree.plans.metrics import financial_metrics
from filigree.plans.oracles import ORACLES as _O
from filigree.sources import adapters
from filigree.sources.shared import shared_folder, stored


def _subjects(s, d):
    return _table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("cik"), F.col("n_name").alias("subject"))


def financial_report(s, d):
    """The head, the signals and the sizes of every nation's report."""
    m = financial_metrics(adapters.facts(s, d), latest=4).where(F.col("metric").isin("current_ratio", "net_margin", "revenue_growth"))
    r = R.financial_reports(m, _subjects(s, d), latest=3, limit=2)
    rows = lambda title, until: F.size(F.split(F.substring_index(F.substring_index("markdown", title, -1), until, 1), "\n")) - 4
    return r.select("cik", F.substring_index("markdown", "\n", 4).alias("head"), rows("## Latest metrics\n", "\n## ").alias("latest"), rows("## Trend snapshot\n", "\n## ").alias("trend"), F.contains("markdown", F.lit("- Current ratio is below 1.0x at ")).alias("illiquid"))


def insider_report(s, d):
    """Every owner's report: two of its filings, newest first."""
    t = insiders.summary(adapters.run(s, d, adapters.INSIDERS).withColumn("filing", F.col("pos") % 3), ["owner", "filing"]).withColumnRenamed("owner", "cik")
    t = t.select("cik", F.concat(F.lit("2024-01-0"), (F.col("filing") + 1).cast("string")).alias("filing_date"), F.lit("").alias("period_of_report"), F.concat(F.lit("Owner | "), F.col("cik").cast("string")).alias("owner"), F.lit(None).cast("string").alias("role"), "net_shares", F.col("acquired_value").alias("total_value"), F.concat(F.lit("u/"), F.col("filing").cast("string")).alias("source_url"), (-F.col("filing")).alias("pos"))
    subjects = t.select("cik").distinct().select("cik", F.concat(F.lit("S"), F.col("cik").cast("string")).alias("subject"))
    return R.insider_reports(t, subjects, 2)


def portfolio_report(s, d):
    """Every manager's three largest holdings and changes."""
    h = holdings.aggregate(holdings.scaled(adapters.run(s, d, adapters.HOLDINGS)))
    now, before = holdings.two_newest(h)
    key = ["cik", "cusip"]
    flat = lambda x: x.groupBy(*key).agg(F.sum("value_usd").alias("value_usd"), F.sum("shares").alias("shares"), F.sum("row_count").alias("row_count")).withColumn("issuer", F.concat(F.lit("I"), "cusip")).withColumn("class", F.lit("c")).withColumn("put_call", F.lit(None).cast("string"))
    now, before = flat(now), flat(before)
    changes = holdings.diff(now, before).withColumn("issuer", F.concat(F.lit("I"), "cusip")).withColumn("source_url", F.lit("u"))
    summary = now.groupBy("cik").agg(F.count("*").alias("entry_total"), F.sum("value_usd").alias("value")).withColumn("report_date", F.lit("2024-03-31")).withColumn("report_type", F.lit(None).cast("string")).withColumn("source_url", F.lit("s"))
    subjects = _table(s, d, "supplier").select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("subject"))
    r = R.portfolio_reports(summary, now, changes, subjects, 3)
    return r.select("cik", F.substring_index("markdown", "\n## Largest position changes", 1).alias("top"), (F.size(F.split("markdown", "\n")) - F.size(F.split(F.substring_index("markdown", "\n## Largest position changes", 1), "\n")) - 5).alias("changes"))


def risk_report(s, d):
    """Every customer's report; each third has no discussion, each fifth no risk factors."""
    c = _table(s, d, "customer").withColumnRenamed("c_custkey", "cik")
    part = lambda item, body: c.select("cik", F.lit(item).alias("item"), F.lit("10-K").alias("form"), F.lit("2024-02-01").alias("filing_date"), F.concat(F.lit("u"), F.col("cik").cast("string")).alias("source_url"), body.alias("content"), F.lit(900).alias("byte_length"), F.lit(40).alias("returned_bytes"))
    sections = part("1A", _text("Risks of\n{c_mktsegment}")).where("cik % 5 <> 0").unionByName(part("7", _text("We sold {c_nationkey}.")).where("cik % 3 <> 0")).unionByName(part("1A", F.lit("older")).withColumn("filing_date", F.lit("2023-02-01")))
    return R.risk_reports(sections, c.select("cik", F.col("c_name").alias("subject")))


def number_formats(s, d):
    """Dollars, signs and compact numbers of parts."""
    v = F.col("p_partkey") - 900
    return _table(s, d, "part").select("p_partkey", X.dollars(F.col("p_partkey") * 1000).alias("dollars"), X.signed_dollars(v).alias("signed"), X.signed_number(v / 4).alias("number"), X.compact_number(F.col("p_partkey").cast("double")).alias("compact"), X.cell(F.concat("p_name", F.lit("|\n"), "p_brand")).alias("cell"))


def exported_kinds(s, d):
    """All kinds of exports in both formats, read back and counted by company; five of them read the facts, which are made once."""
    root, facts, out = shared_folder(s, "exports"), stored(adapters.facts(s, d), "facts"), None
    for i, (kind, source, query) in enumerate([("filings", adapters.run(s, d, adapters.FILINGS), {"form": "10-K", "amendments": True}), ("facts", facts, {"concept": "us-gaap:Revenue"}), ("statements", facts, {"latest": 2}), ("stitch", facts, {"latest": 4}), ("metrics", facts, {"latest": 4}), ("scores", facts, {"latest": 4})]):
        fmt = "arrow" if i % 2 else "parquet"
        n = export(kind, source, f"{root}/{kind}", fmt, **query)
        back = read_arrow(s, f"{root}/{kind}", as_strings(KINDS[kind](source, **query)).schema) if fmt == "arrow" else s.read.parquet(f"{root}/{kind}")
        rows = back.groupBy(F.col("cik").cast("long").alias("cik")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "cik", "n", F.lit(n).cast("long").alias("written"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_array(s, d):
    """Customers written as one pretty JSON array, read back."""
    path = f"{shared_folder(s, 'array')}.json"
    write(_table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(1), F.col("c_nationkey"))).alias("x")), path, "pretty")
    return s.read.option("multiLine", True).schema("c_custkey long, c_name string, x array<int>").json(path).select("c_custkey", "c_name", F.element_at("x", 2).alias("nation"))


def agent_pack(s, d):
    """The pack of every nation: two 10-K reports by customers of its number, a section, metrics of four periods and scores of one."""
    from filigree.functions.scalars import index_url
    from filigree.plans.scores import health_scores
    from filigree.sources.filings import filings

    facts = stored(adapters.facts(s, d), "facts")
    f = filings(adapters.run(s, d, adapters.FILINGS).where("cik < 25"), form="10-K", latest=2, order=[F.col("filing_date").desc(), F.col("pos")]).withColumn("source_url", index_url(F.col("cik"), F.col("accession")))
    sections = f.where("pos % 2 = 0").select("cik", F.lit("1A").alias("item"), F.concat(F.lit("risk of "), "accession").alias("content"), F.concat(F.lit("s/"), "accession").alias("source_url"))
    r = R.agent_packs(_subjects(s, d), f, sections, financial_metrics(facts, latest=4), health_scores(facts, latest=1), "10-K", 2, 4, ["risk-factors"])
    return r.select("cik", "form", "latest", F.array_join("sections_requested", ",").alias("requested"), *[F.col(f"{n}_count") for n in ("filing", "section", "metric", "score")], F.size(F.filter("source_urls", lambda u: u.startswith("s/"))).alias("section_urls"), F.array_join("next_commands", "; ").alias("commands"))


def search_addresses(s, d):
    """Pages of a search for every customer's name, with forms, companies and dates."""
    from filigree.sources.filings import search_pages

    k = F.col("c_custkey")
    r = _table(s, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit(" & co")).alias("query"), F.when(k % 3 == 0, F.array(F.lit("10-K"), F.lit("SC 13D/A"))).alias("forms"), F.when(k % 2 == 0, F.array(k, k + 1)).otherwise(F.array().cast("array<bigint>")).alias("ciks"), F.when(k % 4 == 0, F.lit("2024-01-01")).alias("start"), F.when(k % 4 < 2, F.lit("2024-02-01")).alias("end"), F.when(k % 5 > 0, (k % 5 * 70).cast("int")).alias("size"))
    return search_pages(r).select("c_custkey", "page", "url")


def limited_tables(s, d):
    """At most two tables of two rows each of a page a nation; the index counts the empty ones."""
    from filigree.functions import texts
    from filigree.sources.parse import parsed

    docs = _table(s, d, "nation").select("n_nationkey", _text("<p>First of {n_name}</p><table><tr><td>a</td></tr><tr><td>{n_nationkey}</td><td>x</td></tr><tr><td>c</td></tr></table><table><tr><td> </td></tr></table><h3>Second</h3><table><tr><th>h</th></tr></table><table><tr><td>late</td></tr></table>").alias("content"))
    t = parsed(docs, ["n_nationkey"], "content", lambda x: texts.tables(x, 2, 2), texts.TABLES)
    return t.select("n_nationkey", "table_index", "title_hint", "row_count", "column_count", "returned_rows", "truncated", F.array_join(F.flatten("rows"), "|").alias("cells"))


QUERIES = {f.__name__: f for f in (agent_pack, search_addresses, limited_tables, financial_report, insider_report, portfolio_report, risk_report, number_formats, exported_kinds, json_array)}

_HEADER = "'# {title}' || chr(10) || chr(10) || '- Subject: ' || {subject} || chr(10) || '- CIK: ' || {cik}"
_N = "chr(10)"
_DOLLARS = "'$' || format('{{:,}}', {0})"

ORACLES = {
    "financial_report": f"""WITH m AS (SELECT * FROM ({_O['metrics_long']}) WHERE metric IN ('current_ratio', 'net_margin', 'revenue_growth')), p AS (SELECT cik, period_end, count(*) AS n, max(CASE WHEN metric = 'current_ratio' THEN value END) AS ratio, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS k FROM m GROUP BY 1, 2)
SELECT n_nationkey::BIGINT AS cik, {_HEADER.format(title='Financial Trend Report', subject='n_name', cik='n_nationkey')} AS head, coalesce((SELECT least(n, 2) FROM p WHERE p.cik = n_nationkey AND k = 1), 0)::INT AS latest, (SELECT count(*) FROM p WHERE p.cik = n_nationkey AND k <= 3)::INT AS trend,
  coalesce((SELECT ratio < 1 FROM p WHERE p.cik = n_nationkey AND k = 1), false) AS illiquid FROM nation""",
    "insider_report": f"""WITH t AS (SELECT user_id AS cik, event_id % 3 AS filing, coalesce(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN shares WHEN event_type = 'view' THEN 0 ELSE -shares END), 0)::BIGINT AS net, coalesce(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN shares * price ELSE 0 END), 0)::BIGINT AS value
  FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN floor(value * 100) END AS shares, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS price FROM events) GROUP BY 1, 2),
l AS (SELECT cik, filing, '| 2024-01-0' || (filing + 1) || ' | - | Owner \\| ' || cik || ' | - | ' || CASE WHEN net > 0 THEN '+' WHEN net < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(net)) || ' | $' || format('{{:,}}', value) || ' | [SEC](u/' || filing || ') |' || {_N} AS line FROM t QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing DESC) <= 2)
SELECT cik, {_HEADER.format(title='Insider Activity Report', subject="'S' || cik", cik='cik')} || {_N} || {_N} || '## Form 4 report summaries' || {_N} || {_N} || '| Filing date | Period | Owner | Role | Net shares | Value | Source |' || {_N} || '| --- | --- | --- | --- | ---: | ---: | --- |' || {_N} || string_agg(line, '' ORDER BY filing DESC) || {_N} || 'Use `sec form4` for row-level transactions and `sec form4-summary` for stable JSON.' || {_N} AS markdown FROM l GROUP BY cik""",
    "portfolio_report": _O["holdings_diff"].rpartition("\nSELECT")[0] + f""", n AS (SELECT cik, cusip, sum(value_usd)::BIGINT AS v, sum(shares)::BIGINT AS sh FROM x GROUP BY 1, 2), q AS (SELECT *, max(v) OVER (PARTITION BY cik) AS m, count(*) OVER (PARTITION BY cik) AS c, sum(v) OVER (PARTITION BY cik)::BIGINT AS s FROM n),
k AS (SELECT *, round(v::DOUBLE / m * 12)::INT AS w FROM q QUALIFY row_number() OVER (PARTITION BY cik ORDER BY v DESC, cusip) <= 3), u AS (SELECT cik, least(3, count(DISTINCT cusip))::INT AS changes FROM (SELECT cik, cusip FROM x UNION SELECT cik, cusip FROM y) GROUP BY 1),
t AS (SELECT cik, any_value(c) AS c, any_value(s) AS s, string_agg('| I' || cusip || ' | ' || cusip || ' | $' || format('{{:,}}', v) || ' | ' || format('{{:,}}', sh) || ' | ' || repeat('#', w) || repeat('.', 12 - w) || ' |' || {_N}, '' ORDER BY v DESC, cusip) AS lines FROM k GROUP BY 1)
SELECT s_suppkey AS cik, {_HEADER.format(title='13F Portfolio Report', subject='s_name', cik='s_suppkey')} || {_N} || {_N} || CASE WHEN t.cik IS NULL THEN '' ELSE '## Latest 13F summary' || {_N} || {_N} || '- Report date: 2024-03-31' || {_N} || '- Report type: -' || {_N} || '- Total holdings: ' || c || {_N} || '- Total value: $' || format('{{:,}}', s) || {_N} || '- Source: [SEC](s)' || {_N} || {_N} END
  || '## Top holdings' || {_N} || {_N} || '| Holding | CUSIP | Value | Shares | Visual |' || {_N} || '| --- | --- | ---: | ---: | --- |' || {_N} || coalesce(lines, '') AS top, coalesce(changes, 0)::INT AS changes FROM supplier LEFT JOIN t ON t.cik = s_suppkey LEFT JOIN u ON u.cik = s_suppkey""",
    "agent_pack": f"""WITH f AS (SELECT c_custkey AS cik, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority[1] = '1' AND o_orderstatus <> 'P' AND c_custkey < 25 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) <= 2),
m AS (SELECT cik, count(*) AS n FROM ({_O['metrics_long']}) GROUP BY 1), c AS (SELECT cik, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY period_end DESC) AS k FROM ({_O['scores']})) WHERE k = 1 GROUP BY 1),
n AS (SELECT n_nationkey::BIGINT AS cik, (SELECT count(*) FROM f WHERE f.cik = n_nationkey)::INT AS filing_count, (SELECT count(*) FROM f WHERE f.cik = n_nationkey AND pos % 2 = 0)::INT AS section_count FROM nation)
SELECT n.cik, '10-K' AS form, 2 AS latest, 'risk-factors' AS requested, filing_count, section_count, coalesce(m.n, 0)::INT AS metric_count, coalesce(c.n, 0)::INT AS score_count, section_count AS section_urls,
  'sec archive --cik ' || n.cik || ' --form 10-K --latest 2 --primary-only --out-dir ./archives/' || n.cik || '; sec export --kind metrics --cik ' || n.cik || ' --period annual --latest 4 --format parquet --out metrics.parquet; sec report --cik ' || n.cik || ' --kind financial --latest 2' AS commands
FROM n LEFT JOIN m ON m.cik = n.cik LEFT JOIN c ON c.cik = n.cik""",
    "search_addresses": """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 * 70 END AS size, c_custkey AS k, c_name FROM customer), p AS (SELECT *, unnest(CASE WHEN size IS NULL THEN [0] ELSE range(0, size, 100) END) AS o FROM r)
SELECT c_custkey, (o // 100)::INT AS page, 'https://efts.sec.gov/LATEST/search-index?q=' || replace(c_name, '#', '%23') || '+%26+co&from=' || o || CASE WHEN size IS NULL THEN '' ELSE '&size=' || least(size - o, 100) END || CASE WHEN k % 4 < 2 THEN '&dateRange=custom' ELSE '&dateRange=all' END || CASE WHEN k % 4 = 0 THEN '&startdt=2024-01-01' ELSE '' END || CASE WHEN k % 4 < 2 THEN '&enddt=2024-02-01' ELSE '' END
  || CASE WHEN k % 3 = 0 THEN '&forms=10-K%2CSC+13D%2FA' ELSE '' END || CASE WHEN k % 2 = 0 THEN '&ciks=' || lpad(k::VARCHAR, 10, '0') || '%2C' || lpad((k + 1)::VARCHAR, 10, '0') ELSE '' END AS url FROM p""",
    "limited_tables": """SELECT n_nationkey, i AS table_index, 'First of ' || n_name || CASE i WHEN 1 THEN '' ELSE ' a ' || n_nationkey || ' x c Second' END AS title_hint, r AS row_count, c AS column_count, least(r, 2)::INT AS returned_rows, r > 2 AS truncated, CASE i WHEN 1 THEN 'a|' || n_nationkey || '|x' ELSE 'h' END AS cells FROM nation, (VALUES (1, 3, 2), (3, 1, 1)) AS t(i, r, c)""",
    "risk_report": f"""SELECT c_custkey AS cik, {_HEADER.format(title='10-K Risk and MD&A Report', subject='c_name', cik='c_custkey')} || {_N} || {_N} || '## Risk Factors' || {_N} || {_N} || '- Filing: 10-K ' || CASE WHEN c_custkey % 5 = 0 THEN '2023' ELSE '2024' END || '-02-01' || {_N} || '- Source: [SEC](u' || c_custkey || ')' || {_N} || '- Returned bytes: 40 / 900' || {_N} || {_N} || '> ' || CASE WHEN c_custkey % 5 = 0 THEN 'older' ELSE 'Risks of ' || c_mktsegment END || {_N} || {_N} || '## MD&A' || {_N} || {_N}
  || CASE WHEN c_custkey % 3 = 0 THEN 'No section was extracted for the selected filing.' ELSE '- Filing: 10-K 2024-02-01' || {_N} || '- Source: [SEC](u' || c_custkey || ')' || {_N} || '- Returned bytes: 40 / 900' || {_N} || {_N} || '> We sold ' || c_nationkey || '.' END || {_N} || {_N} || 'Use `sec section --item risk-factors` or `sec section --item mda` for stable JSON excerpts.' || {_N} AS markdown FROM customer""",
    "number_formats": f"""WITH x AS (SELECT *, p_partkey - 900 AS v FROM part) SELECT p_partkey, {_DOLLARS.format('p_partkey * 1000')} AS dollars, CASE WHEN v < 0 THEN '-$' ELSE '+$' END || format('{{:,}}', abs(v)) AS signed,
  CASE WHEN v > 0 THEN '+' ELSE '' END || CASE WHEN v % 4 = 0 THEN CASE WHEN v < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(v) // 4) ELSE printf('%.2f', v / 4) END AS number, format('{{:,}}', p_partkey) AS compact, p_name || '\\|' || ' ' || p_brand AS cell FROM x""",
    "exported_kinds": " UNION ALL ".join(f"SELECT '{kind}' AS kind, cik, n, sum(n) OVER ()::BIGINT AS written FROM (SELECT cik::BIGINT AS cik, count(*) AS n FROM ({_O[of]}) GROUP BY 1)" for kind, of in (("filings", "filings_form_amend"), ("facts", "facts_by_alias"), ("statements", "statement_topk"), ("stitch", "stitch_best_form"), ("metrics", "metrics_long"), ("scores", "scores"))),
    "json_array": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nation FROM customer",
}
