"""SQL for the registered queries, written apart from the operators, over the same adapters."""

from __future__ import annotations

from filigree.functions.catalogue import EIGHTK_CATEGORIES, EIGHTK_ITEMS, FORM_FAMILIES, STATEMENTS, TOPICS, concepts_of
from filigree.plans.queries import EXHIBITS, TOPIC_WORDS
from filigree.sources import adapters

_A = {k: adapters.plain_sql(getattr(adapters, k)) for k in ("FILINGS", "FACTS", "HOLDINGS", "INSIDERS", "EDGES", "NODE_VALUES")}
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)

FILINGS = f"WITH f AS ({_A['FILINGS']}) "
FACTS = f"WITH f AS (SELECT *, 'USD' AS unit FROM ({_A['FACTS']})), "
_LINES = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {o}, '{i}', '{c}', {p})" for s, ls in STATEMENTS.items() for o, (i, k) in enumerate(ls, 1) for p, c in enumerate(concepts_of(k))) + ") AS t(statement, line_order, line_item, concept, priority)), "
_STMT = f"{FACTS}{_LINES}j AS (SELECT f.*, l.statement, l.line_order, l.line_item, l.priority, min(priority) OVER (PARTITION BY cik, statement, line_item) AS best FROM f JOIN l USING (concept) WHERE {{where}}), s AS (SELECT *, row_number() OVER (PARTITION BY cik, statement, line_item ORDER BY filed DESC, period DESC, accession DESC) AS n FROM j WHERE priority = best), "


def _statements(where: str = "true") -> str:
    return _STMT.replace("{where}", where)


_WIDE = (
    _statements()
    + "v AS (SELECT * FROM s WHERE n <= {k}), p AS (SELECT cik, period, "
    + ", ".join(f"arg_max(numeric_value, filed || accession) FILTER (statement = '{s}' AND line_item = '{i}') AS {s[0]}_{i}" for s, ls in STATEMENTS.items() for i, _ in ls)
    + """ FROM v GROUP BY cik, period),
d AS (SELECT *, row_number() OVER w AS rk,
  lead(i_revenue) OVER w AS pr, lead(i_net_income) OVER w AS pn,
  CASE WHEN b_current_debt IS NULL THEN b_long_term_debt ELSE b_current_debt + coalesce(b_long_term_debt, 0) END AS debt,
  CASE WHEN b_cash_and_equivalents IS NULL AND b_marketable_securities_current IS NULL THEN NULL ELSE coalesce(b_cash_and_equivalents, 0) + coalesce(b_marketable_securities_current, 0) END AS cs,
  c_operating_cash_flow - abs(c_capital_expenditures) AS fcf, b_current_assets - b_current_liabilities AS wc FROM p WINDOW w AS (PARTITION BY cik ORDER BY period DESC)),
e AS (SELECT *, debt - b_cash_and_equivalents AS nd, CASE WHEN cs IS NULL AND b_accounts_receivable IS NULL THEN NULL ELSE coalesce(cs, 0) + coalesce(b_accounts_receivable, 0) END AS qa,
  CASE WHEN debt IS NULL THEN b_stockholders_equity ELSE debt + coalesce(b_stockholders_equity, 0) END AS cap,
  i_operating_income * (1 - least(greatest(coalesce(i_income_tax_expense / nullif(i_income_before_tax, 0), 0), 0), 1)) + 0 * i_income_tax_expense + 0 * i_income_before_tax AS nopat FROM d),
g AS (SELECT *, CASE WHEN nd IS NULL THEN b_stockholders_equity ELSE nd + coalesce(b_stockholders_equity, 0) END AS ic FROM e)
"""
)

_RATIOS = {
    "gross_margin": "i_gross_profit/i_revenue", "operating_margin": "i_operating_income/i_revenue", "net_margin": "i_net_income/i_revenue", "free_cash_flow_margin": "fcf/i_revenue", "return_on_assets": "i_net_income/b_total_assets",
    "return_on_equity": "i_net_income/b_stockholders_equity", "liabilities_to_assets": "b_total_liabilities/b_total_assets", "cash_to_assets": "b_cash_and_equivalents/b_total_assets", "debt_to_equity": "debt/b_stockholders_equity",
    "debt_to_assets": "debt/b_total_assets", "net_debt_to_equity": "nd/b_stockholders_equity", "effective_tax_rate": "i_income_tax_expense/i_income_before_tax", "roic": "nopat/ic", "operating_cash_flow_margin": "c_operating_cash_flow/i_revenue",
    "free_cash_flow_to_net_income": "fcf/i_net_income", "capex_to_revenue": "abs(c_capital_expenditures)/i_revenue", "dividend_payout_ratio": "abs(c_dividends_paid)/i_net_income", "share_repurchases_to_revenue": "abs(c_share_repurchases)/i_revenue",
    "share_repurchases_to_free_cash_flow": "abs(c_share_repurchases)/fcf", "cost_of_revenue_margin": "i_cost_of_revenue/i_revenue", "rd_to_revenue": "i_research_and_development/i_revenue", "sga_to_revenue": "i_selling_general_admin/i_revenue",
    "operating_expense_ratio": "i_operating_expenses/i_revenue", "pretax_margin": "i_income_before_tax/i_revenue", "cash_flow_return_on_assets": "c_operating_cash_flow/b_total_assets", "cash_flow_to_debt": "c_operating_cash_flow/debt",
    "equity_ratio": "b_stockholders_equity/b_total_assets", "debt_to_capital": "debt/cap", "working_capital_to_assets": "wc/b_total_assets", "working_capital_to_revenue": "wc/i_revenue", "inventory_to_current_assets": "b_inventory/b_current_assets",
    "receivables_to_revenue": "b_accounts_receivable/i_revenue", "fcf_to_debt": "fcf/debt", "lease_liabilities_to_assets": "b_operating_lease_liabilities/b_total_assets", "goodwill_to_assets": "b_goodwill/b_total_assets",
    "intangibles_to_assets": "b_intangible_assets/b_total_assets", "marketable_securities_to_assets": "b_marketable_securities_current/b_total_assets", "cash_and_securities_to_assets": "cs/b_total_assets", "capex_to_operating_cash_flow": "abs(c_capital_expenditures)/c_operating_cash_flow",
}
_MULTIPLES = {
    "current_ratio": "b_current_assets/b_current_liabilities", "quick_ratio": "qa/b_current_liabilities", "cash_ratio": "b_cash_and_equivalents/b_current_liabilities", "interest_coverage": "i_operating_income/i_interest_expense", "asset_turnover": "i_revenue/b_total_assets",
    "cash_conversion": "c_operating_cash_flow/i_net_income", "inventory_turnover": "i_cost_of_revenue/b_inventory", "receivables_turnover": "i_revenue/b_accounts_receivable", "cash_and_securities_coverage": "cs/b_current_liabilities",
}


def _div(x: str) -> str:
    a, b = x.rsplit("/", 1)
    return f"{a} / nullif({b}, 0)"


_ROWS = [(k, "ratio", _div(x)) for k, x in _RATIOS.items()] + [(k, "multiple", _div(x)) for k, x in _MULTIPLES.items()]
_ROWS += [("revenue_growth", "ratio", "(i_revenue - pr) / nullif(abs(pr), 0)"), ("net_income_growth", "ratio", "(i_net_income - pn) / nullif(abs(pn), 0)")]
_ROWS += [("free_cash_flow", "USD", "fcf"), ("working_capital", "USD", "wc"), ("total_debt", "USD", "debt"), ("net_debt", "USD", "nd")]
_METRICS = " UNION ALL ".join(f"SELECT cik, period AS period_end, '{k}' AS metric, '{u}' AS unit, round({x}, 9) AS value FROM g WHERE rk <= 4 AND ({x}) IS NOT NULL" for k, u, x in _ROWS)

_SCORES = """, q AS (SELECT *, i_net_income / nullif(b_total_assets, 0) AS roa, b_total_liabilities / nullif(b_total_assets, 0) AS lev, b_current_assets / nullif(b_current_liabilities, 0) AS cr, i_gross_profit / nullif(i_revenue, 0) AS gm,
  i_revenue / nullif(b_total_assets, 0) AS turn, b_accounts_receivable / nullif(i_revenue, 0) AS rr, i_selling_general_admin / nullif(i_revenue, 0) AS sg,
  (b_total_assets - b_current_assets - b_property_plant_equipment) / nullif(b_total_assets, 0) AS aq, abs(c_depreciation_amortization) / nullif(abs(c_depreciation_amortization) + abs(b_property_plant_equipment), 0) AS dr FROM g),
t AS (SELECT *, lead(roa) OVER w AS roa0, lead(lev) OVER w AS lev0, lead(cr) OVER w AS cr0, lead(gm) OVER w AS gm0, lead(turn) OVER w AS turn0, lead(rr) OVER w AS rr0, lead(sg) OVER w AS sg0, lead(aq) OVER w AS aq0, lead(dr) OVER w AS dr0,
  lead(i_shares_diluted) OVER w AS sh0 FROM q WINDOW w AS (PARTITION BY cik ORDER BY period DESC)),
u AS (SELECT *,
  coalesce((i_net_income > 0)::INT, 0) + coalesce((c_operating_cash_flow > 0)::INT, 0) + coalesce((roa > roa0)::INT, 0) + coalesce((c_operating_cash_flow > i_net_income)::INT, 0) + coalesce((lev < lev0)::INT, 0) + coalesce((cr > cr0)::INT, 0)
  + coalesce((i_shares_diluted <= sh0)::INT, 0) + coalesce((gm > gm0)::INT, 0) + coalesce((turn > turn0)::INT, 0) AS pf,
  6.56 * (wc / nullif(b_total_assets, 0)) + 3.26 * (b_retained_earnings / nullif(b_total_assets, 0)) + 6.72 * (i_operating_income / nullif(b_total_assets, 0)) + 1.05 * (b_stockholders_equity / nullif(b_total_liabilities, 0)) AS az,
  -4.84 + 0.92 * (rr / nullif(rr0, 0)) + 0.528 * (gm0 / nullif(gm, 0)) + 0.404 * (aq / nullif(aq0, 0)) + 0.892 * (i_revenue / nullif(pr, 0)) + 0.115 * (dr0 / nullif(dr, 0)) - 0.172 * (sg / nullif(sg0, 0))
  + 4.679 * ((i_net_income - c_operating_cash_flow) / nullif(b_total_assets, 0)) - 0.327 * (lev / nullif(lev0, 0)) AS bm FROM t)
SELECT cik, period AS period_end, 'piotroski_f_score' AS score_name, pf::DOUBLE AS score, CASE WHEN pf >= 8 THEN 'strong' WHEN pf >= 5 THEN 'mixed' ELSE 'weak' END AS rating, pf AS passed FROM u WHERE rk <= 4
UNION ALL SELECT cik, period, 'altman_z_score_private', round(az, 8), CASE WHEN az IS NULL THEN 'insufficient_data' WHEN az > 2.6 THEN 'safe' WHEN az >= 1.1 THEN 'gray' ELSE 'distress' END, NULL FROM u WHERE rk <= 4
UNION ALL SELECT cik, period, 'beneish_m_score', round(bm, 8), CASE WHEN bm IS NULL THEN 'insufficient_data' WHEN bm > -1.78 THEN 'watch' ELSE 'low_risk' END, NULL FROM u WHERE rk <= 4
"""

_HOLD = f"WITH h AS ({_A['HOLDINGS']}), "
_USD = "CASE WHEN report_date <= '2022-09-30' THEN value * 1000 ELSE value END"
_AGG = f"{_HOLD}a AS (SELECT cik, accession, cusip, class, put_call, SUM({_USD})::BIGINT AS value_usd, SUM(shares) AS shares, COUNT(*) AS row_count, min(report_date) AS report_date FROM h GROUP BY cik, accession, cusip, class, put_call) "
_INS = f"WITH i AS ({_A['INSIDERS']}) "
_r4 = lambda x: f"round(({x}) * 10000) / 10000"
_sum_if = lambda c, f: _r4(f"SUM(CASE WHEN acquired_disposed = '{f}' THEN coalesce({c}, 0) ELSE 0 END)")
_TALLY = f"COUNT(*) AS transaction_count, {{derivative}}SUM((code = 'P')::INT)::BIGINT AS purchase_count, SUM((code = 'S')::INT)::BIGINT AS sale_count, {_sum_if('shares', 'A')} AS acquired_shares, {_sum_if('shares', 'D')} AS disposed_shares, {{values}}"
_VALUES = f"{_sum_if('shares * price', 'A')} AS acquired_value, {_sum_if('shares * price', 'D')} AS disposed_value"
_CODES = "CASE code WHEN 'P' THEN 'purchase' WHEN 'S' THEN 'sale' WHEN 'A' THEN 'grant/award' WHEN 'M' THEN 'option exercise/conversion' ELSE CASE acquired_disposed WHEN 'A' THEN 'acquisition' WHEN 'D' THEN 'disposition' END END"

_GRAPH = f"WITH e AS ({_A['EDGES']}), nv AS ({_A['NODE_VALUES']}), "
_WALK = """r AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)),
w AS (SELECT node, NULL AS parent, 0 AS depth, node AS a, NULL::DOUBLE AS o1, NULL AS b, NULL::DOUBLE AS o2, NULL AS c FROM r
  UNION ALL SELECT x.child, x.parent, 1, r.node, x.ord, x.child, NULL, NULL FROM r JOIN e x ON x.parent = r.node
  UNION ALL SELECT y.child, y.parent, 2, r.node, x.ord, x.child, y.ord, y.child FROM r JOIN e x ON x.parent = r.node JOIN e y ON y.parent = x.child),
t AS (SELECT *, row_number() OVER (ORDER BY a, o1 NULLS FIRST, b NULLS FIRST, o2 NULLS FIRST, c NULLS FIRST) AS line_order, concat_ws(' > ', a, b, c) AS path FROM w)"""
_CHECK = """k AS (SELECT e.parent, SUM(v.numeric_value * e.weight) AS calculated_value, COUNT(*) AS child_count, COUNT(v.numeric_value) AS matched_children FROM e LEFT JOIN nv v ON v.concept = e.child GROUP BY e.parent),
m AS (SELECT k.*, p.numeric_value AS parent_value, p.numeric_value - calculated_value AS difference FROM k LEFT JOIN nv p ON p.concept = k.parent),
s AS (SELECT *, CASE WHEN parent_value IS NULL THEN 'missing_parent' WHEN matched_children = 0 THEN 'missing_children' WHEN abs(difference) <= 0.5 OR abs(difference) / greatest(abs(parent_value), 2.220446049250313e-16) <= 0.5 THEN 'ok' ELSE 'mismatch' END AS status FROM m)"""


def _topic() -> str:
    words = f"[{_quoted(TOPIC_WORDS)}]"
    n = len(TOPIC_WORDS)
    hit = lambda ts: " + ".join(f"contains(w, '{t}')::INT" for t in ts)
    scores = ", ".join(f"2 * ({hit(p)}) + {hit(s)} AS s{i}" for i, (_, p, s) in enumerate(TOPICS))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(TOPICS))) + ")"
    pick = "CASE " + " ".join(f"WHEN s{i} = b THEN '{t}'" for i, (t, _, _) in enumerate(TOPICS)) + " END"
    return f"WITH p AS (SELECT p_partkey, lower(concat_ws(' ', p_name, {words}[p_partkey % {n} + 1], {words}[p_size % {n} + 1])) AS w FROM part), q AS (SELECT *, {scores} FROM p), z AS (SELECT *, {best} AS b FROM q) SELECT p_partkey, {pick} AS topic, least(b / 8.0, 1.0)::DOUBLE AS confidence FROM z WHERE b >= 3"


_EXHIBIT = f"""WITH x AS (SELECT *, [{_quoted(EXHIBITS)}][o_orderkey % {len(EXHIBITS)} + 1] AS k, CASE o_custkey % 5 WHEN 0 THEN 'q2-results.htm' WHEN 1 THEN 'press release.htm' ELSE '' END AS f FROM orders)
SELECT o_orderkey, CASE WHEN k LIKE 'EX-99%' AND f <> '' THEN 'earnings_release' WHEN k LIKE 'EX-99%' OR f = 'press release.htm' THEN 'press_release' WHEN k LIKE 'EX-10%' THEN 'material_contract' WHEN k LIKE 'EX-2%' THEN 'transaction_agreement'
  WHEN k LIKE 'EX-3%' THEN 'charter_or_bylaws' WHEN k LIKE 'EX-4%' THEN 'security_instrument' WHEN k LIKE 'EX-16%' THEN 'accountant_letter' ELSE 'other_exhibit' END AS category FROM x"""

_ITEMS = "(VALUES " + ", ".join(f"({i}, '{k}', '{v.replace(chr(39), chr(39) * 2)}', '{EIGHTK_CATEGORIES[k[0]]}')" for i, (k, v) in enumerate(EIGHTK_ITEMS.items())) + ") AS t(i, item, title, category)"

ORACLES = {
    "filings_latest": FILINGS + ", r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, pos) AS n FROM f) SELECT cik, accession, form, filing_date, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || accession || '.txt' AS text_url FROM r WHERE n <= 3",
    "filings_form_amend": FILINGS + "SELECT cik, accession, form, filing_date FROM f WHERE form IN ('10-K', '10-K/A')",
    "filings_date_range": FILINGS + "SELECT cik, accession, form, filing_date FROM f WHERE filing_date >= '1996-03-01' AND filing_date <= '1997-02-28'",
    "daily_company_filter": FILINGS + "SELECT cik, company, form, filing_date, '0-' || accession AS accession, 'edgar/data/' || cik || '/0-' || accession || '.txt' AS filename FROM f WHERE form IN ('8-K', '8-K/A') AND lower(company) LIKE '%customer#00000001%'",
    "merge_distinct": FILINGS + "SELECT cik, accession, form, filing_date FROM f WHERE form LIKE 'SC 13D%' OR form LIKE '8-K%' OR form LIKE '10-Q%'",
    "submissions_json": FILINGS + "SELECT cik, company, accession, form, filing_date, NULL::VARCHAR AS report_date, pos % 2 = 1 AS is_xbrl, (row_number() OVER (PARTITION BY cik ORDER BY pos) - 1)::INT AS pos FROM f",
    "company_facts_json": FACTS[:-2] + " SELECT cik, taxonomy, concept, unit, numeric_value, fy, form, filed, period AS \"end\", accession FROM f",
    "facts_by_alias": FACTS[:-2] + " SELECT cik, 'us-gaap:' || concept AS concept, numeric_value, form, filed, period AS \"end\", 'us-gaap:' || concept || ':' || accession || ':USD' AS fact_id FROM f WHERE concept IN ('Revenues', 'SalesRevenueNet')",
    "facts_topk": FACTS + "r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, period DESC, accession DESC) AS n FROM f WHERE concept = 'Liabilities' AND form IN ('10-K', '10-K/A')) SELECT cik, 'us-gaap:' || concept AS concept, numeric_value, form, filed, period AS \"end\", accession FROM r WHERE n <= 3",
    "statement_lines_priority": _statements("form IN ('10-K', '10-K/A') AND statement = 'income'") + "z AS (SELECT 1) SELECT cik, line_item, line_order, concept, numeric_value, form, filed, period AS \"end\" FROM s WHERE n <= 100",
    "statement_topk": _statements() + "z AS (SELECT 1) SELECT cik, statement, line_item, line_order, concept, numeric_value, form, filed, period AS \"end\" FROM s WHERE n <= 2",
    "stitch_best_form": _statements() + """c AS (SELECT *, row_number() OVER (PARTITION BY cik, statement, line_item, period ORDER BY CASE WHEN form = '10-K' AND fp = 'FY' THEN 0 WHEN form = '10-K/A' AND fp = 'FY' THEN 1 WHEN form = '10-Q' THEN 2 ELSE 9 END, filed DESC, accession DESC) AS pick,
  COUNT(*) OVER g AS source_count, list_sort(list_distinct(list(form) OVER g)) AS forms FROM s WHERE n <= 12 WINDOW g AS (PARTITION BY cik, statement, line_item, period)),
o AS (SELECT *, row_number() OVER (PARTITION BY cik, statement, line_item ORDER BY period DESC) AS rn FROM c WHERE pick = 1)
SELECT cik, statement, line_item, period AS "end", form, filed, numeric_value, CASE WHEN fp = 'FY' THEN 'annual' ELSE 'quarterly' END AS period_kind, array_to_string(forms, ',') AS duplicate_forms, source_count FROM o WHERE rn <= 4""",
    "metrics_long": _WIDE.replace("{k}", "5") + _METRICS,
    "scores": _WIDE.replace("{k}", "6") + _SCORES,
    "source_urls": _statements("statement = 'income'") + "u AS (SELECT DISTINCT cik, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || accession || '-index.html' AS url FROM s WHERE n <= 3) SELECT cik, string_agg(url, '|' ORDER BY url) AS urls FROM u GROUP BY cik",
    "holdings_scaled": _HOLD + "g AS (SELECT *, CASE WHEN report_date < '1998' THEN 'thousands' ELSE 'dollars' END AS value_scale FROM h) SELECT cik, value_scale, SUM(CASE WHEN value_scale = 'thousands' THEN value * 1000 ELSE value END)::BIGINT AS value_usd, COUNT(*) AS n FROM g GROUP BY ALL",
    "holdings_aggregate": _AGG + "SELECT * FROM a",
    "holdings_diff": _AGG.rstrip() + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY report_date DESC) AS d FROM a), x AS (SELECT * FROM r WHERE d = 1), y AS (SELECT * FROM r WHERE d = 2),
j AS (SELECT coalesce(x.cik, y.cik) AS cik, CASE WHEN x.cik IS NULL THEN y.cusip ELSE x.cusip END AS cusip, CASE WHEN x.cik IS NULL THEN y.class ELSE x.class END AS class, CASE WHEN x.cik IS NULL THEN y.put_call ELSE x.put_call END AS put_call,
  x.cik IS NOT NULL AS here, y.cik IS NOT NULL AS there, coalesce(x.value_usd, 0) AS value_usd, coalesce(y.value_usd, 0) AS previous_value_usd, coalesce(x.shares, 0) AS shares, coalesce(y.shares, 0) AS previous_shares
  FROM x FULL JOIN y ON x.cik = y.cik AND x.cusip IS NOT DISTINCT FROM y.cusip AND x.class IS NOT DISTINCT FROM y.class AND coalesce(x.put_call, '?') = coalesce(y.put_call, '?'))
SELECT cik, cusip, class, put_call, CASE WHEN NOT there THEN 'new' WHEN NOT here THEN 'exited' WHEN shares = previous_shares THEN 'unchanged' WHEN shares > previous_shares THEN 'increased' ELSE 'reduced' END AS change_type,
  value_usd, previous_value_usd, value_usd - previous_value_usd AS value_change, shares, previous_shares, shares - previous_shares AS share_change FROM j""",
    "thirteenf_xml": _HOLD[:-2] + " SELECT cik, accession, class, put_call, SUM(value)::BIGINT AS value, SUM(shares) AS shares, COUNT(*) AS n FROM h GROUP BY ALL",
    "insider_transactions": _INS + f"SELECT owner, pos, code, {_CODES} AS transaction_type, shares, price, shares * price AS value, derivative FROM i",
    "insider_summary": _INS.rstrip() + ", t AS (SELECT owner, " + _TALLY.replace("{derivative}", "SUM(derivative::INT)::BIGINT AS derivative_count, ").replace("{values}", _VALUES) + f" FROM i GROUP BY owner) SELECT *, {_r4('acquired_shares - disposed_shares')} AS net_shares, {_r4('acquired_value - disposed_value')} AS net_value FROM t",
    "form4_xml": _INS.rstrip() + ", t AS (SELECT owner, " + _TALLY.replace("{derivative}", "").replace("{values}", _VALUES) + f" FROM i GROUP BY owner) SELECT owner, transaction_count, purchase_count, sale_count, acquired_shares, disposed_shares, {_r4('acquired_shares - disposed_shares')} AS net_shares, {_r4('acquired_value - disposed_value')} AS net_value FROM t",
    "tree_roots": _GRAPH + "z AS (SELECT 1) SELECT DISTINCT role, parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)",
    "tree_preorder": _GRAPH + _WALK + " SELECT node, parent, depth, line_order, path FROM t",
    "calc_checks": _GRAPH + _CHECK + " SELECT parent, parent_value, calculated_value, difference, child_count, matched_children, status, (child_count - matched_children)::INT AS missing FROM s",
    "statement_render": _GRAPH + _WALK + ", " + _CHECK + " SELECT t.node, t.depth, coalesce('L ' || v.concept, t.node) AS label, v.numeric_value AS value, CASE WHEN v.concept IS NOT NULL THEN 'USD' END AS unit, s.status AS calculation_status FROM t LEFT JOIN nv v ON v.concept = t.node LEFT JOIN s ON s.parent = t.node",
    # Every character counts as many places as it has bytes; with no exact hit, the first 20 places of a word with the other near.
    "search_token_window": r"""WITH d AS (SELECT doc_id, translate(regexp_replace(regexp_replace(regexp_replace(text, '[\x{80}-\x{7FF}]', '~~', 'g'), '[\x{800}-\x{FFFF}]', '~~~', 'g'), '[\x{10000}-\x{10FFFF}]', '~~~~', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, low, contains(low, 'that, with') AS exact, CASE WHEN contains(low, 'that, with') THEN 'that, with' ELSE 'that' END AS q FROM d),
p AS (SELECT doc_id, low, exact, length(q) AS n, string_split(low, q) AS parts FROM e),
u AS (SELECT doc_id, low, exact, n, unnest(range(1, len(parts))) AS i, unnest(list_transform(parts[:-2], lambda x: length(x))) AS size FROM p),
o AS (SELECT doc_id, low, exact, (SUM(size) OVER (PARTITION BY doc_id ORDER BY i) + n * (i - 1))::BIGINT AS place FROM u),
h AS (SELECT doc_id, exact, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM o WHERE exact OR contains(substr(low, greatest(place - 300, 0) + 1, place + 600 - greatest(place - 300, 0)), 'with'))
SELECT doc_id, place AS "offset" FROM h WHERE exact OR k <= 20""",
    "search_exact": "WITH d AS (SELECT doc_id, regexp_replace(text, '[A-Z]', 'a', 'g') AS x, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) SELECT doc_id, ((length(t) - length(replace(t, 'in the', ''))) // 6)::BIGINT AS matches, strlen(split_part(t, 'in the', 1)) AS first FROM d WHERE contains(t, 'in the')",
    "text_truncate": "WITH d AS (SELECT doc_id, text, strlen(text) AS n, list_filter(range(0, 102), lambda i: strlen(substr(text, 1, i)) <= 101) AS k FROM documents) SELECT doc_id, n AS byte_length, CASE WHEN n <= 101 THEN text ELSE substr(text, 1, list_max(k)) END AS content, n > 101 AS truncated FROM d",
    "plain_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS t FROM a) SELECT page_id, md5(t) AS digest, length(t)::INT AS chars FROM b""",
    "html_tables": "SELECT n_regionkey, 2 AS table_index, COUNT(*)::INT + 1 AS row_count, 2 AS column_count, 'All nations' AS title_hint, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "topic_argmax": _topic(),
    "exhibit_category": _EXHIBIT,
    "eightk_events": FILINGS + f"SELECT DISTINCT cik, item, title, category, item IN ('2.02', '7.01') AS is_furnished FROM f JOIN {_ITEMS} ON f.pos % {len(EIGHTK_ITEMS)} = t.i",
    "sgml_documents": "SELECT conv_id, upper(role) AS document_type, turn::VARCHAR AS sequence, 't' || turn || '.txt' AS filename, strlen(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS byte_length, 'text' AS content_type FROM conversations",
    "name_match": "SELECT s_suppkey AS id, c_custkey AS other_id FROM supplier JOIN customer ON regexp_extract(s_name, '[0-9]+') = regexp_extract(c_name, '[0-9]+')",
    "known_items": f"WITH o AS (SELECT (o_orderkey % 10)::VARCHAR || '.' || lpad((o_custkey % 9)::VARCHAR, 2, '0') AS item FROM orders) SELECT item, COUNT(*) AS n, any_value(category) AS category FROM o JOIN {_ITEMS} USING (item) GROUP BY item",
    "supported_forms": FILINGS.rstrip() + ", n AS (SELECT form, COUNT(*) AS filings FROM f GROUP BY 1) SELECT t.*, coalesce(n.filings, 0)::BIGINT AS filings FROM (VALUES " + ", ".join(f"('{k}', '{c}', '{f}', '{r}')" for k, c, forms, r in FORM_FAMILIES for f in forms) + ") AS t(kind, canonical_form, form, record_kind) LEFT JOIN n USING (form)",
    "concept_catalogue": FACTS + "n AS (SELECT concept, COUNT(*) AS n FROM f GROUP BY 1), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{i}', '{c}')" for s, ls in STATEMENTS.items() for i, k in ls for c in concepts_of(k)) + ") AS t(statement, line_item, concept)) SELECT statement, COUNT(DISTINCT line_item) AS lines, COUNT(*) AS candidates, COUNT(n) AS used, coalesce(SUM(n), 0)::BIGINT AS facts FROM t LEFT JOIN n USING (concept) GROUP BY 1",
    "daily_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS form, COUNT(*) AS n FROM events GROUP BY ALL",
}
