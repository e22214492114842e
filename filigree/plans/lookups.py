"""Registered queries of name look-ups, the resolver and the merged schedules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from filigree.operators import disclosures, resolver
from filigree.plans.forms import _joined, _table, _text


def _companies(s, d):
    """Companies from parts and names that search for them from suppliers: as named, reordered, shortened, unknown."""
    p = _table(s, d, "part").select(F.col("p_partkey").alias("cik"), F.concat(F.initcap("p_name"), F.lit(" & "), F.replace("p_brand", F.lit("#"), F.lit(" No")), F.lit(" Lot"), F.col("p_partkey").cast("string"), F.lit(", Inc.")).alias("company"), "p_name", "p_brand")
    q = _table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("cik")).join(p.hint("merge"), "cik")
    k, lot, brand = F.col("s_suppkey") % 5, F.concat(F.lit("lot"), F.col("cik").cast("string")), F.replace("p_brand", F.lit("#"), F.lit(" no"))
    name = (
        F.when(k == 0, F.concat(F.lit(" "), F.replace("company", F.lit(" & "), F.lit("& ")))).when(k == 1, F.concat(lot, F.lit(" / "), brand, F.lit(", "), "p_name", F.lit(" Group"))).when(k == 2, F.concat(F.lit("the "), brand, F.lit(" "), lot))
        .when(k == 3, F.concat(F.lit("Company of Strangers "), F.col("s_suppkey").cast("string"))).otherwise(F.lit("Corp. & Co."))
    )
    return p.select("cik", "company"), q.select(F.col("s_suppkey").alias("id"), name.alias("name"))


def name_variants(s, d):
    """What a search for each name asks for, in order, and where."""
    _, q = _companies(s, d)
    v = q.select("id", F.posexplode(resolver.search_variants(F.col("name"))).alias("place", "variant"))
    return v.select("id", "place", "variant", resolver.search_url(F.col("variant")).alias("url"))


def atom_managers(s, d):
    """A search feed a region: the company named last is the manager."""
    one = _text("<company-info><conformed-name>N&amp;{n_name}</conformed-name><cik>{cik}</cik></company-info><entry><content><filing-type>{form}</filing-type></content></entry>", cik=F.lpad(F.col("n_nationkey").cast("string"), 10, "0"), form=F.when(F.col("n_nationkey") % 2 == 0, "13F-HR").otherwise("13F-NT"))
    docs = _joined(_table(s, d, "nation"), "n_regionkey", "n_nationkey", one, "<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'>", "</feed>")
    return resolver.atom_managers(docs, ["n_regionkey"]).select("n_regionkey", "cik", "company", "entries", F.array_join("forms", ",").alias("forms"))


def scored_names(s, d):
    """Every pair of a name and a company whose shared words weigh enough."""
    c, q = _companies(s, d)
    return resolver.scored_pairs(q, c)


def manager_lookup(s, d):
    c, q = _companies(s, d)
    return resolver.manager_lookup(q, c)


def _reports(s, d):
    """Holdings reports and others from orders; filers are customers."""
    form = F.when(F.col("o_orderpriority").startswith("1"), "13F-HR").otherwise("10-K")
    o = _table(s, d, "orders").withColumnRenamed("o_custkey", "cik").withColumn("date", F.col("o_orderdate").cast("date").cast("string"))
    c = _table(s, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("company"))
    return c, o.join(c, "cik").select("cik", "company", F.col("o_orderkey").cast("string").alias("accession"), form.alias("form"), F.col("date").alias("report_date"), F.col("date").alias("filing_date"))


def resolved_managers(s, d):
    """Customers named outright, some by names that are none."""
    c, f = _reports(s, d)
    q = _table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("CUSTOMER "), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 3 == 0, " Partners Fund of Elsewhere").otherwise(", LLC")).alias("name"))
    return resolver.resolve_managers(q, c, f).select("id", "query", "manager", "cik", "how", "status", "latest_accession", F.size("next_commands").alias("commands"))


def mock_model(prompt: str) -> str:
    """Stands for a language model: its answers to questions ``<kind> <name> <cik>`` come in the shapes that models give."""
    kind, name, cik = re.search(r"(\d) (Customer#\d+) (\d+)", prompt).groups()
    good = f'{{"candidates": [{{"manager": "{name}", "cik": "CIK {cik}", "confidence": 0.9, "notes": "seen"}}]}}'
    if kind == "0":
        return f"Sure:\n```json\n{good}\n```"
    if kind == "1":
        return good if prompt.startswith("Give only the JSON") else f"I think it is {name}."
    if kind == "2":
        return f'[{{"investor": "{name}", "cik": 999999999}}, {{"manager": "Nobody Known", "cik": {cik}}}, "text"]'
    if kind == "3":
        return f'[{{"manager": "{name}", "cik": null}}]' if prompt.startswith("There was no candidate") else '{"candidates": []}'
    return "no idea"


def resolved_questions(s, d):
    """Questions put to a model by a table function, its candidates checked by holdings reports."""
    c, f = _reports(s, d)
    k = F.col("s_suppkey") * 2
    q = _table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat((F.col("s_suppkey") % 5).cast("string"), F.lit(" Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" "), k.cast("string")).alias("question"))
    return resolver.resolve_questions(q, mock_model, c, f).select("id", "rank", "investor", "manager", "cik", "confidence", "notes", "status", "latest_accession")


#: Schedules as filed: the printed cover of a 13D, and a 13G whose items word the powers.
SCHEDULE_13D = "<p>Part {o_custkey} Corp (Name of Issuer)</p><p>1. Name of Reporting Person: Holder {o_custkey} LP</p><p>6. Citizenship or Place of Organization: Delaware</p><p>7. Sole Voting Power: {n},000</p><p>10. Shared Dispositive Power: 5</p><p>11. Aggregate Amount Beneficially Owned by Each Reporting Person: {n},005</p><p>Item 1. Security and Issuer of order {o_orderkey}.</p><p>Item 4. Purpose of Transaction: talks with the board.</p><p>/s/ Ann Lee</p>"
SCHEDULE_13G = "<p>{box}</p><p>Item 1. (a) Name of Issuer: Part {o_custkey} Corp (b) Address of Issuer: 1 Road</p><p>Item 2. (a) Name of Person Filing: Fund {o_orderkey} (c) Citizenship: Bermuda (d) Title of Class of Securities: Common</p><p>Item 4. Ownership. (a) Amount beneficially owned: {n},500 (b) Percent of class: 7.5% (c)(i) Sole power to vote or to direct the vote: {n},100 (ii) Shared power to vote or to direct the vote: 0 (iii) Sole power to dispose or to direct the disposition of: {n},200 (iv) Shared power to dispose or to direct the disposition of: 9</p><p>Item 10. Certification. By signing below.</p><p>/s/ Bo Chen</p>"
BOXES = ["[X] Rule 13d-1(b) [ ] Rule 13d-1(c)", "[ ] Rule 13d-1(b) ☒ Rule 13d-l(c)", "Rule 13d-1(d) x", "[ ] Rule 13d-1(b)"]


def schedule13_merged(s, d):
    """The two newest schedules of each company, of both feeds."""
    form = F.element_at(F.array(*[F.lit(f) for f in ("SC 13D", "SC 13G", "SC 13D/A", "10-K")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = _table(s, d, "orders").withColumn("form", form)
    filings = o.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accession"), "form", F.col("o_orderdate").cast("date").cast("string").alias("filing_date"), (-F.col("o_orderkey")).alias("pos"))
    n, box = F.col("o_custkey") % 800 + 100, F.element_at(F.array(*[F.lit(b) for b in BOXES]), (F.col("o_custkey") % 4 + 1).cast("int"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("accession"), F.lit("1").alias("sequence"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("filename"), F.when(F.col("form") == "SC 13G", _text(SCHEDULE_13G, n=n, box=box)).otherwise(_text(SCHEDULE_13D, n=n)).alias("content"))
    r = disclosures.schedule13_reports(filings, docs, 2)
    return r.select("cik", "accession", "form", F.col("place").cast("int").alias("place"), "filename", "filing_type", "is_amendment", "activist_intent", "issuer_name", F.array_join("reporting_persons", "|").alias("persons"), "filing_rule", "citizenship", "sole_voting_power", "shared_voting_power", "sole_dispositive_power", "shared_dispositive_power", "beneficially_owned", "percent_of_class", "item_count", F.col("purpose").isNotNull().alias("has_purpose"), F.array_join("signatures", "|").alias("signatures"))


QUERIES = {f.__name__: f for f in (name_variants, atom_managers, scored_names, manager_lookup, resolved_managers, resolved_questions, schedule13_merged)}

_SUFFIXES = "('inc','incorporated','corp','corporation','co','company','llc','ltd','limited','lp','l.p','group','del')"
_NAMES = f"""WITH RECURSIVE c AS (SELECT p_partkey AS cik, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' & ' || replace(p_brand, '#', ' No') || ' Lot' || p_partkey || ', Inc.' AS company, p_name, p_brand FROM part),
q AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN ' ' || replace(company, ' & ', '& ') WHEN 1 THEN 'lot' || cik || ' / ' || replace(p_brand, '#', ' no') || ', ' || p_name || ' Group' WHEN 2 THEN 'the ' || replace(p_brand, '#', ' no') || ' lot' || cik WHEN 3 THEN 'Company of Strangers ' || s_suppkey ELSE 'Corp. & Co.' END AS name
  FROM supplier JOIN c ON cik = s_suppkey * 3),
named AS (SELECT 'q' AS side, id AS key, name FROM q UNION ALL SELECT 'c', cik, company FROM c),
compact AS (SELECT *, regexp_replace(trim(name), '\\s*&\\s*', '&', 'g') AS a FROM named),
spelled AS (SELECT side, key, trim(name) AS v1, a AS v2,
  array_to_string(list_filter(regexp_split_to_array(a, '[,.\\s]+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9&]+|[^A-Za-z0-9&]+$', '', 'g') <> '' AND lower(regexp_replace(w, '^[^A-Za-z0-9&]+|[^A-Za-z0-9&]+$', '', 'g')) NOT IN {_SUFFIXES}), ' ') AS v3,
  array_to_string(list_filter(string_split(regexp_replace(a, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND lower(w) NOT IN {_SUFFIXES}), ' ') AS v4 FROM compact),
variants AS (SELECT side, key, list_filter([v1, CASE WHEN v2 <> v1 THEN v2 END, CASE WHEN v3 NOT IN (v1, v2, '') THEN v3 END, CASE WHEN v4 NOT IN (v1, v2, v3, '') THEN v4 END], lambda v: v IS NOT NULL) AS vs FROM spelled),
words AS (SELECT side, key, list_distinct(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_SUFFIXES})) AS ws FROM named) """
_SCORED = """, {0}n AS (SELECT count(*) AS n FROM {0}words WHERE len(ws) > 0), {0}df AS (SELECT word, length(bin((SELECT n FROM {0}n) // count(*))) AS weight FROM (SELECT unnest(ws) AS word FROM {0}words) GROUP BY 1),
{0}w AS (SELECT side, key, word, weight FROM (SELECT side, key, unnest(ws) AS word FROM {0}words) JOIN {0}df USING (word)), {0}t AS (SELECT side, key, sum(weight) AS total FROM {0}w GROUP BY 1, 2),
{0}pairs AS (SELECT a.key AS id, b.key AS cik, sum(a.weight)::BIGINT AS shared, greatest(any_value(ta.total), any_value(tb.total))::BIGINT AS heavier FROM {0}w a JOIN {0}w b ON a.word = b.word JOIN {0}t ta ON ta.side = 'q' AND ta.key = a.key JOIN {0}t tb ON tb.side = 'c' AND tb.key = b.key WHERE a.side = 'q' AND b.side = 'c'
  GROUP BY 1, 2 HAVING sum(a.weight) * 100 >= 60 * greatest(any_value(ta.total), any_value(tb.total))) """
_ENCODED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(variant, '&', '%26', 'g'), ',', '%2C', 'g'), '/', '%2F', 'g'), ' ', '+', 'g')"
_FILERS = "WITH f AS (SELECT o_custkey AS cik, arg_max(o_orderkey::VARCHAR, (o_orderdate::DATE::VARCHAR, o_orderkey::VARCHAR)) AS latest FROM orders WHERE o_orderpriority[1] = '1' GROUP BY 1), "

ORACLES = {
    "name_variants": _NAMES + f", v AS (SELECT key AS id, unnest(range(0, len(vs)))::INT AS place, unnest(vs) AS variant FROM variants WHERE side = 'q') SELECT id, place, variant, 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&company=' || {_ENCODED} || '&type=13F-HR&owner=exclude&output=atom' AS url FROM v",
    "atom_managers": "SELECT n_regionkey, max(n_nationkey)::BIGINT AS cik, 'N&' || arg_max(n_name, n_nationkey) AS company, count(*)::INT AS entries, string_agg(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN '13F-HR' ELSE '13F-NT' END, ',' ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN '13F-HR' ELSE '13F-NT' END) AS forms FROM nation GROUP BY 1",
    "scored_names": _NAMES + _SCORED.format("") + "SELECT id, cik, shared, heavier FROM pairs",
    "manager_lookup": _NAMES + """, e AS (SELECT a.key AS id, b.key AS cik, list_position(a.vs, v) AS place FROM (SELECT key, vs, unnest(vs) AS v FROM variants WHERE side = 'q') a JOIN (SELECT DISTINCT key, unnest(vs) AS v FROM variants WHERE side = 'c') b USING (v) QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY place, b.key) = 1),
xwords AS (SELECT * FROM words WHERE side = 'c' OR key NOT IN (SELECT id FROM e)) """ + _SCORED.format("x") + """, b AS (SELECT * FROM xpairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared / heavier DESC, cik) = 1),
o AS (SELECT id, cik, 'variant' AS how, NULL::BIGINT AS shared, NULL::BIGINT AS heavier FROM e UNION ALL SELECT id, cik, 'score', shared, heavier FROM b)
SELECT q.id, q.name, o.cik, c.company, o.how, o.shared, o.heavier FROM q LEFT JOIN o ON q.id = o.id LEFT JOIN c ON c.cik = o.cik""",
    "resolved_managers": _FILERS + """q AS (SELECT s_suppkey AS id, s_suppkey * 2 AS k, 'CUSTOMER ' || lpad((s_suppkey * 2)::VARCHAR, 9, '0') || CASE WHEN s_suppkey % 3 = 0 THEN ' Partners Fund of Elsewhere' ELSE ', LLC' END AS query FROM supplier)
SELECT id, query, coalesce(CASE WHEN f.cik IS NOT NULL THEN c_name END, query) AS manager, f.cik, CASE WHEN f.cik IS NOT NULL THEN 'score' END AS how, CASE WHEN f.cik IS NULL THEN 'missing_cik' ELSE 'verified_13f' END AS status, f.latest AS latest_accession, CASE WHEN f.cik IS NULL THEN 0 ELSE 3 END::INT AS commands
FROM q LEFT JOIN f ON f.cik = q.k AND q.id % 3 <> 0 LEFT JOIN customer ON c_custkey = f.cik""",
    "resolved_questions": _FILERS + """q AS (SELECT s_suppkey AS id, s_suppkey % 5 AS kind, s_suppkey * 2 AS k, 'Customer#' || lpad((s_suppkey * 2)::VARCHAR, 9, '0') AS n FROM supplier),
r AS (SELECT id, 1 AS rank, NULL AS investor, n AS manager, k AS cik, '0.9' AS confidence, 'seen' AS notes, k AS real, kind FROM q WHERE kind IN (0, 1)
  UNION ALL SELECT id, 1, n, NULL, 999999999, NULL, NULL, k, kind FROM q WHERE kind = 2 UNION ALL SELECT id, 2, NULL, 'Nobody Known', k, NULL, NULL, NULL, kind FROM q WHERE kind = 2 UNION ALL SELECT id, 1, NULL, n, NULL, NULL, NULL, k, kind FROM q WHERE kind = 3)
SELECT id, rank::INT AS rank, investor, manager, CASE WHEN g.cik IS NOT NULL THEN g.cik ELSE r.cik END AS cik, confidence, CASE WHEN g.cik IS NOT NULL AND r.cik IS DISTINCT FROM g.cik THEN 'Company search corrected the CIK from ' || coalesce(r.cik::VARCHAR, 'missing') || ' to ' || g.cik || '.' ELSE notes END AS notes,
  CASE WHEN g.cik IS NOT NULL THEN 'verified_13f' WHEN r.cik IS NULL THEN 'missing_cik' WHEN h.cik IS NULL THEN 'no_recent_13f' ELSE 'company_mismatch' END AS status, coalesce(g.latest, h.latest) AS latest_accession
FROM r LEFT JOIN f g ON g.cik = r.real LEFT JOIN f h ON h.cik = r.cik""",
    "schedule13_merged": """WITH f AS (SELECT o_custkey AS cik, o_orderkey, o_orderdate::DATE AS day, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 4 < 2), a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cik, k ORDER BY o_orderkey DESC) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY day DESC, o_orderkey::VARCHAR DESC)::INT AS place FROM a QUALIFY place <= 2), n AS (SELECT *, (cik % 800 + 100) * 1000.0::DOUBLE AS n FROM b)
SELECT cik, o_orderkey::VARCHAR AS accession, CASE k WHEN 0 THEN 'SC 13D' ELSE 'SC 13G' END AS form, place, o_orderkey || '.htm' AS filename, CASE k WHEN 0 THEN '13d' ELSE '13g' END AS filing_type, false AS is_amendment, k = 0 AS activist_intent, 'Part ' || cik || ' Corp' AS issuer_name,
  CASE k WHEN 0 THEN 'Holder ' || cik || ' LP' ELSE 'Fund ' || o_orderkey END AS persons, CASE WHEN k = 1 THEN CASE cik % 4 WHEN 0 THEN '13d-1(b)' WHEN 1 THEN '13d-1(c)' WHEN 2 THEN '13d-1(d)' END END AS filing_rule, CASE k WHEN 0 THEN 'Delaware' ELSE 'Bermuda' END AS citizenship,
  n + CASE k WHEN 0 THEN 0 ELSE 100 END AS sole_voting_power, CASE k WHEN 1 THEN 0::DOUBLE END AS shared_voting_power, CASE k WHEN 1 THEN n + 200 END AS sole_dispositive_power, CASE k WHEN 0 THEN 5 ELSE 9 END::DOUBLE AS shared_dispositive_power,
  n + CASE k WHEN 0 THEN 5 ELSE 500 END AS beneficially_owned, CASE k WHEN 1 THEN 7.5::DOUBLE END AS percent_of_class, CASE k WHEN 0 THEN 2 ELSE 4 END::INT AS item_count, k = 0 AS has_purpose, CASE k WHEN 0 THEN 'Ann Lee' ELSE 'Bo Chen' END AS signatures FROM n""",
}
