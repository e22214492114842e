"""Linkbases of many filings: sorted and limited links, trees with labels, checks, rendered statements.

Limits are ranks within a filing, so that a limited question is a bounded sort
for each filing and never a sort of all. Labels come from three sources (the
filing's label links, company facts, the concept itself); one argmax by source and
document order picks a concept's label, in place of a join for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.predicates import part_of, xbrl_concept_is
from filigree.operators import trees
from filigree.sources import xmlforms


def filing_links(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Links of all linkbase and schema documents (keys, sequence, content) of filings; ``_error`` where one cannot be read."""
    return xmlforms.parse_column(docs, [*keys, "sequence"], "links")


def within(df: DataFrame, keys: list[str], order: list, limit: int | None, place: str = "place") -> DataFrame:
    """The first ``limit`` rows of each filing in an order, with their places."""
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if limit is None else out.where(F.col(place) <= limit)


def sorted_links(links: DataFrame, keys: list[str], linkbase: str | None = None, role: str | None = None, concept: str | None = None, limit: int | None = None) -> DataFrame:
    """Links of a kind, role and concept (of either end), by linkbase, role and order."""
    rows = links.where("linkbase IS NOT NULL")
    if linkbase is not None:
        rows = rows.where(F.col("linkbase") == linkbase.strip().lower())
    rows = rows.where(F.coalesce(part_of(F.col("role"), role), F.lit(role is None)))
    if concept is not None:
        rows = rows.where(F.coalesce(xbrl_concept_is(F.col("parent"), concept), F.lit(False)) | F.coalesce(xbrl_concept_is(F.col("child"), concept), F.lit(False)))
    return within(rows, keys, [F.col("linkbase"), F.col("role").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("sequence"), F.col("pos")], limit)


def edges_of(links: DataFrame, keys: list[str], linkbase: str) -> DataFrame:
    """Arcs of one kind, each once however many documents repeat it."""
    arcs = links.where((F.col("linkbase") == linkbase) & F.col("parent").isNotNull() & F.col("child").isNotNull())
    return arcs.groupBy(*keys, "role", "parent", "child").agg(F.max_by(F.struct("ord", "weight"), F.struct("sequence", "pos")).alias("_a")).select(*keys, "role", "parent", "child", "_a.ord", "_a.weight")


def labels_of(links: DataFrame, company_facts: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, concept, label, source): the last label link of a concept, else its label in company facts."""
    own = links.where((F.col("linkbase") == "label") & F.col("label").isNotNull()).select(*keys, F.col("child").alias("concept"), "label", F.lit(1).alias("_s"), F.struct("sequence", "pos").alias("_o"))
    if company_facts is not None:
        facts = company_facts.where(F.col("label").isNotNull()).select(*keys, "concept", "label", F.lit(0).alias("_s"), F.struct(F.lit(0).alias("sequence"), F.coalesce(F.col("pos").cast("int"), F.lit(0)).alias("pos")).alias("_o"))
        own = own.withColumn("_o", F.struct(F.col("_o.sequence").cast("int").alias("sequence"), F.col("_o.pos").cast("int").alias("pos"))).unionByName(facts)
    best = own.groupBy(*keys, "concept").agg(F.max_by(F.struct("label", "_s"), F.struct("_s", "_o")).alias("_l"))
    return best.select(*keys, "concept", F.col("_l.label").alias("label"), F.when(F.col("_l._s") == 1, "linkbase").otherwise("company_facts").alias("source"))


def labelled_trees(links: DataFrame, keys: list[str], company_facts: DataFrame | None = None, linkbase: str = "presentation", max_depth: int | None = None) -> DataFrame:
    """Trees of the arcs of one kind in preorder, each node with its label."""
    tree = trees.preorder(edges_of(links, keys, linkbase), [*keys, "role"], max_depth)
    labels = labels_of(links, company_facts, keys).withColumnRenamed("concept", "node")
    return tree.join(labels, [*keys, "node"], "left").withColumn("source", F.coalesce("source", F.lit("concept"))).withColumn("label", F.coalesce("label", "node"))


def filing_checks(links: DataFrame, values: DataFrame, keys: list[str], tolerance: float = 1.0, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Calculation checks of filings by role and parent."""
    checks = trees.calculation_checks(edges_of(links, keys, "calculation"), values, keys, tolerance)
    checks = checks if status is None else checks.where(F.col("status") == status)
    return within(checks, keys, [F.col("role").asc_nulls_first(), F.col("parent")], limit)


def rendered(links: DataFrame, values: DataFrame, keys: list[str], company_facts: DataFrame | None = None, role: str | None = None, tolerance: float = 1.0, values_only: bool = False, limit: int | None = None) -> DataFrame:
    """Statements as printed: presentation rows with label, value, unit and check."""
    tree = labelled_trees(links.where(F.coalesce(part_of(F.col("role"), role), F.lit(role is None)) | (F.col("linkbase") == "label")), keys, company_facts)
    last = values.groupBy(*keys, F.col("concept").alias("node")).agg(F.max_by(F.struct("numeric_value", "unit"), "pos").alias("_v"))
    checks = filing_checks(links, values, keys, tolerance).groupBy(*keys, F.col("parent").alias("node")).agg(F.max_by(F.struct("status", "difference"), "role").alias("_c"))
    out = tree.join(last, [*keys, "node"], "inner" if values_only else "left").join(checks, [*keys, "node"], "left")
    out = out.select(*keys, "role", "node", "parent", "depth", "line_order", "path", "label", F.col("source").alias("label_source"), F.col("_v.numeric_value").alias("value"), F.col("_v.unit").alias("unit"), F.col("_c.status").alias("calculation_status"), F.col("_c.difference").alias("calculation_difference"))
    return within(out, keys, [F.col("role").asc_nulls_first(), F.col("line_order")], limit)


# ---- registered queries ----


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _joined(df, by, order, one, head, tail):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, one.alias("x")))), lambda e: e["x"]), "")
    return df.groupBy(by).agg(rows.alias("x")).select(by, F.concat(head, "x", tail).alias("content"))


def _documents(s, d):
    """Four linkbases and a schema for the filing of each region: regions, their nations and their suppliers."""
    n = _table(s, d, "nation").select(F.col("n_regionkey").alias("accession"), F.col("n_nationkey").cast("int").alias("nation"), "n_name")
    p = _table(s, d, "supplier").select(F.col("s_nationkey").cast("int").alias("nation"), F.col("s_suppkey").cast("int").alias("supplier")).join(n, "nation")
    href = lambda what, col: F.concat(F.lit(f's.xsd#us-gaap_{what}'), col.cast("string"))
    loc = lambda label, what, col: F.concat(F.lit('<loc label="'), label, F.lit('" href="'), href(what, col), F.lit('"/>'))
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    nk, sk = F.col("nation").cast("string"), F.col("supplier").cast("string")
    head = lambda link: text(f'<linkbase><{link} role="role/', F.col("accession").cast("string"), '"><loc label="r" href="s.xsd#us-gaap_R', F.col("accession").cast("string"), '"/>')
    tail = lambda link: F.lit(f"</{link}></linkbase>")

    def arcs(link, arc, extra):
        one = text(loc(F.concat(F.lit("n"), nk), "N", F.col("nation")), f'<{arc} from="r" to="n', nk, '" order="', nk, '" arcrole="parent-child"', *extra(F.lit("1")), "/>")
        two = text(loc(F.concat(F.lit("s"), sk), "S", F.col("supplier")), f'<{arc} from="n', nk, '" to="s', sk, '" order="', sk, '" arcrole="parent-child"', *extra(F.when(F.col("supplier") % 2 == 0, "-1").otherwise("1")), "/>")
        both = n.select("accession", "nation", F.lit(-1).alias("supplier"), one.alias("x")).unionByName(p.select("accession", "nation", "supplier", two.alias("x")))
        return _joined(both, "accession", ["nation", "supplier"], F.col("x"), head(link), tail(link))

    label = text(loc(F.concat(F.lit("n"), nk), "N", F.col("nation")), '<label label="t', nk, '" role="standard">Nation ', F.col("n_name"), '</label><label label="t', nk, '" role="terse">', F.lower("n_name"), ' &amp; sons</label><labelArc from="n', nk, '" to="t', nk, '"/>')
    element = text('<xs:element name="N', nk, '" id="us-gaap_N', nk, '" type="monetary"/>')
    parts = [
        arcs("presentationLink", "presentationArc", lambda w: []), arcs("calculationLink", "calculationArc", lambda w: [F.lit(' weight="'), w, F.lit('"')]), arcs("definitionLink", "definitionArc", lambda w: []),
        _joined(n, "accession", ["nation"], label, head("labelLink"), tail("labelLink")), _joined(n, "accession", ["nation"], element, F.lit('<xs:schema xmlns:xs="x">'), F.lit("</xs:schema>")),
    ]
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("sequence", F.lit(i + 1))
        out = part if out is None else out.unionByName(part)
    return out


def _values(s, d):
    """Suppliers' values, and nations' sums, of which every fourth is off by 10; regions have none."""
    v = _table(s, d, "supplier").join(_table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("accession")), "s_nationkey").select("accession", F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.floor("s_acctbal").cast("double").alias("v"))
    own = v.select("accession", F.concat(F.lit("us-gaap:S"), F.col("supplier").cast("string")).alias("concept"), F.col("v").alias("numeric_value"))
    total = v.groupBy("accession", "nation").agg(F.sum(F.when(F.col("supplier") % 2 == 0, -F.col("v")).otherwise(F.col("v"))).alias("t")).select("accession", F.concat(F.lit("us-gaap:N"), F.col("nation").cast("string")).alias("concept"), (F.col("t") + F.when(F.col("nation") % 4 == 0, 10).otherwise(0)).alias("numeric_value"))
    return own.unionByName(total).withColumn("unit", F.lit("USD")).withColumn("pos", F.lit(0))


def _facts(s, d):
    """Labels in company facts: of every third supplier, and of nations, which their own labels precede."""
    v = _values(s, d).withColumn("label", F.concat(F.lit("Fact "), "concept"))
    return v.where(F.col("concept").startswith("us-gaap:N") | (F.substring("concept", 10, 9).cast("int") % 3 == 0))


def linkbase_kinds(s, d):
    """The first seven links of each kind of every filing."""
    links = filing_links(_documents(s, d), ["accession"])
    out = None
    for kind in ("presentation", "calculation", "definition", "label", "schema"):
        part = sorted_links(links, ["accession"], kind, limit=7)
        out = part if out is None else out.unionByName(part)
    return out.select("accession", "linkbase", "place", "role", "relationship", "parent", "child", "ord", "weight", "label", "label_role")


def linked_concepts(s, d):
    """Calculation links that touch nation 7 or a concept that begins so."""
    return sorted_links(filing_links(_documents(s, d), ["accession"]), ["accession"], "calculation", concept="us-gaap:N7").select("accession", "place", "parent", "child", "weight")


def labelled_tree(s, d):
    return labelled_trees(filing_links(_documents(s, d), ["accession"]), ["accession"], _facts(s, d)).select("accession", "role", "node", F.col("depth").cast("int").alias("depth"), F.col("line_order").cast("int").alias("line_order"), "label", "source")


def linked_checks(s, d):
    """The first four checks of each filing."""
    links = filing_links(_documents(s, d), ["accession"])
    return filing_checks(links, _values(s, d), ["accession"], 0.5, limit=4).select("accession", "place", "role", "parent", "calculated_value", "parent_value", "child_count", "status")


def rendered_filings(s, d):
    """The first twelve rows of each filing's statement."""
    r = rendered(filing_links(_documents(s, d), ["accession"]), _values(s, d), ["accession"], _facts(s, d), role="ROLE/", tolerance=0.5, limit=12)
    return r.select("accession", "place", "node", F.col("depth").cast("int").alias("depth"), "label", "label_source", "value", "unit", "calculation_status")


QUERIES = {f.__name__: f for f in (linkbase_kinds, linked_concepts, labelled_tree, linked_checks, rendered_filings)}

_ARCS = """WITH e AS (SELECT n_regionkey AS accession, 'role/' || n_regionkey AS role, 'us-gaap:R' || n_regionkey AS parent, 'us-gaap:N' || n_nationkey AS child, n_nationkey::INT AS ord, 1::DOUBLE AS weight, n_nationkey AS nation, -1 AS supplier FROM nation
  UNION ALL SELECT n_regionkey, 'role/' || n_regionkey, 'us-gaap:N' || n_nationkey, 'us-gaap:S' || s_suppkey, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END, n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
v AS (SELECT child AS concept, floor(s_acctbal) AS v, accession FROM e JOIN supplier ON s_suppkey = supplier UNION ALL SELECT parent, sum(weight * floor(s_acctbal)) + CASE WHEN any_value(nation) % 4 = 0 THEN 10 ELSE 0 END, accession FROM e JOIN supplier ON s_suppkey = supplier GROUP BY parent, accession),
t AS (SELECT accession, role, 'us-gaap:R' || accession AS node, 0 AS depth, -1 AS a, -1 AS b FROM (SELECT DISTINCT accession, role FROM e) UNION ALL SELECT accession, role, child, CASE WHEN supplier < 0 THEN 1 ELSE 2 END, nation, CASE WHEN supplier < 0 THEN -1 ELSE supplier END FROM e),
l AS (SELECT t.*, row_number() OVER (PARTITION BY accession ORDER BY a, b)::INT AS line_order, CASE WHEN depth = 1 THEN (SELECT lower(n_name) || ' & sons' FROM nation WHERE n_nationkey = a) WHEN b >= 0 AND b % 3 = 0 THEN 'Fact ' || node ELSE node END AS label,
  CASE WHEN depth = 1 THEN 'linkbase' WHEN b >= 0 AND b % 3 = 0 THEN 'company_facts' ELSE 'concept' END AS source FROM t),
c AS (SELECT e.accession, e.role, e.parent, sum(e.weight * v.v) AS calculated_value, count(*) AS child_count, any_value(p.v) AS parent_value FROM e LEFT JOIN v ON v.concept = e.child LEFT JOIN v p ON p.concept = e.parent GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN parent_value IS NULL THEN 'missing_parent' WHEN calculated_value IS NULL THEN 'missing_children' WHEN abs(parent_value - calculated_value) <= 0.5 THEN 'ok' WHEN abs(parent_value - calculated_value) / greatest(abs(parent_value), 2.220446049250313e-16) <= 0.5 THEN 'ok' ELSE 'mismatch' END AS status FROM c) """

ORACLES = {
    "linkbase_kinds": _ARCS + """, x AS (SELECT accession, k AS linkbase, role, 'parent-child' AS relationship, parent, child, ord::DOUBLE AS ord, CASE k WHEN 'calculation' THEN weight END AS weight, NULL AS label, NULL AS label_role, nation AS y, supplier AS z FROM e, (SELECT unnest(['presentation', 'calculation', 'definition']) AS k)
  UNION ALL SELECT n_regionkey, 'label', 'role/' || n_regionkey, NULL, NULL, 'us-gaap:N' || n_nationkey, NULL, NULL, CASE t WHEN 0 THEN 'Nation ' || n_name ELSE lower(n_name) || ' & sons' END, CASE t WHEN 0 THEN 'standard' ELSE 'terse' END, n_nationkey, t FROM nation, (SELECT unnest([0, 1]) AS t)
  UNION ALL SELECT n_regionkey, 'schema', NULL, 'element', NULL, 'us-gaap:N' || n_nationkey, NULL, NULL, 'monetary', NULL, n_nationkey, 0 FROM nation)
SELECT accession, linkbase, row_number() OVER (PARTITION BY accession, linkbase ORDER BY ord NULLS FIRST, y, z)::INT AS place, role, relationship, parent, child, ord, weight, label, label_role FROM x QUALIFY place <= 7""",
    "linked_concepts": _ARCS + "SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY ord, nation, supplier)::INT AS place, parent, child, weight FROM e WHERE parent LIKE '%:N7%' OR child LIKE '%:N7%'",
    "labelled_tree": _ARCS + "SELECT accession, role, node, depth, line_order, label, source FROM l",
    "linked_checks": _ARCS + "SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY role, parent)::INT AS place, role, parent, calculated_value, parent_value, child_count, status FROM k QUALIFY place <= 4",
    "rendered_filings": _ARCS + "SELECT l.accession, line_order AS place, node, depth, label, source AS label_source, v.v AS value, CASE WHEN v.v IS NOT NULL THEN 'USD' END AS unit, k.status AS calculation_status FROM l LEFT JOIN v ON v.concept = l.node LEFT JOIN k ON k.parent = l.node AND k.accession = l.accession WHERE line_order <= 12",
}
