import pytest
from pyspark.sql import functions as F

from filigree.plans import xbrl

PRESENTATION = '<linkbase><presentationLink role="r/a"><loc label="p" href="s#us-gaap_P"/><loc label="c" href="s#us-gaap_C"/><loc label="d" href="s#us-gaap_D"/><presentationArc from="p" to="c" order="2"/><presentationArc from="p" to="d" order="1"/><presentationArc from="c" to="p" order="1"/></presentationLink></linkbase>'
CALCULATION = '<linkbase><calculationLink role="r/a"><loc label="p" href="s#us-gaap_P"/><loc label="c" href="s#us-gaap_C"/><calculationArc from="p" to="c" order="1" weight="-1"/></calculationLink></linkbase>'
LABELS = '<linkbase><labelLink role="l"><loc label="c" href="s#us-gaap_C"/><label label="x" role="terse">First</label><label label="x" role="total">Second</label><labelArc from="c" to="x"/></labelLink></linkbase>'
ROOTED = PRESENTATION.replace('<presentationArc from="c" to="p" order="1"/>', "")


@pytest.fixture(scope="module")
def links(spark):
    rows = [("f1", 1, ROOTED), ("f1", 2, CALCULATION), ("f1", 3, LABELS), ("f1", 4, ROOTED), ("f1", 5, "<broken"), ("f2", 1, PRESENTATION), ("f2", 2, None)]
    return xbrl.filing_links(spark.createDataFrame(rows, "accession string, sequence int, content string"), ["accession"])


def test_sorted_links(links):
    get = lambda **k: [(r.accession, r.place, r.parent, r.child) for r in xbrl.sorted_links(links, ["accession"], **k).orderBy("accession", "place").collect()]
    assert get(linkbase=" Presentation ", limit=2) == [("f1", 1, "us-gaap:P", "us-gaap:D"), ("f1", 2, "us-gaap:P", "us-gaap:D"), ("f2", 1, "us-gaap:P", "us-gaap:D"), ("f2", 2, "us-gaap:C", "us-gaap:P")]
    assert get(linkbase="calculation", role="R/A") == [("f1", 1, "us-gaap:P", "us-gaap:C")] and get(role="none") == [] and get(limit=0) == []
    assert {x[3] for x in get(linkbase="presentation", concept="US-GAAP_d")} == {"us-gaap:D"}
    assert links.where("_error IS NOT NULL").count() >= 1


def test_trees_take_the_last_label_then_facts_then_the_concept(spark, links):
    facts = spark.createDataFrame([("f1", "us-gaap:D", "Fact D", 0), ("f1", "us-gaap:D", "Later D", 1), ("f1", "us-gaap:C", "Fact C", 0), ("f2", "us-gaap:D", None, 0)], "accession string, concept string, label string, pos int")
    t = [(r.accession, r.line_order, r.node, r.label, r.source) for r in xbrl.labelled_trees(links, ["accession"], facts).orderBy("accession", "line_order").collect()]
    # The second copy of the linkbase adds nothing; f2 is one cycle, which has no root.
    assert t == [("f1", 1, "us-gaap:P", "us-gaap:P", "concept"), ("f1", 2, "us-gaap:D", "Later D", "company_facts"), ("f1", 3, "us-gaap:C", "Second", "linkbase")]
    assert {r.source for r in xbrl.labelled_trees(links, ["accession"]).collect()} == {"concept", "linkbase"}


def test_rendered_statement(spark, links):
    values = spark.createDataFrame([("f1", "us-gaap:P", -5.0, "USD", 0), ("f1", "us-gaap:C", 5.0, "USD", 0), ("f1", "us-gaap:C", 6.0, "EUR", 1)], "accession string, concept string, numeric_value double, unit string, pos int")
    one = values.where("pos = 0")
    r = [(x.place, x.node, x.value, x.unit, x.calculation_status) for x in xbrl.rendered(links, one, ["accession"]).orderBy("place").collect()]
    assert r == [(1, "us-gaap:P", -5.0, "USD", "ok"), (2, "us-gaap:D", None, None, None), (3, "us-gaap:C", 5.0, "USD", None)]
    only = xbrl.rendered(links, one, ["accession"], values_only=True, limit=1).collect()
    assert [(x.place, x.node) for x in only] == [(1, "us-gaap:P")]
    assert xbrl.rendered(links, one, ["accession"], role="absent").count() == 0
    c = xbrl.filing_checks(links, one.where("concept <> 'us-gaap:P'"), ["accession"], limit=1).collect()
    assert [(x.accession, x.parent, x.status, x.calculated_value) for x in c] == [("f1", "us-gaap:P", "missing_parent", -5.0)]
    assert xbrl.filing_checks(links, one, ["accession"], status="mismatch").where(F.lit(True)).count() == 0
