import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.functions import scalars as X
from filigree.plans import company_reports as R
from filigree.plans import export as E


def test_json_arrays_and_arrow_parts(spark, tmp_path):
    df = spark.range(2500).repartition(3).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('a"|\n'), F.col("id").cast("string"))).alias("s"), F.array("id").alias("x"))
    want = [{"id": i, "s": f'a"|\n{i}' if i % 2 == 0 else None, "x": [i]} for i in range(2500)]
    for kind in ("json", "pretty"):
        E.write(df, f"file://{tmp_path}/{kind}.json", kind)
        assert sorted(json.load(open(tmp_path / f"{kind}.json")), key=lambda r: r["id"]) == want
    E.write(df.limit(0), f"file://{tmp_path}/none.json", "json")
    assert json.load(open(tmp_path / "none.json")) == []
    E.write(df, f"file://{tmp_path}/t", "arrow", True)
    names = sorted(os.listdir(tmp_path / "t"))
    assert names == [f"part-{i:05d}.arrow" for i in range(len(names))] and len(names) == 3
    t = pa.concat_tables([pa.ipc.open_file(str(tmp_path / "t" / n)).read_all() for n in names])
    assert t.num_rows == 2500 and {str(f.type) for f in t.schema} <= {"string", "large_string"}
    back = E.read_arrow(spark, f"file://{tmp_path}/t", "id string, s string, x string")
    assert sorted(r.id for r in back.collect()) == sorted(str(i) for i in range(2500)) and back.where("id = '7'").first().x == "[7]"
    assert sorted(x for x in os.listdir(tmp_path) if "staging" in x) == []


def test_lost_parts_leave_nothing(tmp_path):
    w = E.PartsWriter({"path": f"{tmp_path}/a.json", "kind": "json"})
    batch = lambda *v: pa.RecordBatch.from_pydict({"json": list(v)})
    w.write(iter([batch("1", "2")]))  # an attempt that Spark does not accept
    w.commit([w.write(iter([batch("1"), batch(), batch("2")])), None, w.write(iter([])), w.write(iter([batch("3")]))])
    assert open(tmp_path / "a.json").read() == "[1, 2, 3]" and os.listdir(tmp_path) == ["a.json"]
    w = E.PartsWriter({"path": f"{tmp_path}/b", "kind": "arrow"})
    w.abort([w.write(iter([batch("1")]))])
    assert os.listdir(tmp_path) == ["a.json"]


def test_export_kinds(spark, tmp_path):
    f = spark.createDataFrame([(1, "a", "10-K", "2024-01-01", 0), (1, "b", "10-Q", "2024-02-01", 1)], "cik long, accession string, form string, filing_date string, pos int")
    assert E.export("filings", f, f"file://{tmp_path}/f", form="10-k") == 1
    assert spark.read.parquet(f"file://{tmp_path}/f").first().cik == "1"
    for bad in (lambda: E.export("facts", f, "x"), lambda: E.export("other", f, "x"), lambda: E.export("filings", f, "x", "csv")):
        with pytest.raises(ValueError):
            bad()


def test_exports_of_facts_read_the_orders_once(spark, monkeypatch):
    from filigree.plans.outputs import exported_kinds

    read: dict[str, list[str]] = {}
    for kind, f in E.KINDS.items():
        monkeypatch.setitem(E.KINDS, kind, lambda source, _k=kind, _f=f, **query: read.setdefault(_k, [*source.inputFiles()]) and _f(source, **query))
    assert {r.kind for r in exported_kinds(spark, "/root/testdata/sf0.001").select("kind").distinct().collect()} == set(E.KINDS)
    assert not any("lineitem" in x for k, files in read.items() for x in files) and set(read) == set(E.KINDS)


METRICS = "cik long, period_end string, metric string, category string, unit string, value double, display_value string, source_urls array<string>, components array<struct<key:string,value:double>>"


def test_financial_report_of_all_companies(spark):
    m = lambda cik, p, k, v, shown, unit="ratio": (cik, p, k, "c", unit, v, shown, ["u1", "u2"], [("a", 1.0), ("b", 2.0)])
    rows = [m(1, "2023", "net_margin", 0.2, "20.00%"), m(1, "2022", "net_margin", 0.1, "10.00%"), m(1, "2021", "net_margin", 0.1, "10.00%"), m(1, "2023", "current_ratio", 0.5, "0.50x", "multiple"), m(1, "2023", "free_cash_flow", -1234.6, "x", "USD"), m(1, "2023", "liabilities_to_assets", 0.9, "90.00%"), m(2, "2023", "net_margin", 0.2, "20.00%")]
    subjects = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "None")], "cik long, subject string")
    out = {r.cik: r.markdown for r in R.financial_reports(spark.createDataFrame(rows, METRICS), subjects, latest=2).collect()}
    one = out[1]
    assert one.startswith("# Financial Trend Report\n\n- Subject: One\n- CIK: 1\n\n## Latest metrics\n\n| Metric | Category | Value | Period | Calculation | Source |\n| --- | --- | ---: | --- | --- | --- |\n")
    assert "| net_margin | c | 20.00% | 2023 | a / b | [SEC](u1) |\n" in one and "| free_cash_flow | c | -$1,235 | 2023 |" in one and "2021" not in one
    assert "| 2022 | - | 10.00% | - | - | - | - | - |\n" in one
    assert "- Net margin improved: 20.00% vs 10.00% in the prior period.\n- Current ratio is below 1.0x at 0.50x.\n- Liabilities/assets is elevated at 90.00%.\n" in one
    assert "No threshold-based signals" in out[2] and "No comparable metric periods" in out[3]


def test_other_reports(spark, tmp_path):
    subjects = spark.createDataFrame([(1, "One"), (2, "Two")], "cik long, subject string")
    sections = spark.createDataFrame([(1, "1A", "10-K", "2024", "u", "a\nb", 9, 3), (1, "1A", "10-K", "2023", "v", "old", 9, 3)], "cik long, item string, form string, filing_date string, source_url string, content string, byte_length long, returned_bytes long")
    risk = R.risk_reports(sections, subjects)
    out = {r.cik: r.markdown for r in risk.collect()}
    assert "- Filing: 10-K 2024\n- Source: [SEC](u)\n- Returned bytes: 3 / 9\n\n> a b\n\n## MD&A\n\nNo section was extracted" in out[1] and out[2].count("No section") == 2
    R.write_reports(risk, f"file://{tmp_path}/r")
    assert open(tmp_path / "r" / "cik=1" / "report.md").read() == out[1]
    empty = spark.createDataFrame([], "cik long, filing_date string, period_of_report string, owner string, role string, net_shares double, total_value double, source_url string, pos int")
    assert all("| ---: | ---: | --- |\n\nUse" in r.markdown for r in R.insider_reports(empty, subjects).collect())


def test_number_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.dollars(F.lit(1234567))), one(X.signed_dollars(F.lit(-1200))), one(X.signed_dollars(F.lit(1200))), one(X.signed_dollars(F.lit(0)))] == ["$1,234,567", "-$1,200", "+$1,200", "+$0"]
    assert [one(X.signed_number(F.lit(v))) for v in (5.0, -1234.0, 0.0, 2.5, -2.5)] == ["+5", "-1,234", "0", "+2.50", "-2.50"]
    assert one(X.cell(F.lit("A|B\nC"))) == "A\\|B C" and one(X.bar(F.lit(1.0), F.lit(0.0))) == "............"


def test_search_pages(spark):
    from filigree.sources.filings import efts_url, search_pages

    rows = [(1, " a & b ", ["10-K"], [12], None, "2024-02-01", 250), (2, "q", None, None, None, None, None), (3, "q", [], [], "2024-01-01", None, 0)]
    out = [(r.k, r.page, r.url) for r in search_pages(spark.createDataFrame(rows, "k int, query string, forms array<string>, ciks array<long>, start string, end string, size int")).orderBy("k", "page").collect()]
    base = "https://efts.sec.gov/LATEST/search-index?q="
    assert [x[2] for x in out if x[0] == 1] == [f"{base}a+%26+b&from={o}&size={n}&dateRange=custom&enddt=2024-02-01&forms=10-K&ciks=0000000012" for o, n in ((0, 100), (100, 100), (200, 50))]
    assert out[3][2] == f"{base}q&from=0&dateRange=all" == efts_url("q") and out[4][2].startswith(f"{base}q&from=0&size=0&dateRange=custom&startdt=2024-01-01")
    assert efts_url(" a & b ", ["10-K"], [12], None, "2024-02-01", 250) == f"{base}a+%26+b&from=0&size=100&dateRange=custom&enddt=2024-02-01&forms=10-K&ciks=0000000012"


def test_agent_packs(spark):
    subjects = spark.createDataFrame([(1, "One"), (2, "Two")], "cik long, subject string")
    f = spark.createDataFrame([(1, "a", "u1"), (1, "b", "u2")], "cik long, accession string, source_url string")
    sections = spark.createDataFrame([(1, "1A", "u1")], "cik long, item string, source_url string")
    scored = spark.createDataFrame([(1, "m", ["u3", "u1"])], "cik long, metric string, source_urls array<string>")
    out = {r.cik: r for r in R.agent_packs(subjects, f, sections, scored, scored, "10-K", 2, 4, ["risk"]).collect()}
    assert (out[1].filing_count, out[1].section_count, out[1].metric_count, out[1].score_count) == (2, 1, 1, 1) and out[1].source_urls == ["u1", "u2", "u3"]
    assert (out[2].filing_count, out[2].score_count, out[2].source_urls) == (0, 0, []) and len(out[2].next_commands) == 3
