import os

from pyspark.sql import functions as F

from filigree.plans import export, registry, reports
from filigree.plans.queries import QUERIES
from filigree.streaming.daily import new_filings, read_daily, window_counts

DATA = "/root/testdata/sf0.001"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\n', [1, 2]), (2, None, None)], "k long, s string, x array<int>")
    assert export.to_json(df) == '[{"k": 1, "s": "a,\\"b\\"\\n", "x": [1, 2]}, {"k": 2, "s": null, "x": null}]' and "|  1|" in export.to_table(df)
    for kind in ("parquet", "jsonl", "csv"):
        export.write(df, str(tmp_path / kind), kind)
    export.write(df, str(tmp_path / "t.arrow"), "arrow", True)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).where("k = 1").first().x == "[1,2]"
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2 and os.path.getsize(tmp_path / "t.arrow") > 100
    docs = spark.createDataFrame([("a-1", 0, "1", "x/y.htm", "10-K", "héllo"), ("a-1", 1, None, None, "EX", "b")], "accession string, pos int, sequence string, filename string, document_type string, content string")
    m = export.archive(docs, str(tmp_path / "arch"), 2).first()
    assert m.documents == 2 and m.bytes == 2 and [f.stored_name for f in m.files] == ["001-1-x_y.htm", "002-0-unknown"]


def test_registry_and_resolver(spark):
    assert registry.family_of(" 424b4 ") == ("prospectus", "prospectus") and registry.family_of("x") is None
    docs = spark.createDataFrame([(1, "8-K", "1", "<p>Item 8.01 Other Events took place in the town.</p>")], "accession long, document_type string, sequence string, content string")
    r = registry.parse_form(docs, "8-k", ["accession"]).first()
    assert r.kind == "eightk_event" and '"item":"8.01"' in r.record
    answers = iter(["sorry", 'Here: ```json\n{"candidates": [{"name": "A", "cik": "7"}, {"name": "B"}]}\n```'])
    assert [(c["cik"], c["status"]) for c in registry.resolve("a", lambda p: next(answers), {7: "A Inc"}.get)] == [(7, "validated"), (None, "unverified")]


def test_reports(spark):
    m = spark.createDataFrame([(1, "2023", "net_margin", 0.2, "20.00%", ["u"]), (1, "2022", "net_margin", 0.1, "10.00%", ["v"]), (1, "2023", "current_ratio", 0.5, "0.50x", ["u"])], "cik long, period_end string, metric string, value double, display_value string, source_urls array<string>")
    t = reports.financial(m, 1)
    assert "net_margin improved by 10.0%" in t and "current_ratio is below 1" in t and "| net_margin | 20.00% | 10.00% |" in t and "No data" in reports.financial(m, 2)
    s = spark.createDataFrame([(1, "1A", "Risk Factors", "risky")], "cik long, item string, title string, content string")
    assert "risky" in reports.risk(s)
    p = reports.agent_pack(s.select("cik", "item"), s, m, s).first()
    assert p.source_urls == ["u", "v"] and p.next_commands[0] == "statements --cik 1"
    h = spark.createDataFrame([(1, "x", "A", 100, "new", 100.0)], "cik long, cusip string, class string, value_usd long, change_type string, value_change double")
    assert "| x | A | 100 | " in reports.portfolio(h, h, 1)
    assert "| o | 1 |" in reports.insider(spark.createDataFrame([("o", 1, 2.0)], "owner string, transaction_count int, net_shares double"))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.idx").write_text("CIK|Company|Form|Date|File\n1|A|8-K|20240102|x/1-1-1.txt\n1|A|8-K|20240102|x/1-1-1.txt\n2|B|4|20240103|x/2-2-2.txt\n")
    q = new_filings(read_daily(spark, str(tmp_path / "in")), "8-K").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.accession for r in spark.table("seen").collect()] == ["1-1-1"]
    e = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 02:00:00", "a")], "t string, form string").select(F.col("t").cast("timestamp").alias("ts"), "form")
    assert sorted(r.n for r in window_counts(e, "1 day").collect()) == [1, 2]


def test_queries_against_sql(spark):
    """Quick ones here; the driver compares all of them."""
    import duckdb

    from filigree.plans.oracles import ORACLES

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    for name in ("filings_latest", "holdings_diff", "insider_summary", "calc_checks", "exhibit_category", "search_exact", "facts_topk"):
        df = QUERIES[name](spark, DATA)
        want = con.sql(ORACLES[name]).df()
        cols = sorted(df.columns)
        canon = lambda rows: sorted(repr([round(float(v), 4) if isinstance(v, float) else None if v != v else v for v in r]) for r in rows)
        got = df.select(*cols).toPandas()
        assert sorted(want.columns) == cols and canon(got.astype(object).where(got.notna(), None).values.tolist()) == canon(want[cols].astype(object).where(want[cols].notna(), None).values.tolist()), name
    assert set(ORACLES) <= set(QUERIES)


def test_form_queries_against_sql(spark):
    import collections

    import duckdb

    from filigree.plans.forms import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, query in QUERIES.items():
        df, expected = query(spark, DATA), db.sql(ORACLES[name])
        cols = sorted(df.columns)
        assert sorted(expected.columns) == cols, name
        rows = collections.Counter(repr(tuple(r)) for r in df.select(*cols).collect())
        assert rows == collections.Counter(repr(r) for r in expected.project(", ".join(f'"{c}"' for c in cols)).fetchall()), name


def test_json_array_has_every_record(spark):
    import json

    from filigree.plans.export import to_json

    df = spark.range(10_050)
    assert len(json.loads(to_json(df))) == 10_050 and len(json.loads(to_json(df, limit=3))) == 3


def test_value_queries_have_sql():
    from filigree.plans import values

    assert set(values.oracles("SELECT 1")) == set(values.QUERIES)
