import random

from pyspark.sql import functions as F

from filigree.plans.statements import stitched_statements
from filigree.streaming.restatements import _order, current, restatements

FACTS = "cik long, taxonomy string, concept string, label string, unit string, pos int, value string, numeric_value double, fy long, fp string, form string, filed string, start string, end string, accession string"


def facts():
    r = random.Random(3)
    out = []
    for i in range(160):
        form, fp = r.choice([("10-K", "FY"), ("10-K/A", "FY"), ("10-Q", "Q3"), ("10-K", "Q4"), ("8-K", None)])
        concept = r.choice(["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax", "Assets", "Unknown"])
        v = r.randrange(9)
        out.append((r.randrange(3), r.choice(["us-gaap", "us-gaap", "ifrs-full"]), concept, None, r.choice(["USD", "EUR"]), i % 3, str(v), float(v), 2020, fp, form, r.choice(["2021-02-01", "2021-03-01", "2022-02-01", None]), None, r.choice(["2020-12-31", "2021-12-31", None]), f"a-{r.randrange(6)}" if i % 9 else None))
    return out


COLUMNS = ["cik", "statement", "line_item", "period", "form", "filed", "end", "accession", "numeric_value", "source_count", "duplicate_forms"]


def want(spark, rows):
    s = stitched_statements(spark.createDataFrame(rows, FACTS), latest=1000).withColumn("period", F.coalesce("end", "filed", F.lit("unknown"))).withColumn("duplicate_forms", F.array_join("duplicate_forms", ","))
    return sorted(map(str, s.select(*COLUMNS).collect()))


def test_any_order_of_batches_gives_the_stitched_statements(spark, tmp_path):
    rows = facts()
    expected = want(spark, rows)
    for seed in (1, 2):
        r = random.Random(seed)
        r.shuffle(rows)
        root = tmp_path / str(seed)
        for k in range(3):
            spark.createDataFrame(rows[k::3], FACTS).coalesce(1).write.parquet(f"file://{root}/in", mode="append")
        stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(f"file://{root}/in")
        q = restatements(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{root}/cp").trigger(availableNow=True).start(f"file://{root}/out")
        q.awaitTermination()
        events = spark.read.parquet(f"file://{root}/out")
        assert sorted(map(str, current(events).select(*COLUMNS).collect())) == expected
        assert {x.change for x in events.select("change").distinct().collect()} >= {"new", "restated", "confirmed"}
        assert events.groupBy("cik", "statement", "line_item", "period", "version").count().where("count > 1").count() == 0
        old = events.where("change = 'restated'").first()
        assert old.version > 1 and old.previous_form is not None


def test_an_amendment_restates_and_a_better_concept_withdraws(spark, tmp_path):
    row = lambda concept, form, filed, end, v: (1, "us-gaap", concept, None, "USD", 0, str(v), float(v), 2020, "FY", form, filed, None, end, f"{form}-{filed}")
    batches = [[row("SalesRevenueNet", "10-K/A", "2021-01-01", "2020-12-31", 5)], [row("SalesRevenueNet", "10-K/A", "2021-05-01", "2020-12-31", 6), row("SalesRevenueNet", "10-K", "2020-01-01", "2019-12-31", 4)], [row("SalesRevenueNet", "10-K", "2021-02-01", "2020-12-31", 7)], [row("Revenues", "10-K", "2021-02-01", "2020-12-31", 9)]]
    stream = None
    for i, b in enumerate(batches):
        spark.createDataFrame(b, FACTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/b{i}")
        stream = spark.readStream.schema(FACTS).parquet(f"file://{tmp_path}/in/b*")
        restatements(stream, "income").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = sorted((x.period, x.version, x.change, x.numeric_value, x.previous_value) for x in spark.read.parquet(f"file://{tmp_path}/out").where("line_item = 'revenue'").collect())
    assert got == [("2019-12-31", 1, "new", 4.0, None), ("2019-12-31", 2, "withdrawn", 4.0, 4.0), ("2020-12-31", 1, "new", 5.0, None), ("2020-12-31", 2, "restated", 6.0, 5.0), ("2020-12-31", 3, "restated", 7.0, 6.0), ("2020-12-31", 4, "restated", 9.0, 7.0)]


def test_order():
    r = lambda **k: {"rank": 0, "filed": "2021", "end": None, "accession": "b", "unit": "USD", "pos": 1, "value": "1"} | k
    assert _order(r(filed="2022")) < _order(r()) < _order(r(filed=None)) and _order(r(accession="bb")) < _order(r()) < _order(r(accession="a"))
    assert _order(r(unit=None)) < _order(r()) and _order(r(pos=2)) < _order(r()) < _order(r(rank=1)) and _order(r(value=None)) < _order(r())
