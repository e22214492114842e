import io
import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from filigree.plans.archive import ArchiveReader, FilesWriter, archive_filings, archived, archived_files, write_files
from filigree.plans.registry import parse_filings
from filigree.sources.documents import split_submission
from filigree.sources.landed import LandedReader, dealt, documents_in, land, landed_documents, packed


def doc(n, kind="10-K", body="x", mark="DOCUMENT"):
    return f"<{mark}>\n<TYPE>{kind}\n<SEQUENCE>{n}\n<FILENAME>d{n}.txt\n<TEXT>\n{body}\n</TEXT>\n</{mark}>\n"


def test_ranges_of_any_size_read_every_document_once():
    r = random.Random(1)
    text = "<SEC-HEADER>\nhead\n" + "".join(doc(n, body="é" * r.randrange(300), mark=r.choice(["DOCUMENT", "document", "Document"])) + r.choice(["", "\n\n between "]) for n in range(40)) + "<DOCUMENT>\n<TYPE>open"
    raw = text.encode()
    want = [d["sequence"] for d in split_submission(text)]
    assert len(want) == 40
    for size in (7, 50, 64, 333, 5000, 1 << 20):
        for block in (1, 9, 100, 1 << 16):
            if size * block < 60:
                continue
            got = [x for a in range(0, len(raw), size) for x in documents_in(io.BytesIO(raw), a, min(len(raw), a + size), block)]
            assert [split_submission("<DOCUMENT>" + b.decode() + "</DOCUMENT>")[0]["sequence"] for _, b in got] == want
            assert [o for o, _ in got] == sorted({o for o, _ in got}) and all(raw[o : o + 10].lower() == b"<document>" for o, _ in got)


def test_small_files_share_a_partition_and_large_ones_are_cut():
    files = [("a", 10), ("b", 10), ("c", 95), ("d", 0)]
    assert packed(files, 40, 5) == [[("a", 0, 10), ("b", 0, 10)], [("c", 0, 40)], [("c", 40, 80)], [("c", 80, 95), ("d", 0, 0)]]


def test_many_small_ranges_share_tasks():
    parts = packed([(f"f{n}", 5000) for n in range(3000)], 2048)
    assert len(parts) == 9000
    out = dealt(parts, 256)
    assert len(out) <= 257 and max(map(len, out)) <= 13
    # Every byte once, in order; pieces of a file that lie in one task are one.
    assert sum(e - a for p in out for _, a, e in p) == 3000 * 5000 and len({x for p in out for x in p}) == sum(map(len, out)) < 3400
    assert [x[0] for p in out for x in p] == sorted((x[0] for p in out for x in p), key=lambda f: int(f[1:]))
    assert dealt(parts[:256], 256) == parts[:256]


def test_planning_does_not_make_a_task_a_file(tmp_path):
    (tmp_path / "form=4" / "cik=1").mkdir(parents=True)
    for n in range(600):
        (tmp_path / "form=4" / "cik=1" / f"{n}.txt").write_text(doc(1) + doc(2))
    r = LandedReader({"path": str(tmp_path), "rangebytes": "64"})
    parts = r.partitions()
    assert len(parts) <= 257 and sum(b.num_rows for p in parts for b in r.read(p)) == 1200


@pytest.fixture
def landed(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    big = "".join(doc(n, "EX-99", "word " * 50) for n in range(200))
    rows = [("SC 13D/A", 5, "0-1", doc(1) + doc(2, "EX-1")), ("10-K", 5, "0-2", big), ("10-K", 6, "0-3", "no documents"), ("10-K", 7, "0-4", doc(1, body=""))]
    land(spark.createDataFrame(rows, "form string, cik long, accession string, text string"), root)
    return root


def test_landed_source(spark, landed, tmp_path):
    assert sorted(os.listdir(tmp_path / "in")) == ["form=10-K", "form=SC%2013D%2FA"]
    df = landed_documents(spark, landed, 4096)
    parts = df.where("accession = '0-2'").select("file_offset", F.spark_partition_id().alias("p")).collect()
    assert len(parts) == 200 and len({x.p for x in parts}) > 5  # one submission, several tasks
    assert sorted({x.form for x in df.collect()}) == ["10-K", "SC 13D/A"]
    some = df.where((F.col("form") == "SC 13D/A") & (F.col("document_type") == "EX-1") & (F.col("byte_length") > 0))
    assert [(x.cik, x.accession, x.sequence, x.content_type) for x in some.collect()] == [(5, "0-1", "2", "text")]
    assert df.where("cik = 99").count() == 0 and df.where("accession = '0-3'").count() == 0
    assert df.where("accession = '0-4'").first().content == ""


def test_choices_reach_planning(spark, landed):
    r = LandedReader({"path": landed, "rangebytes": "4096", "only": json.dumps({"form": ["10-K"], "cik": [5, 9], "sequence": ["7"]})})
    assert {x[3] for p in r.partitions() for x in p.ranges} == {"0-2"}
    assert [b["sequence"].to_pylist() for p in r.partitions() for b in r.read(p)] == [["7"]]
    assert [x.accession for x in landed_documents(spark, landed, form=["SC 13D/A"], document_type=["EX-1"]).collect()] == ["0-1"]
    assert landed_documents(spark, landed, accession=[]).count() == 0
    with pytest.raises(ValueError):
        landed_documents(spark, landed, size=[1])


DOCS = "accession string, company string, form string, filing_date string, source_url string, text_url string, pos int, document_type string, sequence string, filename string, description string, content_type string, content string, document_url string"


def listing(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


def test_archive_of_files(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = [(a, "C", "10-K", "2024-01-02", "s", None, n, "10-K" if n == 0 else None, str(n + 1) if n != 2 else None, [f"a {n}/.htm", None][n % 2], None, "html", "é" * 10 if n else None, "u") for a in ("0/1", "0-2") for n in range(4)]
    out = archive_filings(spark.createDataFrame(rows, DOCS), f"file://{root}", limit_bytes=5, cik=7)
    names = ["001-1-a_0_.htm", "002-2-document.txt", "003-doc-a_2_.htm", "004-4-document.txt"]
    assert listing(root) == sorted([f"{a}/{n}" for a in ("0_1", "0-2") for n in [*names, "filing.json"]] + ["manifest.json"])
    manifest = json.load(open(f"{root}/manifest.json"))
    assert (manifest["filing_count"], manifest["document_count"], manifest["cik"], manifest["limit_bytes"]) == (2, 8, 7, 5)
    assert sorted(os.path.relpath(d["path"].removeprefix("file://"), root) for f in manifest["filings"] for d in f["documents"]) == [x for x in listing(root) if x[0] == "0" and not x.endswith("filing.json")]
    r = out.where("accession = '0/1'").first()
    assert [(d.byte_length, d.written_bytes, d.truncated, d.is_primary) for d in r.documents] == [(0, 0, False, True), (20, 4, True, False), (20, 4, True, False), (20, 4, True, False)]
    assert {(x.name, bytes(x.content)) for x in archived_files(spark, f"file://{root}").collect()} == {(n, "éé".encode()) for n in names[1:]}
    primary = archive_filings(spark.createDataFrame(rows[:4], DOCS), f"file://{tmp_path}/p", primary_only=True)
    assert [len(x.documents) for x in primary.collect()] == [1]
    empty = archive_filings(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none")
    assert empty.count() == 0 and json.load(open(f"{tmp_path}/none/manifest.json"))["filings"] == []


def test_reading_an_archive_lists_no_file_on_the_driver(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = [(f"a{n}", "C", "10-K", "2024-01-02", "s", None, i, "10-K", str(i + 1), "d.txt", None, "text", "x" * (i > 0), "u") for n in range(200) for i in range(2)]
    out = archive_filings(spark.createDataFrame(rows, DOCS), f"file://{root}")
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString() + archived_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    r = ArchiveReader({"path": root, "records": "false", "empty": "true"})
    parts = r.partitions()
    assert len(parts) == 4 and sorted(x for p in parts for x in p.names) == sorted({x[0] for x in rows})
    assert sorted(len(x.documents) for x in archived(spark, root).collect()) == [2] * 200
    assert archived_files(spark, root).count() == 200 and archived_files(spark, root, empty=True).where("bytes = length(content)").count() == 400


def test_lost_attempts_leave_nothing(tmp_path):
    root = f"{tmp_path}/out"
    w = FilesWriter({"path": root, "about": json.dumps({"cik": 1})})
    row = lambda f, n: Row(folder=f, name=n, content="c", head='{"accession": "%s"}' % f, entry=json.dumps({"path": f"{f}/{n}"}))

    def killed():
        yield row("a", "1")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(killed())
    w.write(iter([row("a", "1"), row("a", "stale")]))  # a second attempt that Spark does not accept
    done = [w.write(iter([row("a", "1"), row("a", "2")])), w.write(iter([])), w.write(iter([row("b", "1")])), None]
    assert not os.path.exists(f"{root}/manifest.json")
    w.commit(done)
    m = json.load(open(f"{root}/manifest.json"))
    assert listing(root) == ["a/1", "a/2", "a/filing.json", "b/1", "b/filing.json", "manifest.json"]
    assert [d["path"] for f in m["filings"] for d in f["documents"]] == ["a/1", "a/2", "b/1"] and (m["filing_count"], m["document_count"]) == (2, 3)
    again = FilesWriter({"path": root, "about": "{}"})
    again.commit([again.write(iter([row("a", "3")]))])
    assert listing(root) == ["a/3", "a/filing.json", "b/1", "b/filing.json", "manifest.json"]
    gone = FilesWriter({"path": f"{tmp_path}/x", "about": "{}"})
    gone.abort([gone.write(iter([row("a", "3")]))])
    assert listing(f"{tmp_path}/x") == []


def test_plain_files_are_added(spark, tmp_path):
    for n in (1, 2):
        write_files(spark.createDataFrame([("a/b", f"{n}.txt", "t")], "folder string, name string, content string"), f"file://{tmp_path}/f")
    assert listing(f"{tmp_path}/f") == ["a/b/1.txt", "a/b/2.txt"]


def test_mixed_forms_use_one_pass(spark):
    rows = [(1, " 10-q ", "10-Q", "1", "<h3>Income tax rate and expense</h3><table><tr><td>a</td></tr></table>"), (1, "10-Q", "EX-1", "2", "<table><tr><td>income tax rate</td></tr></table>"), (2, "SC 13D", "SC 13D", "1", "X (Name of Issuer)"), (3, "NT 10-K", "NT", "1", "x"), (4, None, None, "1", "x"), (5, "8-K", "8-K", "1", None), (6, "13F-HR", "13F-HR", "1", "<edgarSubmission/>"), (6, "13F-HR", "information table", "2", "<p:informationTable xmlns:p='p'><p:infoTable/></p:informationTable>"), (7, "3", "3", None, "<ownershipDocument>"), (8, "497K", "497K", "1", "text")]
    docs = spark.createDataFrame(rows, "id int, form string, document_type string, sequence string, content string")
    out = parse_filings(docs, ["id"])
    got = sorted((x.id, x.kind, x.pos, x.error is not None) for x in out.collect())
    assert got == [(1, "company_report", 0, False), (2, "schedule13", 0, False), (6, "thirteenf_holding", 0, False), (7, "form4_transaction", None, True), (8, "fund_disclosure", None, True)]
    assert dict(out.dtypes)["record"] == "variant"
    assert out.where("id = 1").select(F.variant_get("record", "$.topic", "string"), F.variant_get("record", "$.confidence", "double")).first()[:] == ("tax_rate", 0.75)
    assert parse_filings(docs, ["id"], topic="Debt-Maturity").where("id = 1").count() == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_topics_read_a_body_once(spark):
    from filigree.operators import disclosures
    from filigree.plans.registry import _topic_words

    rows = [[f"Net Sales {n}", "É"] for n in range(12)]
    for title in (None, "Debt Maturity"):
        t = {"title_hint": title, "headers": rows[0], "rows": rows}
        df = spark.createDataFrame([(title, rows[0], rows)], "t string, h array<string>, r array<array<string>>")
        assert df.select(disclosures.topic_corpus(F.col("t"), F.col("h"), F.col("r"))).first()[0] == _topic_words(t).lower()
    docs = spark.createDataFrame([(1, "10-K", "10-K", "1", "x")], "id int, form string, document_type string, sequence string, content string")
    assert "from_json" not in parse_filings(docs, ["id"])._jdf.queryExecution().executedPlan().toString()
