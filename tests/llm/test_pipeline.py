import corpus_pipeline as c
import pyarrow as pa
import pyarrow.parquet as pq

from filigree.llm.decontamination import Item, Templates
from filigree.llm.toxicity import _scores, fit
from filigree.llm.words import text_slices

from .test_ngram_join import brute

import pytest


@pytest.fixture
def folder(spark, docs, tmp_path):
    from .test_decontamination import CHANGED, ITEM, SAME
    from .test_toxicity import labelled

    d, labels = labelled(spark)
    extra = spark.createDataFrame([(900, SAME), (901, CHANGED)], "doc_id long, text string").union(d.selectExpr("doc_id + 5000", "text"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra, True).write.parquet(str(tmp_path / "documents.parquet"))
    labels.selectExpr("doc_id + 5000 as doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run_against_stages_by_hand(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    model = fit(docs, spark.read.parquet(folder + "/labels.parquet"))
    rows = pq.read_table(folder + "/documents.parquet", columns=["doc_id", "text"])
    scores = _scores(rows["text"].combine_chunks(), model)
    left = [(i, t) for i, t, s in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), scores, strict=True) if s < 0.5]
    assert len(left) < rows.num_rows
    comp = {i: x for i, _, x in brute(left)}
    kept = {}
    for i, t in left:
        if i is None or comp[i] == i:
            kept[(i, t)] = 1
    item = Item(spark.read.parquet(folder + "/benchmark.parquet").first().text)
    found = {k: item.find(Templates(next(text_slices(pa.array([k[1] or ""])))[2]), 0, 0.6) for k in kept}
    clean = {k for k, f in found.items() if not (f and f[4])}
    assert (900, None) not in clean and not any(i in (900, 901) for i, _ in clean)
    out = c.run(spark, folder).collect()
    assert {(r.doc_id, r.text) for r in out} <= clean
    assert all(0 <= r.shard < 64 for r in out)
    words = lambda t: len((t or "").encode().split())
    assert abs(sum(words(r.text) for r in out) - sum(words(t) for _, t in clean)) < 0.2 * sum(words(t) for _, t in clean)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").limit(0)
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
