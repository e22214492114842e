import time
import zlib

from pyspark.sql import functions as F

from filigree.llm.toxicity import Matcher, Model, entries, fit, fold, held_out, remove_toxic, toxicity_report


def test_fold():
    assert fold("You 1d10t, m0r0n!! іdiot «st​upid» ＳＣＵＭ") == " you idiot moron idiot stupid scum "
    assert fold("") == "  " and fold("in 2024 or 3.5") == " in 2024 or 3 5 "


def test_matcher_and_exceptions():
    m = Matcher(Model((("clown ", 2.0), ("idio", 3.0)), ("clown fish",)))
    assert m.total("A CL0WN, an idiot; clowns") == (7.0, 5)
    assert m.total("a clown fish swims") == (0.0, 4) and m.total("clown clown fish clown") == (4.0, 4)
    assert m.total("clownish") == (0.0, 1) and m.total("idiotic") == (3.0, 1)
    assert m.total(None) == (0.0, 0) and Matcher(Model(())).total("x y") == (0.0, 2)


def test_matching_is_linear():
    m = Matcher(Model((("clown ", 2.0),), ("clown fish",)))
    began = time.process_time()
    assert m.total("clown fish clown " * 100_000) == (200_000.0, 300_000)
    assert time.process_time() - began < 5


def test_nested_beginnings_give_words_or_stems():
    found = {w[:n]: (4.0, 30) for w in ["pathetic"] for n in range(4, 9)} | {"pathetic ": (4.0, 30)}
    found |= {"disgustin"[:n]: (4.0, 20) for n in range(4, 10)} | {"disgusting ": (4.0, 20)}
    found |= {"achl": (5.0, 40), "achli": (5.0, 40), "achlich": (5.0, 40), "achlic": (5.0, 40), "achlicha": (5.0, 20), "achlichb": (5.0, 20), "achlicha ": (5.0, 20)}
    assert entries(found) == {"pathetic ": 4.0, "disgusting ": 4.0, "achlich": 5.0}


def labelled(spark):
    r = []
    for i in range(400):
        bad = i % 5 == 0
        words = [f"wo{(i * 7 + k * 13) % 97}rd" for k in range(60)]
        if bad:
            words[i % 50] = words[(i * 3) % 50] = "ninc0mpoop"
        r.append((i, " ".join(words), int(bad)))
    r += [(400 + i, f"wo{i}rd the nincompoop ball wo{i + 1}rd", 0) for i in range(8)]
    return spark.createDataFrame([(i, t) for i, t, _ in r], "doc_id long, text string"), spark.createDataFrame([(i, y, y) for i, _, y in r] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_reach(spark, docs, none):
    d, labels = labelled(spark)
    model = fit(d, labels)
    out = {r.doc_id: r for r in toxicity_report(d, model).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1 and out[i].predicted == int(out[i].score >= 0.5) for i in out)
    assert sum(out[i].predicted == int(i % 5 == 0 and i < 400) for i in out if out[i].held_out) >= 0.97 * sum(r.held_out for r in out.values())
    assert [w for w, _ in model.lexicon] == ["nincompoop "] and {"the nincompoop", "nincompoop ball"} <= set(model.exceptions)
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(d, flipped) == model
    assert toxicity_report(docs, model).count() == docs.count() and toxicity_report(none, model).count() == 0
    kept = remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_without_labels(spark, docs):
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity_report(docs, model).collect())
