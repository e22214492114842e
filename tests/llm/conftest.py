import random

import pytest

WORDS = "lor ipa dum set con tor elit sed mod tem inc idu unt lab ore dol mag ali qua uti nim ven".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(WORDS) + r.choice(["", "", "é", "us", "a"])
        out.append(w.capitalize() if i % 11 == 0 else w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, copies, near copies, repeats and a long text."""
    base, long = prose(1, 160), prose(2, 3000)
    passage = prose(3, 70)
    out = [(0, None), (1, ""), (2, " \t\n\r\x0b\f "), (3, "one two"), (4, "one  two\n"), (5, base), (6, base), (7, base.upper()), (8, edited(base, 5, 2)), (9, edited(base, 6, 40)), (10, long), (11, edited(long, 7, 9)), (12, prose(8, 90) + " " + passage + " " + prose(9, 80)), (13, prose(10, 20) + " " + passage), (14, passage), (15, "x" * 5000), (16, "In. " * 400), (17, "ab " * 120 + "\n" + "ab " * 120), (18, "Ünï cödé ñ " * 30), (None, base), (None, None)]
    out += [(20 + i, edited(base, 50 + i, 3 + i % 5)) for i in range(12)] + [(40 + i, prose(100 + i, 40 + i)) for i in range(20)]
    rows = [(i, t, "en", [None, "b", "a", "é", "src"][k % 5], len(t or "")) for k, (i, t) in enumerate(out)]
    return [*rows, rows[5], rows[10]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows over several partitions, with extra columns whose names operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumn("size", F.lit("mine")).withColumn("slot", F.lit(-7)).withColumn("target", F.lit("t")).withColumn("_row", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("n", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
