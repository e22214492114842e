import math
import random

import pytest
from pyspark.sql import functions as F

from filigree.llm import hard_negatives
from filigree.llm.hard_negatives import Best, exact, hard_negatives as mine, share_down, share_up

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    seen = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[(i, y, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    for i, y, v in seen:
        if i % 5:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w, strict=False)), j, z == y) for j, z, w in seen if j != i})
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, p, r, j, -s, -n) for r, (n, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    def f32(x):
        import struct

        return struct.unpack("f", struct.pack("f", x))[0]

    rows = [(i, [f32((c + r.gauss(0, 0.6)) / 4) for c in centres[r.randrange(4)]], r.randrange(3)) for i in range(260)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(120)] + [(2000 + i, hot, 2) for i in range(9)]  # one vector many times, two labels
    rows += [rows[0], rows[5], rows[5], rows[30]]  # repeated rows
    rows += [(3000, None, 1), (3001, [0.1, None], 1), (3002, [float("nan")] * 12, 1), (3003, [float("inf")] + [0.0] * 11, 0), (3004, hot, None), (None, hot, 1)]
    rows += [(3005, [], 1), (3010, [0.0] * 12, 0), (3015, [0.5, 0.25], 2), (3020, [-x for x in hot], 1)]  # empty, zero, short and opposite anchors
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("x")).withColumn("k", F.lit(9)).withColumn("score", F.lit(None).cast("string"))
    return sorted(tuple(x) for x in mine(df, F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") % 5 == 0, **kw).collect())


def test_against_brute_force(spark, vectors):
    assert run(spark, vectors) == brute(vectors)
    assert run(spark, vectors, positives=2, negatives=4, low=10, high=100) == brute(vectors, 2, 4, 10, 100)


def test_joined_way_small_blocks_and_many_chunks(spark, vectors, monkeypatch):
    for name, value in (("BROADCAST_BYTES", 0), ("TASK_BLOCKS", 2), ("BLOCK_CELLS", 300), ("CHUNK_CELLS", 240), ("TILE", 16), ("HELD", 1), ("FIT_CELLS", 400)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert run(spark, vectors) == brute(vectors)


def test_large_components(spark):
    rows = [(i, [float(2 ** (10 + i % 9)), -float(3 + i), 2.0**18 * (i % 2)], i % 2) for i in range(30)] + [(50, [3e38, 1.0, 1.0], 0), (52, [1e30, 1e30, 0.0], 0)]
    top = 2**63 - 1
    want = [(i, p, r, j, min(s, top), min(n, top)) for i, p, r, j, s, n in brute([x for x in rows if x[0] < 50])]
    assert run(spark, rows[:30]) == sorted(want)
    out = run(spark, rows)
    assert all(abs(x[4]) <= top and abs(x[5]) <= top for x in out)


def test_empty_and_no_anchor(spark, vectors):
    assert run(spark, []) == [] and run(spark, [x for x in vectors if x[0] and x[0] % 5]) == []


def test_shares_do_not_round():
    import numpy as np

    for p in (50, 95, 1, 99):
        v = np.array([*range(-400, 400), 2**62 + 7, -(2**62) - 7])
        assert share_up(v, p).tolist() == [-(-p * int(x) // 100) for x in v] and share_down(v, p).tolist() == [p * int(x) // 100 for x in v]


def test_best_keeps_ties_by_id():
    import numpy as np

    b = Best(2, 2)
    b.add(np.array([0, 0, 1]), np.array([5, 5, 7]), np.array([9, 4, 1]))
    b.add(np.array([0, 0]), np.array([5, 5]), np.array([4, 1]))
    assert b.id.tolist() == [1, 4, 1] and b.floor.tolist() == [5, np.iinfo(np.int64).min]


def test_product_is_exact():
    import numpy as np

    axes = np.eye(3)
    a = hard_negatives.Rotated(np.array([1]), np.array([0]), np.array([[3e9, 2.0, -1.0]]), axes, [3], 0.0)
    assert exact(a, a, np.array([0]), np.array([0])).tolist() == [9 * 10**18 + 5]
