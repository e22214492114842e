"""Connected components of an edge table by alternating large and small stars.

Tasks of at most ``TASK_EDGES`` edges first contract them by union-find. What is
left of more than one task goes through rounds of grouped minima and joins on
small rows; each round's table is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.frames import map_arrow, materialise


#: Edges that one task contracts: some seconds, and less than 100 MB.
TASK_EDGES = 300_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(u, v)
    nodes = list(forest.up)
    u = np.array(nodes, dtype=np.int64)
    v = np.array([forest.find(x) for x in nodes], dtype=np.int64)
    keep = u != v
    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (two long columns); comp is the smallest node reachable."""
    a, b = edges.columns
    parts = -(-edges.count() // TASK_EDGES)
    e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).coalesce(max(parts, 1)).transform(map_arrow, _contract, "u long, v long"), "forest")
    seen = None
    while parts > 1:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
