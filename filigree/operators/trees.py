"""Presentation trees, calculation checks and rendered statements of XBRL links.

Edges have cik or accession, role, parent, child, ord (display order) and
weight. Trees are walked level by level until one is empty, so a
level of any width stays distributed; a path never enters a node twice, so
cycles end. Each level is stored in the shared folder: neither lineage nor
executors' caches grow with the depth.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.sources.shared import stored


def roots(edges: DataFrame, by: list[str]) -> DataFrame:
    """Parents that are no child in the same tree."""
    return edges.select(*by, F.col("parent").alias("node")).distinct().join(edges.select(*by, F.col("child").alias("node")).distinct(), [*by, "node"], "left_anti")


def preorder(edges: DataFrame, by: list[str], max_depth: int | None = None) -> DataFrame:
    """Nodes in preorder: depth, line_order within the tree and path; children by ord (null first), then name."""
    level = roots(edges, by).select(*by, "node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.array(F.struct(F.lit(None).cast("double").alias("o"), F.col("node").alias("c"))).alias("key"))
    step = edges.select(*by, F.col("parent").alias("node"), F.col("child").alias("_child"), F.col("ord").cast("double").alias("_ord"))
    out = level
    for _ in count() if max_depth is None else range(max_depth):
        level = level.join(step, [*by, "node"]).where(~F.array_contains("path", F.col("_child"))).select(*by, F.col("_child").alias("node"), F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_child")).alias("path"), F.concat("key", F.array(F.struct(F.col("_ord").alias("o"), F.col("_child").alias("c")))).alias("key"))
        level = stored(level, "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    w = Window.partitionBy(*by).orderBy("key")
    return out.withColumn("line_order", F.row_number().over(w)).withColumn("path", F.array_join("path", " > ")).drop("key")


def calculation_checks(edges: DataFrame, values: DataFrame, by: list[str], tolerance: float = 1.0) -> DataFrame:
    """Sum of weighted children against each parent's value.

    ``values`` has ``by``, concept and numeric_value, one row each. A null
    weight counts 1; the tolerance holds for the absolute or relative difference.
    """
    child = values.select(*by, F.col("concept").alias("child"), F.col("numeric_value").alias("_cv"))
    parent = values.select(*by, F.col("concept").alias("parent"), F.col("numeric_value").alias("parent_value"))
    g = edges.join(child, [*by, "child"], "left").groupBy(*by, "role", "parent").agg(
        F.sum(F.col("_cv") * F.coalesce("weight", F.lit(1.0))).alias("calculated_value"), F.count("*").alias("child_count"), F.count("_cv").alias("matched_children"), F.array_sort(F.collect_list(F.when(F.col("_cv").isNull(), F.col("child")))).alias("missing_children")
    )
    g = g.join(parent, [*by, "parent"], "left").withColumn("difference", F.col("parent_value") - F.col("calculated_value"))
    relative = F.abs("difference") / F.greatest(F.abs("parent_value"), F.lit(2.220446049250313e-16))
    status = F.when(F.col("parent_value").isNull(), "missing_parent").when(F.col("matched_children") == 0, "missing_children").when(F.abs("difference") <= tolerance, "ok").when(relative <= tolerance, "ok").otherwise("mismatch")
    return g.withColumn("relative_difference", F.when(F.abs("parent_value") > 0, relative)).withColumn("status", status)


def render(tree: DataFrame, values: DataFrame, checks: DataFrame | None, labels: DataFrame | None, by: list[str], values_only: bool = False) -> DataFrame:
    """Tree rows with the last value, check and label of each concept; the label falls back to the concept."""
    last = values.groupBy(*by, F.col("concept").alias("node")).agg(F.max_by(F.struct("numeric_value", "unit", "label"), "pos").alias("_v"))
    df = tree.join(last, [*by, "node"], "inner" if values_only else "left")
    if checks is not None:
        c = checks.groupBy(*by, F.col("parent").alias("node")).agg(F.max_by(F.struct("status", "difference", "relative_difference"), "role").alias("_c"))
        df = df.join(c, [*by, "node"], "left")
    if labels is not None:
        df = df.join(labels.groupBy(*by, F.col("concept").alias("node")).agg(F.max_by("label", "ord").alias("_l")), [*by, "node"], "left")
    label = F.coalesce(*([F.col("_l")] if labels is not None else []), F.col("_v.label"), F.col("node"))
    extra = [F.col("_c.status").alias("calculation_status"), F.col("_c.difference").alias("calculation_difference")] if checks is not None else []
    return df.select(*by, "node", "parent", "depth", "line_order", "path", label.alias("label"), F.col("_v.numeric_value").alias("value"), F.col("_v.unit").alias("unit"), *extra)
