"""One document of each group of near copies: what the n-gram Jaccard join decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.frames import id_filter, materialise, with_filter
from filigree.llm.ngram_join import K, PERCENT, link


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose group holds a smaller doc_id; of rows with one doc_id, one stays.

    Rows with a null doc_id and documents without words stay. Rows that no
    decision concerns pass by without a shuffle.
    """
    found = materialise(link(docs, k, percent).where("doc_id IS NOT NULL"), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct().withColumn("_gone", F.lit(True))
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id").withColumn("_gone", F.lit(False))
    marked = gone.union(again).groupBy("doc_id").agg(F.max("_gone").alias("_gone")).withColumnRenamed("doc_id", "_id")
    marked = materialise(marked, "groups-marked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_id", F.col("_row.doc_id"))
    rows = with_filter(rows, id_filter(marked, "_id"), "_id")
    met = rows.where("_may").join(marked, "_id", "left").where("_gone IS NULL OR NOT _gone")
    apart = met.where("_gone IS NULL").select("_row.*")
    one = met.where("_gone IS NOT NULL").groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row")).select("_row.*")
    return rows.where("NOT _may").select("_row.*").union(apart).union(one)
