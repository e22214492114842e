"""Corpus pipeline: toxicity, near copies, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filigree.llm.decontamination import remove_contaminated
from filigree.llm.frames import materialise, table
from filigree.llm.keep_one import keep_one
from filigree.llm.mixing import mix
from filigree.llm.sharding import shard
from filigree.llm.toxicity import fit, remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mixture", mixture), ("sharded", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt score and the links of near copies are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
