"""Registered queries of streams: they run to the end of their input and return what it amounts to."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.plans.oracles import ORACLES as _TABLES
from filigree.sources import adapters
from filigree.sources.shared import shared_folder
from filigree.streaming.restatements import current, restatements


def restated_statements(s, d):
    """All facts as files of one form and year each, in an order far from that of filing, through the stream of restatements."""
    facts, root = adapters.facts(s, d), shared_folder(s, "facts")
    facts.repartitionByRange(4, F.xxhash64("form", "fy")).write.parquet(f"{root}/in")
    stream = s.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    q = restatements(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    out = current(s.read.parquet(f"{root}/out"))
    return out.select("cik", "statement", "line_item", "end", "form", "filed", "numeric_value", "duplicate_forms", F.col("source_count").cast("long").alias("source_count"))


QUERIES = {"restated_statements": restated_statements}

_STITCHED = _TABLES["stitch_best_form"].replace("FROM s WHERE n <= 12", "FROM s").replace("WHERE rn <= 4", "")
ORACLES = {"restated_statements": f'SELECT cik, statement, line_item, "end", form, filed, numeric_value, duplicate_forms, source_count FROM ({_STITCHED})'}
