"""Applying a document parser to a column of texts, distributed and Arrow-batched.

A parser takes one text and returns a list of dictionaries. Rows of the result
carry the key columns of their document; a document that a parser cannot read
gives one row whose ``_error`` tells why, and never fails the query.
A parser's tasks are those of its documents; ``dealt`` spreads documents, or what
they are made of, where these come from few short files.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of documents after which their rows are handed on.
SLICE = 1 << 21


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by their keys.

    A file of short rows is read by one task however many rows it has, and a
    document made of each takes far longer to parse than the row to move. A fixed
    number of partitions, since the planner would join partitions of few bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def parsed(docs: DataFrame, keys: list[str], content: str, parser: Callable[[str], list[dict]], schema: str) -> DataFrame:
    own = T.StructType([docs.schema[k] for k in keys])
    full = T.StructType([*own.fields, *T.StructType.fromDDL(schema).fields, T.StructField("_error", T.StringType())])
    arrow = to_arrow_schema(full)
    fields = [(f.name, arrow.field(i).type) for i, f in enumerate(full.fields)]

    def columns(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in fields], schema=arrow)

    def run(batches):
        for b in batches:
            texts, own_columns = b.column(b.num_columns - 1), b.columns[:-1]
            rows, size = [], 0
            for i in range(b.num_rows):
                # One document at a time: a batch of large ones is not held twice as objects.
                text = texts[i].as_py() or ""
                key = {k: c[i].as_py() for k, c in zip(keys, own_columns, strict=True)}
                try:
                    rows += [key | x for x in parser(text)]
                except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
                    rows.append(key | {"_error": f"{type(e).__name__}: {e}"})
                size += len(text)
                if size >= SLICE and rows:
                    yield columns(rows)
                    rows, size = [], 0
            if rows:
                yield columns(rows)

    return docs.select(*keys, content).mapInArrow(run, full)
