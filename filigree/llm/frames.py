"""Shared helpers: table access, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="filigree-")
        sc.setCheckpointDir(base)
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/filigree-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of the batches that go to Python workers while scratch tables are written.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Bounds the Arrow batches of the jobs inside, so that long texts do not add up in executors."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _release() -> None:
    """Gives freed memory of this worker back to the system: workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers release their memory at the end of a task."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return map_arrow(df, run, schema)


def null_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Bits of the filters below: a megabyte, whatever the input.
FILTER_BITS = 23


def _filter_word(col: str):
    return F.shiftrightunsigned(F.xxhash64(col), 6).bitwiseAND((1 << (FILTER_BITS - 6)) - 1)


def id_filter(ids: DataFrame, col: str) -> DataFrame:
    """A bit set of fixed size that holds at least the ids, as rows (_w, _bits)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(col).bitwiseAND(63).cast("int"))
    return ids.groupBy(_filter_word(col).alias("_w")).agg(F.bit_or(bit).alias("_bits"))


def with_filter(df: DataFrame, words: DataFrame, col: str) -> DataFrame:
    """``df`` with ``_may``: False where ``col`` is surely none of the filter's ids.

    Lets rows that no join needs pass by without a shuffle; a full filter costs
    only that saving.
    """
    hit = F.coalesce(F.getbit("_bits", F.xxhash64(col).bitwiseAND(63)) == 1, F.lit(False))
    return df.withColumn("_w", _filter_word(col)).join(F.broadcast(words), "_w", "left").withColumn("_may", hit).drop("_w", "_bits")
