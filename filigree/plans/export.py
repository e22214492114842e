"""Sinks: JSON, JSON lines, CSV, terminal table, Arrow, Parquet, the six kinds of exports, and a table of documents.

All writes are distributed. Arrow goes to a folder of IPC files, one a task; a
JSON array, which is one file by its nature, is written by tasks in parts and
put together at the commit as a stream of bytes. Both stage their parts, so that
lost attempts leave nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from filigree.functions.scalars import safe_path_part, truncate_utf8
from filigree.plans.metrics import financial_metrics
from filigree.plans.scores import health_scores
from filigree.plans.statements import facts, financial_statements, stitched_statements
from filigree.sources.filings import filings
from filigree.sources.landed import filesystem


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text; nested ones as JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.select(*[(F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def to_json(df: DataFrame, pretty: bool = False, limit: int | None = None) -> str:
    """A JSON array of all records, or of ``limit``, for results that a person reads; ``write`` is for large ones."""
    rows = [json.loads(r[0]) for r in (df if limit is None else df.limit(limit)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)


def to_table(df: DataFrame, rows: int = 20, width: int = 80) -> str:
    return df._jdf.showString(rows, width, False)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    """Record batches as IPC files in a folder, or as one JSON array (of the column ``json``)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"].rstrip("/"), options["kind"]
        self.separator = options.get("separator", ", ").encode()
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, staging = filesystem(self.staging)
        fs.create_dir(staging, recursive=True)
        path, rows, sink = f"{staging}/{uuid.uuid4().hex}", 0, None
        with fs.open_output_stream(path) as f:
            for b in iterator:
                if self.kind == "arrow":
                    sink = sink or pa.ipc.new_file(f, b.schema)
                    sink.write_batch(b)
                else:
                    text = self.separator.join(x.as_py().encode() for x in b.column(0))
                    f.write((self.separator if rows and text else b"") + text)
                rows += b.num_rows
            if sink:
                sink.close()
        return Part(path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, staging = filesystem(self.staging)
        target = filesystem(self.path)[1]
        parts = [m.path for m in messages if m is not None and m.rows]
        if self.kind == "arrow":
            fs.create_dir(target, recursive=True)
            for i, part in enumerate(parts):
                fs.move(part, f"{target}/part-{i:05d}.arrow")
        else:
            fs.create_dir(staging, recursive=True)
            with fs.open_output_stream(f"{staging}/whole") as out:
                out.write(b"[")
                for i, part in enumerate(parts):
                    out.write(self.separator if i else b"")
                    with fs.open_input_stream(part) as f:
                        while chunk := f.read(1 << 20):
                            out.write(chunk)
                out.write(b"]")
            fs.move(f"{staging}/whole", target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, staging = filesystem(self.staging)
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


class FilePartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options)


def _parts(df: DataFrame, path: str, **options: str) -> None:
    df.sparkSession.dataSource.register(FilePartsSource)
    df.write.format("file_parts").options(**options).mode("append").save(path)


def write(df: DataFrame, path: str, kind: str = "parquet", strings: bool = False) -> None:
    """A distributed write: parquet, jsonl, csv, arrow (a folder of IPC files), json or pretty (one file with an array)."""
    out = as_strings(df) if strings or kind == "csv" else df
    if kind == "parquet":
        out.write.parquet(path)
    elif kind == "jsonl":
        out.write.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        out.write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    elif kind == "arrow":
        _parts(out, path, kind="arrow")
    elif kind in ("json", "pretty"):
        options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if kind == "pretty" else {})
        _parts(out.select(F.to_json(F.struct("*"), options).alias("json")), path, kind="json", separator=",\n" if kind == "pretty" else ", ")
    else:
        raise ValueError(f"unknown format {kind!r}")


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of IPC files, a file at a time."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                f = pa.ipc.open_file(pa.py_buffer(raw.as_py()))
                yield from (f.get_batch(i) for i in range(f.num_record_batches))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content").mapInArrow(run, schema)


#: What each kind of export holds.
KINDS: dict[str, Callable[..., DataFrame]] = {"filings": filings, "facts": facts, "statements": financial_statements, "stitch": stitched_statements, "metrics": financial_metrics, "scores": health_scores}


def export(kind: str, source: DataFrame, path: str, fmt: str = "parquet", **query) -> int:
    """Writes one kind of records of all companies, every column as text, and tells how many; facts need a concept."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "facts" and not query.get("concept"):
        raise ValueError("facts need a concept")
    if fmt not in ("parquet", "arrow"):
        raise ValueError(f"unknown format {fmt!r}")
    seen = Observation()
    write(as_strings(KINDS[kind](source, **query)).observe(seen, F.count(F.lit(1)).alias("n")), path, fmt)
    return seen.get["n"]


#: Folders of the table of documents.
BUCKETS = 64


def archive(docs: DataFrame, root: str, limit_bytes: int | None = None) -> DataFrame:
    """Writes documents (accession, pos, sequence, filename, content) as parquet, in a fixed number of buckets by accession; returns the manifest.

    One row a document, under a safe name; the manifest has one row a filing. ``filigree.plans.archive`` writes files instead.
    """
    name = F.concat(F.format_string("%03d-", F.col("pos") + 1), safe_path_part(F.coalesce("sequence", F.lit("0"))), F.lit("-"), safe_path_part(F.col("filename")))
    rows = docs.withColumn("stored_name", name).withColumn("stored", truncate_utf8(F.col("content"), limit_bytes)).withColumn("folder", safe_path_part(F.col("accession"))).withColumn("bucket", F.pmod(F.xxhash64("accession"), F.lit(BUCKETS)))
    rows.select("bucket", "folder", "stored_name", "document_type", "stored").repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/documents")
    manifest = rows.groupBy("accession").agg(F.count("*").alias("documents"), F.sum(F.octet_length("stored")).alias("bytes"), F.array_sort(F.collect_list(F.struct("stored_name", "document_type"))).alias("files"))
    manifest.write.json(f"{root}/manifest")
    return manifest
