"""Offline archive: every document as a file of its own, manifests, and a commit in two phases.

Rows (folder, name, content, and optionally head and entry as JSON) are dealt by
folder, so that one task writes a folder. A task writes below
``_staging/<job>/<attempt>`` and reports only counts. Commit, on the driver,
moves the folders of the attempts that Spark accepted to their places, streams
their ``filing.json`` into the root ``manifest.json``, which appears last and at
once, and removes the staging folder with whatever lost or killed attempts left.
So a listing of the root equals its manifest. Nothing but one document is held by
a task, nothing but one filing's record by the driver. An archive is read back by
tasks that list their own folders: the driver learns the folders' names, no file's.

Defined results: a filing archived before is replaced, plain files are added to their folder; names are made safe; a null
content is an empty file; no rows give a manifest without filings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from filigree.functions.scalars import safe_path_part, truncate_utf8
from filigree.sources.landed import filesystem

#: Moves of folders at a time.
MOVES = 16
#: Tasks that read an archive, the least folders of one, and bytes and files of a batch.
PARTITIONS, FOLDERS, BATCH, ROWS = 256, 64, 4 << 20, 1 << 12
_FILES = pa.schema([("folder", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    folders: int
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.about = json.loads(options["about"]) if "about" in options else None
        self.job = uuid.uuid4().hex

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = filesystem(self.root)
        return fs, root.rstrip("/"), f"{root.rstrip('/')}/_staging/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        fs, _, staging = self._staging()
        here = f"{staging}/{uuid.uuid4().hex}"
        fs.create_dir(here, recursive=True)
        current, record, n_folders, n_files, first = None, None, 0, 0, True

        def finish() -> None:
            if record is not None:
                record.write(b"]}")
                record.close()

        for row in iterator:
            if row.folder != current:
                finish()
                current, n_folders, first = row.folder, n_folders + 1, True
                fs.create_dir(f"{here}/{current}", recursive=True)
                if self.about is not None:
                    record = fs.open_output_stream(f"{here}/{current}/filing.json")
                    record.write(row.head.rstrip()[:-1].encode() + b', "documents": [')
            if row.name is not None:
                with fs.open_output_stream(f"{here}/{current}/{row.name}") as f:
                    f.write((row.content or "").encode())
                n_files += 1
                if record is not None:
                    record.write((b"" if first else b", ") + row.entry.encode())
                    first = False
        finish()
        return Attempt(here, n_folders, n_files)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root, staging = self._staging()
        done = [m for m in messages if m is not None]
        fs.create_dir(root, recursive=True)
        part = f"{staging}/manifest.json"
        fs.create_dir(staging, recursive=True)
        manifest = fs.open_output_stream(part) if self.about is not None else None
        if manifest:
            head = self.about | {"filing_count": sum(m.folders for m in done), "document_count": sum(m.files for m in done), "out_dir": self.root, "manifest_path": f"{self.root.rstrip('/')}/manifest.json"}
            manifest.write(json.dumps(head)[:-1].encode() + b', "filings": [')
        first = True
        for m in done:
            leaves = self._leaves(fs, m.folder)
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda leaf, of=m.folder: self._move(fs, f"{of}/{leaf}", f"{root}/{leaf}"), leaves))
            for leaf in leaves if manifest else ():
                with fs.open_input_stream(f"{root}/{leaf}/filing.json") as f:
                    manifest.write((b"" if first else b", ") + f.read())
                first = False
        if manifest:
            manifest.write(b"]}")
            manifest.close()
            fs.move(part, f"{root}/manifest.json")
        self._clear(fs, root, staging)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*self._staging())

    @staticmethod
    def _leaves(fs: pafs.FileSystem, top: str) -> list[str]:
        """Folders that hold files, relative to the top."""
        held = {x.path.rsplit("/", 1)[0] for x in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if x.type == pafs.FileType.File}
        return sorted(x[len(top) + 1 :] for x in held)

    def _move(self, fs: pafs.FileSystem, source: str, target: str) -> None:
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            if self.about is None:
                for x in fs.get_file_info(pafs.FileSelector(source)):
                    fs.move(x.path, f"{target}/{x.base_name}")
                return
            fs.delete_dir(target)
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        fs.move(source, target)

    @staticmethod
    def _clear(fs: pafs.FileSystem, root: str, staging: str) -> None:
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)
        top = f"{root}/_staging"
        if fs.get_file_info(top).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(top)):
            fs.delete_dir(top)


class FilingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def write_files(rows: DataFrame, root: str, about: dict | None = None, order: str = "name") -> None:
    """Rows (folder, name, content; with ``about`` also head and entry) as files below the root."""
    rows.sparkSession.dataSource.register(FilingFiles)
    w = rows.repartition("folder").sortWithinPartitions("folder", order).write.format("filing_files").mode("append")
    (w if about is None else w.option("about", json.dumps(about))).save(root)


def archive_filings(docs: DataFrame, root: str, primary_only: bool = False, limit_bytes: int | None = None, **about) -> DataFrame:
    """Archives documents (accession, company, form, filing_date, source_url, text_url, pos, document_type, sequence,
    filename, description, content_type, content, document_url) and returns the records of ``archived``."""
    docs = docs.where(F.col("sequence") == "1") if primary_only else docs
    text = F.coalesce("content", F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("content", truncate_utf8(F.col("_text"), limit_bytes)).withColumn("folder", safe_path_part(F.coalesce("accession", F.lit(""))))
    if primary_only:
        rows = rows.withColumn("pos", F.lit(0))
    sequence, name = (safe_path_part(F.coalesce(c, F.lit(d))) for c, d in (("sequence", "doc"), ("filename", "document.txt")))
    rows = rows.withColumn("name", F.concat(F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("pos") + 1).cast("string"))), F.lit("0")), F.lit("-"), sequence, F.lit("-"), name))
    rows = rows.withColumn("directory", F.concat(F.lit(root.rstrip("/") + "/"), "folder"))
    whole = {"ignoreNullFields": "false"}
    entry = F.to_json(F.struct(
        "document_type", "sequence", "filename", "description", "content_type", F.octet_length("_text").cast("long").alias("byte_length"), F.octet_length("content").cast("long").alias("written_bytes"), (F.octet_length("content") < F.octet_length("_text")).alias("truncated"),
        F.coalesce(F.trim("sequence") == "1", F.lit(False)).alias("is_primary"), F.concat_ws("/", "directory", "name").alias("path"), "document_url",
    ), whole)
    head = F.to_json(F.struct("accession", "company", "form", "filing_date", "source_url", "text_url", "directory"), whole)
    meta = {"cik": None, "form": None, "latest": None, "include_amends": False} | about | {"primary_only": primary_only, "limit_bytes": limit_bytes}
    write_files(rows.select("folder", "name", "content", head.alias("head"), entry.alias("entry"), "pos"), root, meta, "pos")
    return archived(docs.sparkSession, root)


_ENTRY = "document_type string, sequence string, filename string, description string, content_type string, byte_length long, written_bytes long, truncated boolean, is_primary boolean, path string, document_url string"


class Folders(InputPartition):
    """The archive's folders that one task lists and reads."""

    def __init__(self, names: list[str]):
        self.names = names


class ArchiveReader(DataSourceReader):
    """Files of an archive: the driver lists the names of folders, tasks list and read what lies in them."""

    def __init__(self, options: dict[str, str]):
        self.root, self.records, self.empty = options["path"].rstrip("/"), options["records"] == "true", options["empty"] == "true"

    def partitions(self) -> list[Folders]:
        fs, root = filesystem(self.root)
        names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory and x.base_name[0] not in "_.")
        share = max(FOLDERS, -(-len(names) // PARTITIONS))
        return [Folders(names[i : i + share]) for i in range(0, len(names), share)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.root)
        rows, size = [], 0
        for folder in partition.names:
            for x in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}")):
                wanted = x.base_name == "filing.json" if self.records else x.base_name[0].isdigit()
                if x.type != pafs.FileType.File or not wanted or not (x.size or self.empty):
                    continue
                with fs.open_input_stream(x.path) as f:
                    rows.append({"folder": folder, "name": x.base_name, "bytes": x.size, "content": f.read()})
                size += x.size
                if size >= BATCH or len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FILES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FILES)


class ArchiveFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return "folder string, name string, bytes long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def _files(spark: SparkSession, root: str, records: bool, empty: bool) -> DataFrame:
    spark.dataSource.register(ArchiveFiles)
    return spark.read.format("archive_files").option("records", str(records).lower()).option("empty", str(empty).lower()).load(root)


def archived(spark: SparkSession, root: str) -> DataFrame:
    """The records of all archived filings, one row each, read by executors from the files beside the documents."""
    schema = f"accession string, company string, form string, filing_date string, source_url string, text_url string, directory string, documents array<struct<{_ENTRY.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>"
    return _files(spark, root, True, True).select(F.from_json(F.col("content").cast("string"), schema).alias("r")).select("r.*")


def archived_files(spark: SparkSession, root: str, empty: bool = False) -> DataFrame:
    """(accession folder, name, bytes, content) of the document files that lie in the archive, empty ones only where asked for."""
    return _files(spark, root, False, empty)
