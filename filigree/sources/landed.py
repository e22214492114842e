"""Batch source of landed submissions: many complete submissions, read by byte ranges.

A landing job leaves each submission as ``form=.../cik=.../<accession>.txt`` below
one root. Planning lists only the folders and files of the wanted forms, ciks and
accessions, cuts large files into ranges of ``rangeBytes`` and packs small ones
into one partition of about as many bytes. Where this gives more than ``PARTITIONS``,
neighbours share a task, so that tasks grow with the bytes and not with the number of
files; ranges that meet in a file are read as one. A range reads the documents
whose opening mark lies in it, the last one beyond its end; so a submission of a
gigabyte is read by several tasks, and none holds more than one document and a
block. ``file_offset`` orders the documents of a submission as its text does.
Wanted types, sequences and names are applied before a document's text leaves the
reader. These choices are options of the source, not filters that Spark pushes:
the planner keeps pushed filters with the loaded table, where a second query over
the same DataFrame, with other filters, would meet them.

Defined results: marks and tags are read in any case; a document left open is left
out; one that holds an opening mark itself may be cut there at a range's border;
bytes that are not UTF-8 become U+FFFD; files without the layout's folders have a
null form and cik.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filigree.sources.documents import content_type, document_of

SCHEMA = "form string, cik long, accession string, file_offset long, document_type string, sequence string, filename string, description string, content string"
_ARROW = pa.schema([("form", pa.string()), ("cik", pa.int64()), ("accession", pa.string()), ("file_offset", pa.int64()), *[(c, pa.string()) for c in ("document_type", "sequence", "filename", "description", "content")]])

#: Bytes of a range and of a partition of small files, what opening a file counts, a read, and a batch.
RANGE_BYTES, OPEN_BYTES, BLOCK, BATCH = 128 << 20, 1 << 20, 1 << 20, 4 << 20
#: Partitions above which neighbours are put together, and what opening a file counts then.
PARTITIONS, OPEN_SHARED = 256, 64 << 10
_OPEN, _CLOSE = re.compile(rb"<document>", re.I), re.compile(rb"</document>", re.I)


def landed_folder(form: Column, cik: Column) -> Column:
    """Where the submissions of a form and company land, below the root."""
    return F.concat(F.lit("form="), F.replace(F.url_encode(form), F.lit("+"), F.lit("%20")), F.lit("/cik="), cik.cast("string"))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return (pafs.LocalFileSystem(), path) if not path.startswith("file:") else (pafs.LocalFileSystem(), path[5:])


def documents_in(f, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset of the opening mark, bytes between the marks) of the documents that open in [start, end) of a file."""
    f.seek(start)
    held, at, look = bytearray(), start, 0  # at: the file's offset of held[0]; look: from where held is searched

    def more() -> bool:
        got = f.read(block)
        held.extend(got)
        return bool(got)

    while True:
        opened = _OPEN.search(held, look)
        if opened is None:
            cut = max(0, len(held) - 9)  # a mark may have begun
            if at + cut >= end:
                return
            del held[:cut]
            at, look = at + cut, 0
            if not more():
                return
            continue
        if at + opened.start() >= end:
            return
        seen = opened.end()
        while (closed := _CLOSE.search(held, seen)) is None:
            seen = max(opened.end(), len(held) - 10)
            if not more():
                return
        yield at + opened.start(), bytes(held[opened.end() : closed.start()])
        del held[: closed.end()]
        at, look = at + closed.end(), 0


@dataclass
class Ranges(InputPartition):
    """(path, form, cik, accession, start, end) of the ranges that one task reads."""

    ranges: list[tuple[str, str | None, int | None, str, int, int]]

    def __init__(self, ranges):
        self.ranges = ranges


def packed(files: Iterable[tuple], limit: int, opening: int = OPEN_BYTES) -> list[list[tuple]]:
    """Files (..., size) as lists of ranges (..., start, end) of about ``limit`` bytes each."""
    out: list[list[tuple]] = []
    held, size = [], 0
    for *key, length in files:
        for start in range(0, max(length, 1), limit):
            end = min(length, start + limit)
            if held and size + end - start + opening > limit:
                out.append(held)
                held, size = [], 0
            held.append((*key, start, end))
            size += end - start + opening
    return [*out, held] if held else out


def dealt(parts: list[list[tuple]], most: int = PARTITIONS, limit: int = RANGE_BYTES, opening: int = OPEN_SHARED) -> list[list[tuple]]:
    """At most ``most`` partitions, or as many as hold ``limit`` bytes each; ranges of a file that meet become one."""
    if len(parts) <= most:
        return parts
    size = lambda r: r[-1] - r[-2] + opening
    share = min(limit, -(-sum(size(r) for p in parts for r in p) // most))
    out: list[list[tuple]] = [[]]
    held = 0
    for r in itertools.chain.from_iterable(parts):
        if held >= share:
            out.append([])
            held = 0
        here = out[-1]
        if here and here[-1][:-2] == r[:-2] and here[-1][-1] == r[-2]:
            here[-1] = (*r[:-2], here[-1][-2], r[-1])
        else:
            here.append(r)
        held += size(r)
    return out


#: Choices that planning applies, and those that reading applies.
PLANNED, READ = ("form", "cik", "accession"), ("document_type", "sequence", "filename")


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.limit = int(options.get("rangebytes", RANGE_BYTES))
        self.allowed = {k: set(v) for k, v in json.loads(options.get("only", "{}")).items()}

    def _admits(self, name: str, value: object) -> bool:
        return name not in self.allowed or value in self.allowed[name]

    def _files(self, fs: pafs.FileSystem, folder: str, form: str | None, cik: int | None) -> Iterator[tuple]:
        for x in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
            if x.type == pafs.FileType.Directory:
                key, _, value = x.base_name.partition("=")
                if key == "form" and value:
                    if self._admits("form", unquote(value)):
                        yield from self._files(fs, x.path, unquote(value), cik)
                elif key == "cik" and value.isdigit():
                    if self._admits("cik", int(value)):
                        yield from self._files(fs, x.path, form, int(value))
            elif x.extension == "txt" and self._admits("form", form) and self._admits("cik", cik) and self._admits("accession", x.base_name[:-4]):
                yield x.path, form, cik, x.base_name[:-4], x.size

    def partitions(self) -> list[Ranges]:
        fs, folder = filesystem(self.root)
        return [Ranges(r) for r in dealt(packed(self._files(fs, folder, None, None), self.limit))] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.root)
        rows, size = [], 0
        for path, form, cik, accession, start, end in partition.ranges:
            with fs.open_input_file(path) as f:
                for offset, raw in documents_in(f, start, end):
                    doc = document_of(raw.decode("utf-8", "replace"))
                    if all(self._admits(c, doc[c]) for c in READ):
                        rows.append(doc | {"form": form, "cik": cik, "accession": accession, "file_offset": offset})
                        size += len(raw)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class LandedSubmissions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_submissions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def landed_documents(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, **only: Collection) -> DataFrame:
    """The documents of landed submissions, with ``content_type`` and ``byte_length``; ``form``, ``cik``, ``accession``,
    ``document_type``, ``sequence`` and ``filename`` take the values wanted, all where not given."""
    if unknown := set(only) - {*PLANNED, *READ}:
        raise ValueError(f"no choice by {sorted(unknown)}")
    spark.dataSource.register(LandedSubmissions)
    source = spark.read.format("landed_submissions").option("rangeBytes", str(range_bytes)).option("only", json.dumps({k: list(v) for k, v in only.items()}))
    return source.load(root).withColumn("content_type", content_type()).withColumn("byte_length", F.octet_length("content").cast("long"))


def land(submissions: DataFrame, root: str) -> None:
    """Writes submissions (form, cik, accession, text) in the layout above, each as one file."""
    from filigree.plans.archive import write_files

    write_files(submissions.select(landed_folder(F.col("form"), F.col("cik")).alias("folder"), F.concat(F.col("accession"), F.lit(".txt")).alias("name"), F.col("text").alias("content")), root)
