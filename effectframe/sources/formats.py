"""Formats by name: ``spark.read.format("fasta" | "gaf" | "bgzf")`` and ``df.write.format("bgzf")``.

    formats.register(spark)
    spark.read.format("gaf").schema("symbol string, term string").load("annotation.gaf.gz")

A file is dealt to tasks by byte range (option ``range_bytes``), block-compressed files included; a plain gzip file is
one task. Only the columns of the given schema are made.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from effectframe.sources import files

RANGE_BYTES = 32 << 20
#: Text characters in one Arrow batch, and rows at most.
BATCH_CHARS, BATCH_ROWS = 4 << 20, 10_000

#: Columns of a gene annotation file in their order; fixed by that format.
GAF_COLUMNS = (
    "db", "object_id", "symbol", "qualifier", "term", "reference", "evidence", "with_from", "aspect",
    "name", "synonym", "type", "taxon", "date", "assigned_by", "extension", "form",
)
GAF_LEAST = 13


def _text_columns(names: Iterable[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as Arrow batches, each bounded by its text; one very long row is a batch alone."""
    schema = pa.schema([(n, pa.string()) for n in names])
    held: list[tuple] = []
    chars = 0
    for row in rows:
        size = sum(len(v) for v in row if v is not None)
        if held and (chars + size > BATCH_CHARS or len(held) >= BATCH_ROWS):
            yield _batch(held, schema)
            held, chars = [], 0
        held.append(row)
        chars += size
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(schema))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _RangeReader(DataSourceReader):
    def __init__(self, source: TextFormat, schema: StructType):
        self.names = [f.name for f in schema.fields]
        unknown = [n for n in self.names if n not in source.columns]
        if unknown or any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError(f"{source.name()} has the text columns {', '.join(source.columns)}")
        if "path" not in source.options:
            raise ValueError(f"{source.name()} needs a path")
        self.path, self.rows = source.options["path"], source.rows
        self.step = int(source.options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[files.ByteRange]:
        # A table without files is one empty range.
        return files.byte_ranges(self.path, self.step) or [files.ByteRange("", 0, 0, "none")]

    def read(self, partition: files.ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.kind != "none":
            yield from batches(self.rows(partition, self.names), self.names)


class TextFormat(DataSource):
    """A format whose columns are all texts; ``rows`` makes the rows that a byte range owns."""

    columns: tuple[str, ...] = ()

    def schema(self) -> StructType:
        return _text_columns(self.columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(self, schema)

    @staticmethod
    def rows(part: files.ByteRange, names: list[str]) -> Iterator[tuple]:
        raise NotImplementedError


class GeneAnnotation(TextFormat):
    """Annotation lines; comments and lines with fewer than 13 fields are no rows, absent last fields are null."""

    columns = GAF_COLUMNS

    @classmethod
    def name(cls) -> str:
        return "gaf"

    @staticmethod
    def rows(part: files.ByteRange, names: list[str]) -> Iterator[tuple]:
        places = [GAF_COLUMNS.index(n) for n in names]
        for line in files.own_lines(part):
            fields = line.split("\t")
            if not line.startswith("!") and len(fields) >= GAF_LEAST:
                yield tuple(fields[i] if i < len(fields) else None for i in places)


class Fasta(TextFormat):
    """Sequence records; a record belongs to the range of its header and is one row, so no format for whole genomes.

    White space inside sequences goes, records without an id and lines before the first header are no rows.
    """

    columns = ("id", "description", "seq")

    @classmethod
    def name(cls) -> str:
        return "fasta"

    @staticmethod
    def rows(part: files.ByteRange, names: list[str]) -> Iterator[tuple]:
        keep = "seq" in names
        head: bytes | None = None
        body: list[bytes] = []
        for line, own in files.marked_lines(files.text_pieces(part), part.start == 0):
            if line.startswith(b">"):
                if head is not None:
                    yield from _record(head, body, names)
                head, body = line, []
                if not own:
                    return
            elif head is None:
                if not own:
                    return
            elif keep:
                body.append(b"".join(line.split()))
        if head is not None:
            yield from _record(head, body, names)


def _record(head: bytes, body: list[bytes], names: list[str]) -> Iterator[tuple]:
    text = head[1:].decode("utf-8", "replace").rstrip()
    if not text or text[0].isspace():
        return
    name, *rest = text.split(None, 1)
    made = {"id": name, "description": "".join(rest), "seq": b"".join(body).decode("utf-8", "replace")}
    yield tuple(made[n] for n in names)


class Blocks(TextFormat):
    """Lines of block-compressed text, of plain text and of gzip; written as block-compressed files."""

    columns = ("value",)

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    @staticmethod
    def rows(part: files.ByteRange, names: list[str]) -> Iterator[tuple]:
        return ((line,) * len(names) for line in files.own_lines(part))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, StringType):
            raise ValueError("bgzf writes one text column")
        return _BlockWriter(self.options["path"], overwrite, self.options.get("header"))


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _BlockWriter(DataSourceWriter):
    """Every attempt writes a file of its own in a hidden folder; the winners are moved when all are there.

    With the option ``header`` every file begins with that line.
    """

    def __init__(self, path: str, overwrite: bool, header: str | None = None):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.header = [] if header is None else [header]

    @property
    def hidden(self) -> str:
        return f"{self.path}/_attempts-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, place = files.locate(self.hidden)
        store.create_dir(place, recursive=True)
        name = f"part-{uuid.uuid4().hex}.gz"
        with store.open_output_stream(f"{place}/{name}", compression=None) as out:
            # A null is an empty line.
            files.write_blocks(out, chain(self.header, (row[0] or "" for row in iterator)))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, place = files.locate(self.path)
        store.create_dir(place, recursive=True)
        before = store.get_file_info(fs.FileSelector(place)) if self.overwrite else []
        hidden = files.locate(self.hidden)[1]
        for message in messages:
            if message is not None:
                store.move(f"{hidden}/{message.name}", f"{place}/{message.name}")
        for info in before:
            if info.is_file:
                store.delete_file(info.path)
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, hidden = files.locate(self.hidden)
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session; again does no harm."""
    for source in (GeneAnnotation, Fasta, Blocks):
        spark.dataSource.register(source)
