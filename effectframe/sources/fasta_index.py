"""Windows of an uncompressed FASTA file by an offset index: only the touched bytes are read.

The index has one row per contig: where its bases begin and how long its lines are, so a place in the contig is a place
in the file. It is built by byte range; ranges are joined through at most two rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectframe.operators import windows
from effectframe.session import cut_lineage
from effectframe.sources import files
from effectframe.sources.formats import RANGE_BYTES

#: Unasked bytes between two slices that are still read along, and bytes of one read, unless one slice is longer.
GAP, RUN = 16 << 10, 4 << 20
#: Bases in one output batch, unless one slice is longer.
OUT = 16 << 20

_LEAD, _TAIL, _WHOLE = 0, 1, 2
_NUMBERS = ("offset", "lines", "bases", "line_bases", "line_width", "last_bases", "last_width")
_SEGMENT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("contig", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in _NUMBERS],
        T.StructField("even", T.BooleanType()),
        T.StructField("blank", T.BooleanType()),
    ]
)


class _Segment:
    """Lines between two headers as far as one range holds them."""

    def __init__(self, contig: str | None, offset: int):
        self.contig, self.offset = contig, offset
        self.lines = self.bases = 0
        self.first = self.last = (None, None)
        self.even, self.blank = True, False

    def add(self, line: bytes) -> None:
        bases = len(line.removesuffix(b"\r"))
        if not bases:
            self.blank = True
            return
        shape = (bases, len(line) + 1)
        if self.lines == 0:
            self.first = shape
            self.even = not self.blank
        elif self.blank or self.last != self.first:
            self.even = False
        self.lines += 1
        self.bases += bases
        self.last = shape

    def row(self, file: str, start: int, part: int) -> tuple:
        even = self.even
        if part == _WHOLE and self.lines:
            even = even and self.last[0] <= self.first[0]
        return (
            file, start, part, self.contig, self.offset, self.lines, self.bases, *self.first, *self.last,
            even, self.blank,
        )


def _segments(part: files.ByteRange) -> Iterator[tuple]:
    at = _first_line(part)
    if at is None:
        return
    here, place = _Segment(None, at), _LEAD
    for line, own in files.marked_lines(files.text_pieces(part), part.start == 0):
        if not own:
            break
        at += len(line) + 1
        if line.startswith(b">"):
            yield here.row(part.path, part.start, place if place == _LEAD else _WHOLE)
            name = line[1:].split(None, 1)
            spaced = len(line) < 2 or line[1:2].isspace()
            here, place = _Segment("" if spaced else name[0].decode("utf-8", "replace"), at), _TAIL
        else:
            here.add(line)
    yield here.row(part.path, part.start, place)


def _first_line(part: files.ByteRange) -> int | None:
    """The place of the first line that the range owns."""
    if part.start == 0:
        return 0
    at = part.start
    for data, own in files.text_pieces(part):
        if not own:
            return None
        cut = data.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(data)
    return None


def fasta_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(contig, file, offset, length, line_bases, line_width)`` of a FASTA file or folder. Runs jobs.

    All lines of a contig but its last must have one length, else ``ValueError``: ``read_reference_bins`` reads such
    files. Blank lines may end a contig. Of contigs with one name the first counts; records without a name count not.
    A compressed file has no places to go to and raises.
    """
    parts = files.byte_ranges(path, range_bytes)
    packed = sorted({p.path for p in parts if p.kind != "plain"})
    if packed:
        raise ValueError(f"an index needs plain files; compressed: {', '.join(packed[:5])}")
    rows = [(p.path, p.start, p.stop) for p in parts]
    ranges = spark.createDataFrame(rows, "path string, start long, stop long").repartition(max(len(rows), 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _in_batches(_segments(files.ByteRange(r["path"], r["start"], r["stop"], "plain")))

    segments = cut_lineage(ranges.mapInArrow(scan, _SEGMENT))
    columns = ["contig", "file", "offset", "length", "line_bases", "line_width"]
    whole = segments.filter(F.col("part") == _WHOLE).withColumn("length", F.col("bases"))
    found = whole.select(*columns, "even").unionByName(_joined(segments).select(*columns, "even"))
    named = found.filter(F.coalesce("contig", F.lit("")) != "")
    first = named.groupBy("contig").agg(F.min_by(F.struct(*columns[1:], "even"), F.struct("file", "offset")).alias("r"))
    index = cut_lineage(first.select("contig", "r.*"))
    uneven = [r[0] for r in index.filter(~F.col("even")).orderBy("contig").select("contig").limit(5).collect()]
    if uneven:
        raise ValueError(f"lines of different length in contigs {', '.join(uneven)}")
    return index.drop("even")


def _in_batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _as_batch(held)
            held = []
    if held:
        yield _as_batch(held)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}
    columns = [pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), _SEGMENT.fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=_SEGMENT.names)


def _joined(segments: DataFrame) -> DataFrame:
    """Contigs which run over range ends: the last of a range and what the following ranges begin with."""
    open_ones = segments.filter(F.col("part") != _WHOLE)
    order = W.partitionBy("file").orderBy("start", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    grouped = open_ones.withColumn("__run", F.count("contig").over(order))
    inside = W.partitionBy("file", "__run").orderBy("start", "part")
    everywhere = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    after = inside.rowsBetween(1, W.unboundedFollowing)
    seen = grouped.withColumns(
        {
            "__bases": F.first("line_bases", ignorenulls=True).over(everywhere),
            "__width": F.first("line_width", ignorenulls=True).over(everywhere),
            "__blank": F.coalesce(F.max("blank").over(before), F.lit(False)),
            "__later": F.coalesce(F.max("lines").over(after), F.lit(0)) > 0,
        }
    )
    starts = (F.col("line_bases") == F.col("__bases")) & (F.col("line_width") == F.col("__width"))
    ends = (F.col("last_bases") == F.col("__bases")) & (F.col("last_width") == F.col("__width"))
    fits = F.when(F.col("__later"), starts & ends).otherwise(
        (F.col("last_bases") <= F.col("__bases")) & (starts | (F.col("lines") == 1))
    )
    good = (F.col("lines") == 0) | (F.col("even") & ~F.col("__blank") & fits)
    return seen.groupBy("file", "__run").agg(
        F.max("contig").alias("contig"),
        F.max(F.when(F.col("contig").isNotNull(), F.col("offset"))).alias("offset"),
        F.sum("bases").alias("length"),
        F.first("__bases", ignorenulls=True).alias("line_bases"),
        F.first("__width", ignorenulls=True).alias("line_width"),
        F.bool_and(good).alias("even"),
    )


def indexed_slices(requests: DataFrame, index: DataFrame, counter: Accumulator | None = None) -> DataFrame:
    """``requests`` plus ``bases``: contig letters ``[start, stop)``, 0-based, clipped at the contig's end.

    Null where the contig is unknown, the start lies outside it, or contig, start or stop is null; empty where stop is
    not above start. Every row comes back once. Rows are placed by their bytes in the file, so that near slices are
    read together; rows of one place are dealt by the rest of the row. ``counter`` adds up the bytes read.
    """
    taken = sorted({"bases", *(c for c in requests.columns if c.startswith("__"))} & set(requests.columns))
    if taken:
        raise ValueError(f"columns have names of the result: {', '.join(taken)}")
    places = index.select("contig", *[F.col(c).alias(f"__{c}") for c in index.columns if c != "contig"])
    joined = requests.join(places, "contig", "left")
    start, last = F.col("start"), F.least(F.col("stop"), F.col("__length")) - 1

    def byte(place):
        line = F.floor(place / F.col("__line_bases")).cast("long")
        return F.col("__offset") + line * F.col("__line_width") + F.pmod(place, F.col("__line_bases"))

    inside = (start >= 0) & (start < F.col("__length")) & F.col("stop").isNotNull()
    low = F.when(inside, byte(start))
    high = F.when(inside, F.when(last >= start, byte(last) + 1).otherwise(byte(start)))
    placed = joined.select(*requests.columns, F.col("__file"), low.alias("__low"), high.alias("__high"))
    spread = F.xxhash64(*requests.columns)
    near = placed.repartitionByRange("__file", "__low", spread).sortWithinPartitions("__file", "__low")
    columns = requests.columns

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch):
                bases = _bases(part, counter)
                kept = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(bases, pa.string())], names=[*columns, "bases"])

    return near.mapInArrow(fetch, T.StructType([*requests.schema.fields, T.StructField("bases", T.StringType())]))


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lows, highs = batch.column("__low").to_pylist(), batch.column("__high").to_pylist()
    begin = size = 0
    for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
        width = 0 if low is None else high - low
        if i > begin and size + width > OUT:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += width
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _bases(batch: pa.RecordBatch, counter: Accumulator | None) -> list[str | None]:
    """The slices of rows in file order; runs of near slices are read at once."""
    asked = list(zip(*(batch.column(c).to_pylist() for c in ("__file", "__low", "__high")), strict=True))
    out: list[str | None] = []
    i = 0
    while i < len(asked):
        file, low, high = asked[i]
        if low is None:
            out.append(None)
            i += 1
            continue
        j = i + 1
        while j < len(asked) and asked[j][0] == file and asked[j][1] is not None:
            wider = max(high, asked[j][2])
            if asked[j][1] > high + GAP or wider - low > RUN:
                break
            high, j = wider, j + 1
        data = b""
        if high > low:
            with files.open_input(file) as source:
                source.seek(low)
                data = source.read(high - low)
            if counter is not None:
                counter.add(len(data))
        for _, a, b in asked[i:j]:
            out.append(data[a - low : b - low].translate(None, b"\r\n").decode("utf-8", "replace"))
        i = j
    return out


def indexed_windows(
    variants: DataFrame, index: DataFrame, window: int = 512, counter: Accumulator | None = None
) -> DataFrame:
    """``windows.variant_windows`` over an index instead of bins; the same columns and reasons.

    ``windows.rejected_variants`` takes ``known_contigs(index)`` in the place of the bins.
    """
    requests = windows.window_requests(variants, window)
    return windows.windows_of(indexed_slices(requests, index, counter), variants.columns, window)


def known_contigs(index: DataFrame) -> DataFrame:
    return index.select("contig", F.lit(0).cast("long").alias("bin"))
