"""Deterministic sharded WARC archives: written, committed and read back.

Pages are ranged by id into shards of about equal payload, whatever the layout of the
input; a shard is sorted, and its files roll when they have reached a compressed size.
Every record is a gzip member of its own with headers and digests made anew. A task
writes under a name of its own attempt; a second step renames the files of the attempts
which won, and a manifest names them with their size and digest. Readers go by the
manifest alone, so what a lost or repeated task left behind is never read.

Folders are addresses which both Spark and ``pyarrow.fs`` open (file, hdfs, s3, ...).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.cells import with_cells

SHARD_BYTES = 64 << 20
FILE_BYTES = 16 << 20
LEAST_SHARED = 100
DATE = "2026-01-01T00:00:00Z"
LEVEL = 5
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _folder(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in address and address.startswith("file:"):
        address = address.removeprefix("file:")
    return pafs.FileSystem.from_uri(address)


def _uri(url: str | None) -> str:
    """A target address without blanks or controls; a missing one is about:blank."""
    kept = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in (url or "").encode("utf-8", "replace"))
    return kept or "about:blank"


def record_id(page: int | None, digest: str, copy: int = 0) -> str:
    """The same for the same page in every run; pages without an id are told apart by content."""
    return f"<urn:page:{page}>" if page is not None else f"<urn:page-content:{digest}:{copy}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """One record, compressed. A revisit holds the HTTP header, with the payload's length, and no payload."""
    http = _HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def _members(source) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = source.read(1 << 18)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; digests and lengths are checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest differs")
    return {
        "page_id": _page_of(headers["WARC-Record-ID"]),
        "url": headers["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(headers.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


_MANIFEST = "shard int, file int, temporary string, name string, records long, bytes long, sha256 string"


def _writer(folder: str):
    """One partition, sorted by shard: files under names of this attempt, and their manifest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        attempt = uuid.uuid4().hex
        state: dict = {"shard": None, "file": 0, "out": None}
        done: list[dict] = []

        def close() -> None:
            if state["out"] is None:
                return
            state["out"].close()
            shard, number = state["shard"], state["file"]
            done.append(
                {
                    "shard": shard,
                    "file": number,
                    "temporary": state["temporary"],
                    "name": f"part-{shard:08d}-{number:05d}.warc.gz",
                    "records": state["records"],
                    "bytes": state["bytes"],
                    "sha256": state["sha"].hexdigest(),
                }
            )
            state.update(out=None, file=number + 1)

        copies: dict[str, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != state["shard"]:
                    close()
                    state.update(shard=row["shard"], file=0)
                    copies = {}
                if state["out"] is None:
                    name = f"{root}/_temporary/{attempt}-{row['shard']:08d}-{state['file']:05d}"
                    state.update(out=fs.open_output_stream(name, compression=None), temporary=name, records=0, bytes=0, sha=hashlib.sha256())
                copy = 0
                if row["page_id"] is None:
                    copy = copies[row["digest"]] = copies.get(row["digest"], -1) + 1
                data = make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], copy)
                state["out"].write(data)
                state["sha"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def _committer(folder: str):
    """Renames the winning files; running it again changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{root}/{row['name']}"
                if fs.get_file_info(final).type == pafs.FileType.NotFound:
                    fs.move(row["temporary"], final)
            yield batch

    return run


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Writes ``pages`` below the new folder ``folder``; returns the manifest, stored there as ``_manifest``.

    Of records with equal payloads of at least ``LEAST_SHARED`` bytes, that with the least
    id is the response, and rows repeated under this id as well; all others revisit it.
    Smaller ones are responses. A null payload is empty. Rows without an id revisit the
    least id of their payload if there is one, else they are responses. Order in a
    shard: id, then digest. An empty table gives a manifest without rows. Runs jobs.
    """
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    size = F.octet_length("payload").cast("long")
    celled = with_cells(rows, "page_id", size + F.lit(512), shard_bytes, "cell", F.col("digest"))
    # Negative cells hold rows without an id; they come as odd shards, all others as even ones.
    shard = F.when(F.col("cell") >= 0, F.col("cell") * 2).otherwise(-2 * F.col("cell") - 1).cast("int")
    placed = celled.withColumn("shard", shard).drop("cell")
    small = placed.filter(size >= LEAST_SHARED)
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    where = small.select("shard", "digest").distinct().join(first.select("digest", "first"), "digest")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both go to the shards in one shuffle; a window over a shard's equal payloads finds them in place.
    told = where.withColumns({"page_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    met = placed.withColumn("first", F.lit(None).cast("long")).unionByName(told).repartition(n, "shard")
    known = F.max("first").over(W.partitionBy("shard", "digest"))
    joined = met.withColumn("first", known).filter(F.col("payload").isNotNull())
    refers = F.when((size >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("shard", "page_id", "url", "payload", "digest", refers.alias("refers_to"))
    ready = ready.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "url")
    fs, root = _folder(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    written = ready.mapInArrow(_writer(folder), _MANIFEST)
    written.write.parquet(f"{folder}/_written")
    spark = pages.sparkSession
    renamed = spark.read.parquet(f"{folder}/_written").mapInArrow(_committer(folder), _MANIFEST)
    renamed.drop("temporary").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of a committed archive, one task per few files: what the headers say, checked against the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    held = []
                    for data in _members(source):
                        record = parse_record(data)
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=kinds)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)

    text = pa.string()
    kinds = pa.schema([("page_id", pa.int64()), ("url", text), ("payload_bytes", pa.int64()), ("payload_digest", text), ("record_type", text), ("refers_to", pa.int64()), ("payload", pa.binary())])
    names = spark.read.parquet(f"{folder}/_manifest").select("name", "bytes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(n, "name").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
