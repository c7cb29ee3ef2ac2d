"""Files opened by position inside tasks: listings, byte ranges and the lines of a range.

Formats with blocks or an index need positions, which Spark's text reader does not give. These readers open files
through Arrow's file systems: mounted folders, hdfs, s3 and gs. Files of any other store are left to the text
readers beside them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes read at once.
CHUNK = 1 << 20
#: Text bytes in one block of a block-compressed file; fixed by that format, as are magic and subfield.
BLOCK = 65280
_MAGIC, _SUBFIELD = b"\x1f\x8b\x08\x04", b"BC"

Pieces = Iterator[tuple[bytes, bool]]


@dataclass(frozen=True)
class ByteRange(InputPartition):
    """Bytes ``[start, stop)`` of a file; ``kind`` is plain, blocks or gzip."""

    path: str
    start: int
    stop: int
    kind: str


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a mounted one."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" in local:
        return fs.FileSystem.from_uri(local)
    return fs.LocalFileSystem(), os.path.abspath(local)


def open_input(path: str):
    store, place = locate(path)
    return store.open_input_file(place)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder that are neither empty nor hidden."""
    store, place = locate(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)] if info.size else []
    inside = store.get_file_info(fs.FileSelector(place))
    shown = [i for i in inside if i.is_file and i.size and i.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in shown)


def byte_ranges(path: str, step: int) -> list[ByteRange]:
    """The files of ``path`` cut every ``step`` bytes. A plain gzip file has no place to cut and stays whole."""
    if step < 1:
        raise ValueError("a range holds at least one byte")
    found = []
    for file, size in data_files(path):
        kind = kind_of(file)
        width = size if kind == "gzip" else step
        found += [ByteRange(file, a, min(a + width, size), kind) for a in range(0, size, width)]
    return found


def kind_of(path: str) -> str:
    with open_input(path) as file:
        ahead = Ahead(file)
        if block_size(ahead, 0) is not None:
            return "blocks"
        return "gzip" if ahead.take(0, 2) == _MAGIC[:2] else "plain"


class Ahead:
    """Reads of a file at any place, served from one chunk as long as they lie in it."""

    def __init__(self, file):
        self._file, self._base, self._data = file, 0, b""
        self.size = file.size()

    def take(self, at: int, n: int) -> bytes:
        n = max(min(n, self.size - at), 0)
        low = at - self._base
        if low < 0 or low + n > len(self._data):
            self._file.seek(at)
            self._base, self._data, low = at, self._file.read(max(n, CHUNK)), 0
        return self._data[low : low + n]


def block_size(ahead: Ahead, at: int) -> int | None:
    """Bytes of the compressed block at ``at``, null where none begins."""
    head = ahead.take(at, 12)
    if len(head) < 12 or head[:4] != _MAGIC:
        return None
    extra = ahead.take(at + 12, struct.unpack("<H", head[10:])[0])
    while len(extra) >= 4:
        length = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == _SUBFIELD and length == 2 and len(extra) >= 6:
            return struct.unpack("<H", extra[4:6])[0] + 1
        extra = extra[4 + length :]
    return None


def read_block(ahead: Ahead, at: int) -> tuple[bytes, int]:
    """(text, place of the next block) of the block at ``at``; a damaged or cut-off block raises."""
    size = block_size(ahead, at)
    body = ahead.take(at, size or 0)
    if size is None or len(body) < size:
        raise ValueError(f"no whole block at byte {at}")
    packed = zlib.decompressobj(wbits=31)
    try:
        text = packed.decompress(body)
    except zlib.error as error:
        raise ValueError(f"damaged block at byte {at}: {error}") from error
    if not packed.eof or packed.unused_data:
        raise ValueError(f"damaged block at byte {at}")
    return text, at + size


def first_block(ahead: Ahead, start: int, stop: int) -> int | None:
    """The first block that begins in ``[start, stop)``.

    The bytes of a header may occur inside a block as well. A place counts if the block there unpacks with its
    checksum and another block, or the end of the file, follows it.
    """
    at = start
    while at < stop:
        data = ahead.take(at, min(CHUNK, stop - at + 3))
        hit = data.find(_MAGIC)
        if hit < 0:
            at += max(len(data) - 3, 1)
            continue
        at += hit
        if at < stop and _is_block(ahead, at):
            return at
        at += 1
    return None


def _is_block(ahead: Ahead, at: int) -> bool:
    try:
        _, after = read_block(ahead, at)
    except ValueError:
        return False
    return after == ahead.size or block_size(ahead, after) is not None


def text_pieces(part: ByteRange) -> Pieces:
    """(text, own) of a range and then of what follows it, unpacked as it is asked for."""
    with open_input(part.path) as file:
        if part.kind == "gzip":
            yield from _unzipped(file)
        elif part.kind == "blocks":
            ahead = Ahead(file)
            at = 0 if part.start == 0 else first_block(ahead, part.start, part.stop)
            while at is not None and at < ahead.size:
                own = at < part.stop
                text, at = read_block(ahead, at)
                yield text, own
        else:
            file.seek(part.start)
            left = part.stop - part.start
            while left > 0 and (data := file.read(min(CHUNK, left))):
                left -= len(data)
                yield data, True
            while data := file.read(CHUNK >> 4):
                yield data, False


def _unzipped(file) -> Pieces:
    packed = zlib.decompressobj(wbits=31)
    began = False
    while data := file.read(CHUNK):
        while data:
            if packed.eof:
                packed, began = zlib.decompressobj(wbits=31), False
            began = True
            yield packed.decompress(data), True
            data = packed.unused_data
    if began and not packed.eof:
        raise ValueError("the gzip file is cut off")


def marked_lines(pieces: Pieces, first: bool) -> Iterator[tuple[bytes, bool]]:
    """(line, own) from the first line end of the own pieces on; the first range has the first line as well.

    A line belongs to the range whose text holds the line end before it, so every line has one owner wherever a
    file is cut. Lines after the own ones follow, for records of several lines; take as many as needed.
    """
    pending: list[bytes] = []
    skipping, mine = not first, True
    for data, own in pieces:
        if skipping:
            cut = data.find(b"\n") if own else -1
            if not own:
                return
            if cut < 0:
                continue
            data, skipping = data[cut + 1 :], False
        parts = data.split(b"\n")
        pending.append(parts[0])
        if len(parts) == 1:
            continue
        yield b"".join(pending), mine
        mine = own
        for line in parts[1:-1]:
            yield line, own
        pending = [parts[-1]]
    rest = b"".join(pending)
    if rest:
        yield rest, mine


def own_lines(part: ByteRange) -> Iterator[str]:
    """The lines of a range as text, without line ends."""
    for line, own in marked_lines(text_pieces(part), part.start == 0):
        if not own:
            return
        yield line.removesuffix(b"\r").decode("utf-8", "replace")


def packed_block(text: bytes, level: int = 6) -> bytes:
    """One block, stored as it is where packing gains nothing; that of no text marks the end of a file."""
    if len(text) > BLOCK:
        raise ValueError(f"a block holds at most {BLOCK} bytes")
    for strength in (level, 0):
        packer = zlib.compressobj(strength, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
        if len(body) + 26 <= 1 << 16:
            break
    head = _MAGIC + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + _SUBFIELD + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def write_blocks(out, lines: Iterator[str]) -> None:
    """Lines to an open file as blocks, closed by the empty one."""
    held = bytearray()
    for line in lines:
        held += line.encode("utf-8") + b"\n"
        while len(held) >= BLOCK:
            out.write(packed_block(bytes(held[:BLOCK])))
            del held[:BLOCK]
    if held:
        out.write(packed_block(bytes(held)))
    out.write(packed_block(b""))
