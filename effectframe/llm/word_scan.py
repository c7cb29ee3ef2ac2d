"""Words of many texts at once, as whole-array steps over their bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 4 << 20


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


@dataclass(frozen=True)
class Words:
    """Words in text order: number of the distinct word, first byte, byte behind; and the distinct words themselves."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    names: pa.BinaryArray


def scan(data: np.ndarray, gap: np.ndarray) -> Words:
    """Runs of bytes outside ``gap``. Equal words get equal numbers; the comparison is exact."""
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(before & ~inside)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    kept = data[inside]
    # Words lie end to end in ``kept``, so one offset per word makes them an Arrow array.
    place = np.cumsum(inside)[starts] - 1 if len(starts) else starts
    offsets = np.append(place, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), starts, ends, coded.dictionary)


def chunked(rows: Iterable[tuple[str, bytes]], chunk: int = CHUNK, hold: int = 8 * CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """(group, texts of it) with at least ``chunk`` bytes each but for the last ones; at most ``hold`` bytes and one text are held."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for group, text in rows:
        held.setdefault(group, []).append(text)
        sizes[group] = sizes.get(group, 0) + len(text) + 1
        total += len(text) + 1
        if sizes[group] >= chunk:
            yield group, held.pop(group)
            total -= sizes.pop(group)
        elif total >= hold:
            yield from held.items()
            held, sizes, total = {}, {}, 0
    yield from held.items()


def grouped_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(group, UTF-8 text) of batches whose columns are group and text, null texts empty."""
    for batch in batches:
        groups = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary())
        for i, group in enumerate(groups):
            yield group, texts[i].as_py() or b""
