"""Which hashes occur often: counts by 40-bit hash, sent as packed sorted arrays.

A task sends its distinct hashes and their counts as gaps in byte planes, about two bytes
each, cut by the head of the hash. The receiver merges one part at a time and holds its
distinct hashes only. What is often becomes bits of a table of fixed size, so different
things may share a bit; nothing that is often is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a hash, bits of a table (8 MB), hashes a task merges before it sends them, expected hashes and greatest number of parts.
HASH_BITS = 40
TABLE_BITS = 26
HOLD = 2_000_000
PER_PART = 2_000_000
MOST_PARTS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
PACKED = "part int, n int, packed binary"


def mixed(keys: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences given as one array of 64-bit keys per place."""
    found = np.full(len(keys[0]), np.uint64(len(keys) * int(_STEP) & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for k in keys:
        found ^= k.view(np.uint64)
        found *= _STEP
        found ^= found >> np.uint64(29)
    return found * _STEP >> np.uint64(64 - HASH_BITS)


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and what each adds up to."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(hashes, prepend=np.uint64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].T.tobytes() + counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(planes, 1)


def unpack(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = HASH_BITS // 8
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(wide + 8, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :wide] = planes[:wide].T
    counts = np.ascontiguousarray(planes[wide:].T).view(np.int64).ravel()
    return np.cumsum(gaps.view(np.uint64).ravel()), counts


def parts_for(items: int) -> int:
    """A power of two that grows with the number of things counted."""
    return min(MOST_PARTS, 1 << max(0, ceil(log2(max(1, items / PER_PART)))))


def sent(arrays: Iterator[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Batches of (part, n, packed) from arrays of hashes; a task holds ``HOLD`` distinct ones and one array."""
    shift = np.uint64(HASH_BITS - parts.bit_length() + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))

    def batch(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (hashes >> shift).astype(np.int32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        cuts = [*first.tolist(), len(hashes)]
        blobs = [pack(hashes[i:j], counts[i:j]) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.diff(cuts).astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "n", "packed"])

    for hashes in arrays:
        held.append(summed(hashes, np.ones(len(hashes), np.int64)))
        size += len(held[-1][0])
        if size >= HOLD:
            held = [merged()]
            size = len(held[0][0])
            if size >= HOLD // 2:
                yield batch(*held[0])
                held, size = [], 0
    if size:
        yield batch(*merged())


def often(packed: DataFrame, least: int) -> np.ndarray:
    """Bit table of the hashes with a count of ``least`` and more. Runs a job; at most ``2 ** TABLE_BITS / 64`` words come to the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def found() -> pa.RecordBatch:
            hashes, counts = summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            at = np.unique(hashes[counts >= least] >> np.uint64(HASH_BITS - TABLE_BITS))
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else at
            return pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield found()
                    part, held, size = row["part"], [], 0
                held.append(unpack(row["packed"], row["n"]))
                size += row["n"]
                if size >= HOLD:
                    held = [summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))]
                    size = min(len(held[0][0]), HOLD // 2)
        if held:
            yield found()

    placed = packed.repartition("part").sortWithinPartitions("part")
    return bit_table(placed.mapInArrow(merge, "word long, bits long"))


def bit_table(words: DataFrame) -> np.ndarray:
    """The table of (word, bits). Runs a job."""
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def marked(table: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether the bits of the first ``TABLE_BITS`` bits of hashes are set."""
    return (table[(heads >> np.uint64(6)).astype(np.int64)] >> (heads & np.uint64(63))) & np.uint64(1) == 1
