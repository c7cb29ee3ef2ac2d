"""Vocabulary files of byte-level BPE tokenizers, text splitting and plain merges.

A vocabulary is read on the driver and broadcast: its size is fixed by the file.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
_RECENT = regex.compile("[\u0530-\u1fff\u2071-\u209f\u2150-\u218f\u2c00-\U0010ffff]")
_SPLITTER: list = []
_BLOCK = 1 << 20


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters whose splits are those of the whole.

    No match goes from a visible character on to white space, so a cut before such
    white space changes nothing.
    """
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def split(text: str) -> list[str]:
    """Matches of the pattern, as the tokenizer libraries find them.

    They know the letters and digits of an older Unicode version than Python's ``regex``.
    All below U+0530 and the common punctuation are in both; texts with other characters
    are split by the library's own tables.
    """
    if not _RECENT.search(text):
        return _SPLIT.findall(text)
    if not _SPLITTER:
        from tokenizers.pre_tokenizers import ByteLevel

        _SPLITTER.append(ByteLevel(add_prefix_space=False, use_regex=True))
    return [text[a:b] for _, (a, b) in _SPLITTER[0].pre_tokenize_str(text)]


@cache
def _classes() -> np.ndarray:
    """0 for white space, 1 for letters, 2 for digits, 3 for all else, of the characters that ``_RECENT`` leaves out."""
    kinds = regex.compile(r"(\s)|(\p{L})|(\p{N})|.", regex.DOTALL)
    return np.array([(kinds.match(chr(c)).lastindex or 4) - 1 for c in range(0x2C00)], np.uint8)


def _starts(points: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern begin in texts which have one more character, of ``gaps``, behind each of them."""
    kind = _classes()[points]
    kind[gaps] = 4
    space, word, blank = kind == 0, (kind > 0) & (kind < 4), points == 32
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[gaps] = True
    # The last white space before a word is a match of its own; a blank takes the word in.
    start[1:] &= ~(word[1:] & blank[:-1])
    start[:-1] |= space[:-1] & word[1:]
    # An apostrophe that begins a match, and one of the endings behind it.
    quote = np.flatnonzero((points == 39) & start)
    a, b = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    return np.flatnonzero(start)


def split_all(texts: list[str]) -> tuple[pa.LargeBinaryArray, list[tuple[int, int]]]:
    """Matches of the pattern in all texts, as UTF-8, and for each text its first one and the one behind its last.

    The same as ``split`` of each text, in whole-array steps. Between the texts may stand entries of no text.
    """
    plain = [i for i, text in enumerate(texts) if not _RECENT.search(text)]
    joined = "".join([f"{texts[i]}\n" for i in plain])
    data = joined.encode()
    if len(data) == len(joined):
        points = np.frombuffer(data, np.uint8)
        behind = None
    else:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        behind = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800)))
    gaps = np.cumsum(np.fromiter((len(texts[i]) + 1 for i in plain), np.int64, len(plain))) - 1
    places = np.append(_starts(points, gaps) if len(points) else gaps, len(points))
    offsets = places if behind is None else behind[places]
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    ends = np.searchsorted(places, gaps).tolist()
    bounds = dict(zip(plain, zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=False), strict=True))
    if len(plain) < len(texts):
        others, at = [], len(cut)
        for i, text in enumerate(texts):
            if i not in bounds:
                others += [piece.encode("utf-8", "replace") for block in blocks(text) for piece in split(block)]
                bounds[i] = at, len(cut) + len(others)
                at = bounds[i][1]
        cut = pa.concat_arrays([cut, pa.array(others, pa.large_binary())])
    return cut, [bounds[i] for i in range(len(texts))]


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: visible Latin-1 characters are themselves,
    the others follow from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def read_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[bytes], list[str]]:
    """(merge ranks, vocabulary, added special strings) of a tokenizer in JSON."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols = byte_symbols()
    raw = lambda s: bytes(symbols[c] for c in s)
    merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
    return merges, [raw(s) for s in spec["model"]["vocab"]], [t["content"] for t in spec["added_tokens"]]


def merge(piece: bytes, rank) -> list[bytes]:
    """Tokens of ``piece``: the best-ranked pair is merged, leftmost first, until none has a rank.

    ``rank(a, b)`` is the rank of a pair or None. A heap with links keeps long pieces
    at n log n.
    """
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    if n < 2:
        return parts
    if n <= 24:
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = rank(parts[i], parts[i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if left >= 0 and right < n and (r := rank(parts[left], parts[right])) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return [p for p in parts if p is not None]
