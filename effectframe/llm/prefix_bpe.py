"""Byte-level BPE by dynamic programming over prefixes.

An encoding is right exactly if every two neighbouring tokens are what merging gives
for the bytes of the two alone. So each prefix of a piece has one last token: the only
token that ends there, stands by itself under merging and is compatible with the last
token of the prefix before it. Keeping that token per prefix makes an append continue
where the text ended, an edit keep every prefix before it, and a word that starts like
another one keep what they share. Walking back from the end gives the encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.llm.give_back import at_end, release
from effectframe.llm.vocab import blocks, merge, read_ranks, split, split_all

#: Entries a task remembers at most: pieces (and those of one chunk), twice, and pairs of tokens. Nothing is kept when it ends.
PIECES = 100_000
PAIRS = 200_000
_NEVER = 1 << 62
#: Characters of texts encoded at a time; a longer text is encoded alone. Arrays of a chunk take some 20 times its bytes.
CHUNK = 1 << 20


class PrefixEncoder:
    """Encodes pieces of bytes; ``ranks`` maps token bytes to ids, which are merge ranks as well."""

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks = ranks
        self._bytes = {i: t for t, i in ranks.items()}
        #: A state is the longest end of a text which is the beginning of a token: its bytes, and the tokens that end there, longest first.
        self._begins = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self._number = {b"": 0}
        self._texts: list[bytes] = [b""]
        self._found: list[list[tuple[int, int]]] = [[]]
        self._next: dict[int, int] = {}
        # The piece encoded last, the last tokens of its prefixes and their states, that of nothing first.
        self._before, self._last, self._at = b"", [], [0]
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._steps: dict[int, tuple[list, list]] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        return merge(data, lambda a, b: self._ranks.get(a + b))

    def _stands(self, token: int) -> bool:
        """Whether merging leaves the token's bytes as this one token."""
        known = self._whole.get(token)
        if known is None:
            data = self._bytes[token]
            known = self._whole[token] = self._merged(data) == [data]
        return known

    def _edges(self, token: int) -> tuple[list, list]:
        """(first part, last part) while the bytes of a token merge, each with the rank of the merge that follows; the last has none."""
        known = self._steps.get(token)
        if known is None:
            data, rank = self._bytes[token], self._ranks.get
            parts = [data[i : i + 1] for i in range(len(data))]
            ranks = [rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            first, last = [], []
            while True:
                best = min((r for r in ranks if r is not None), default=_NEVER)
                first.append((parts[0], best))
                last.append((parts[-1], best))
                if best == _NEVER:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank(parts[i - 1] + parts[i])
                if i < len(ranks):
                    ranks[i] = rank(parts[i] + parts[i + 1])
            known = self._steps[token] = first, last
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses from one standing token into the next.

        Up to the first one that does, both merge as they do alone, the better rank first and the left one of equals.
        """
        on_left, on_right, rank = self._edges(left)[1], self._edges(right)[0], self._ranks.get
        i = j = 0
        x, before = on_left[0]
        y, behind = on_right[0]
        across = rank(x + y, _NEVER)
        while True:
            if across < before and across <= behind:
                return False
            if before == behind == _NEVER:
                return True
            if before <= behind:
                i += 1
                part, before = on_left[i]
                if part is not x:
                    x = part
                    across = rank(x + y, _NEVER)
            else:
                j += 1
                part, behind = on_right[j]
                if part is not y:
                    y = part
                    across = rank(x + y, _NEVER)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both standing tokens gives these two tokens."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            known = self._apart(left, right)
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        data = self._texts[state] + bytes([byte])
        while data not in self._begins:
            data = data[1:]
        to = self._number.get(data)
        if to is None:
            to = self._number[data] = len(self._texts)
            self._texts.append(data)
            ends = [(len(data) - i, self._ranks.get(data[i:])) for i in range(len(data))]
            self._found.append([(size, token) for size, token in ends if token is not None and self._stands(token)])
        self._next[state << 8 | byte] = to
        return to

    def _extend(self, data: bytes, last: list[int], at: list[int]) -> None:
        """Adds the last tokens and states of the prefixes of ``data`` that lack."""
        step, found, pairs = self._next.get, self._found, self._pairs.get
        state = at[-1]
        for end in range(len(last) + 1, len(data) + 1):
            byte = data[end - 1]
            to = step(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            for size, token in found[state]:
                if size == end:
                    break
                before = last[end - size - 1]
                fits = pairs(before << 32 | token)
                if fits or (fits is None and self._compatible(before, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            at.append(state)

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes of ``data``; ``last`` holds those already known, which stay valid."""
        last, at = list(last or ()), [0]
        for byte in data[: len(last)]:
            to = self._next.get(at[-1] << 8 | byte)
            at.append(self._step(at[-1], byte) if to is None else to)
        self._extend(data, last, at)
        return last

    def edited(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Piece and last tokens after ``data[start:stop]`` became ``new``: prefixes before it are kept."""
        changed = data[:start] + new + data[stop:]
        return changed, self.prefixes(changed, last[:start])

    def tokens(self, data: bytes, last: Sequence[int]) -> list[int]:
        """The encoding, read backwards from the last tokens."""
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self._bytes[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece, which goes on where it leaves the one before.

        A piece in the vocabulary is its own token, as in the library.
        """
        whole = self._ranks.get(piece)
        if whole is not None:
            return [whole]
        before, last, at = self._before, self._last, self._at
        shared, most = 0, min(len(before), len(piece))
        while shared < most and before[shared] == piece[shared]:
            shared += 1
        del last[shared:], at[shared + 1 :]
        self._before = piece[:shared]
        self._extend(piece, last, at)
        self._before = piece
        return self.tokens(piece, last)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


class _Pieces:
    """What distinct pieces encode to, as Arrow arrays; new ones are encoded in order, so that neighbours share prefixes.

    Once ``PIECES`` are known they become the older ones; those of them which occur again are taken over, the rest are
    forgotten when the next ``PIECES`` are known.
    """

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        #: Ids as text, each with a blank behind it; and what they decode to, where that is not the piece.
        self._ids: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._other: dict[bytes, bytes] = {}

    def _encode(self, names: list[bytes]) -> dict[bytes, bytes]:
        """Ids as text of new pieces."""
        names.sort()
        made = {}
        for name, ids in zip(names, map(self.encoder.encode, names), strict=True):
            made[name] = ("%d " * len(ids) % tuple(ids)).encode()
            data = self.encoder.decode(ids)
            if data != name:
                self._other[name] = data
        return made

    def arrays(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(tokens, ids as text, decoded bytes) of distinct pieces."""
        names = pieces.to_pylist()
        made, older = self._ids, self._older
        new = []
        for name in names:
            if name not in made:
                if name in older:
                    made[name] = older[name]
                else:
                    new.append(name)
        made.update(self._encode(new))
        ids = [made[name] for name in names]
        data = pa.array([self._other.get(name, name) for name in names], pieces.type) if self._other else pieces
        if len(made) > PIECES:
            self._ids, self._older = {}, made
            self._other = {name: other for name, other in self._other.items() if name in made}
        return np.fromiter((i.count(b" ") for i in ids), np.int64, len(ids)), pa.array(ids, pa.large_binary()), data


_LOADED: dict[str, _Pieces] = {}


def _loaded(shared, path: str) -> _Pieces:
    """The encoder of this worker process; made once per vocabulary and task."""
    if path not in _LOADED:
        _LOADED[path] = _Pieces(PrefixEncoder(shared.value))
    return _LOADED[path]


def _forget() -> None:
    _LOADED.clear()


def _taken(values: pa.Array, codes: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(offset of each entry and the end, all bytes) of ``values`` at ``codes``."""
    rows = values.take(codes)
    offsets = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, 8 * rows.offset)
    return offsets, memoryview(rows.buffers()[2] or b"")


def encode_texts(texts: list[str], pieces: _Pieces) -> tuple[list[int], list[str], list[str]]:
    """(tokens, SHA-256 of the ids, SHA-256 of what they decode to) of each text."""
    cut, bounds = split_all(texts)
    coded = cut.dictionary_encode()
    counts, ids, data = pieces.arrays(coded.dictionary)
    codes = coded.indices
    upto = np.append(0, np.cumsum(counts[codes.to_numpy(zero_copy_only=False)]))
    id_at, id_bytes = _taken(ids, codes)
    at, held = _taken(data, codes)
    found: tuple[list, list, list] = ([], [], [])
    for first, last in bounds:
        found[0].append(int(upto[last] - upto[first]))
        # Without the blank behind the last id.
        found[1].append(hashlib.sha256(id_bytes[id_at[first] : max(id_at[first], id_at[last] - 1)]).hexdigest())
        found[2].append(hashlib.sha256(held[at[first] : at[last]]).hexdigest())
    return found


def _encoded(ids: list, texts: list[str], pieces: _Pieces) -> pa.RecordBatch:
    counts, id_digests, decoded = encode_texts(texts, pieces)
    columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_batches(batches: Iterator[pa.RecordBatch], pieces: _Pieces) -> Iterator[pa.RecordBatch]:
    """Rows of ``encode_documents`` from batches of (id, text), a chunk at a time; what a chunk took is given back before the next."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for number, value in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(number.as_py())
            texts.append(value.as_py() or "")
            held += len(texts[-1]) + 1
            if held >= CHUNK:
                yield _encoded(ids, texts, pieces)
                ids, texts, held = [], [], 0
                release()
    if ids:
        yield _encoded(ids, texts, pieces)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encoded whole, and decoded again.

    ``path`` names a rank file. Digests are lower-case hex, of the decimal ids joined by
    one space and of the decoded bytes. Null texts are empty: no tokens, digests of
    nothing. Null ids and repeated rows stay; an empty table gives no rows. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode_batches(batches, _loaded(shared, path))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(at_end(run, _forget), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_tokens(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of the text, for training; ``ids_col`` must be a new name."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.udf("array<int>", useArrow=True)
    def ids(text: str | None) -> list[int]:
        encoder = _loaded(shared, path).encoder
        return [i for block in blocks(text or "") for piece in split(block) for i in encoder.encode(piece.encode("utf-8", "replace"))]

    if ids_col in docs.columns:
        raise ValueError(f"column {ids_col} exists")
    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))
