"""Removing repeated byte strings, found with suffix arrays over shards of pieces.

Every window of ``length`` bytes is anchored at the least hash among its grams of
``GRAM`` bytes. Windows with one anchor overlap; together they are a *piece* of less
than ``2 * length`` bytes. Equal windows have equal anchors, whatever document they stand
in. First the anchors alone are dealt to shards, which tell each range of documents
those that stand in more than one document; all other pieces can not repeat and stay
where they are. The pieces left meet in the shard of their anchor, once per range, with
the least document id: copies are folded before they are moved, and a passage which a
third of all documents share costs one entry per range. There, pieces alone under
their anchor, or with the bytes around it, have nothing to be compared with; the others form one text, whose suffix
array (induced sorting) and permuted common prefixes give the classes of equal windows
and the least document of each. The answers go back to the ranges, which remove the
windows seen in a smaller document.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.llm.cells import with_cells
from effectframe.llm.give_back import after_group, after_groups, at_end
from effectframe.llm.induced_sort import permuted_common_prefixes, suffix_array

LENGTH = 50
#: Bytes of an anchor, a multiple of 8: a longer one is shared by chance less often, and means more pieces.
GRAM = 16
#: Bytes of text per range of documents, and per step inside a task.
CELL_BYTES = 6 << 20
_STEP = 1 << 17
_FLUSH = 8 << 20
#: Bits for a place inside a step and a window behind it; the rest of 64 are those of a hash.
_PLACE_BITS = 18
#: Ranges of windows, by their place around the anchor, of which pieces must share what all windows of a range hold.
_RANGES = 4
#: Shards per shuffle partition; a shard is held in memory.
SHARDS = 3
NO_ID = (1 << 63) - 1


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, lowest first (the last seven positions lack some)."""
    g = np.zeros(len(data) + 8, np.uint64)
    g[: len(data)] = data
    for shift in (1, 2, 4):
        g[:-shift] |= g[shift:] << np.uint64(8 * shift)
    return g[: len(data)]


def _gram_hash(words: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """46-bit hash of grams given as eight-byte words in order; two grams with one hash count as one anchor everywhere."""
    h = np.zeros(len(words[0]), np.uint64)
    for word in words:
        h ^= word
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(_PLACE_BITS)


def _anchor_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the gram at each position of a text; the last ones lack bytes and count as padded."""
    padded = np.append(words, np.zeros(GRAM, np.uint64))
    return _gram_hash([padded[at : at + len(words)] for at in range(0, GRAM, 8)])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def cut_pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, text number, start in buffer, start in text, size, anchor offset) of all pieces, step by step.

    Pieces depend on their text alone, not on what else is in ``texts``.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, _STEP):
            part = text[at : at + _STEP + length - 1]
            parts.append((number, at, part))
            held += len(part)
            if held >= _STEP:
                yield _cut(parts, length)
                parts, held = [], 0
    if parts:
        yield _cut(parts, length)


def _cut(parts: list[tuple[int, int, bytes]], length: int):
    buffer = b"".join(p for _, _, p in parts)
    sizes = np.fromiter((len(p) for _, _, p in parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(buffer, np.uint8)
    local = np.arange(len(data)) - np.repeat(begins, sizes)
    # Ties go to the position, so equal windows have their anchor at one place; that never moves an anchor to another hash.
    order = (_anchor_hash(_words(data)) << np.uint64(_PLACE_BITS)) | local.astype(np.uint64)
    least = _sliding_min(order[: len(data) - GRAM + 1], length - GRAM + 1)
    windows = len(least)
    start = np.arange(windows)
    anchor = start + (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) - local[:windows]
    owner = np.repeat(np.arange(len(parts)), sizes)[:windows]
    valid = start + length <= (begins + sizes)[owner]
    anchor[~valid] = -1
    change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    stop = np.append(change[1:], windows)
    keep = valid[change]
    change, stop = change[keep], stop[keep]
    owner = owner[change]
    numbers = np.fromiter((n for n, _, _ in parts), np.int64, len(parts))
    offsets = np.fromiter((at for _, at, _ in parts), np.int64, len(parts))
    inside = change - begins[owner] + offsets[owner]
    return buffer, numbers[owner], change, inside, stop - change + length - 1, anchor[change] - change


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, count: int, kinds: list[str]) -> list[np.ndarray]:
    """Arrays of ``count`` entries of the given kinds, and the bytes after them."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * count
        out.append(np.frombuffer(body, kind, count, at))
        at += size
    return [*out, np.frombuffer(body, np.uint8, len(body) - at, at)]


_BLOBS = pa.schema([("shard", pa.int32()), ("count", pa.int32()), ("blob", pa.binary())])


def _planes(values: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, so that empty bytes compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T


def _unplaned(planes: np.ndarray, count: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes[: 8 * count].reshape(8, count).T).view(kind).ravel()


def _deltas(values: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, byte by byte."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _undeltas(planes: np.ndarray, count: int) -> np.ndarray:
    return np.cumsum(_unplaned(planes, count, np.uint64))


def _anchor_blobs(length: int, shards: int):
    """Map side, from rows (cell, id, text): distinct anchors per cell, by shard, marked where two documents have them."""

    def flush(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        cells = np.array([r[0] for r in rows], np.int64)
        parts = []
        for buffer, number, start, _, _, offset in cut_pieces([r[2] for r in rows], length):
            parts.append((number, _anchor_hash(_words(np.frombuffer(buffer, np.uint8)))[start + offset]))
        number, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        cell = cells[number]
        order = np.argsort(anchor, kind="stable")
        cell, anchor, number = cell[order], anchor[order], number[order]
        # Few anchors stand in several rows here; only those are ordered by cell as well.
        same = anchor[1:] == anchor[:-1]
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        by = tied[np.lexsort((number[tied], cell[tied], anchor[tied]))]
        cell[tied], number[tied] = cell[by], number[by]
        head = np.flatnonzero(np.r_[True, ~same | (cell[1:] != cell[:-1])])
        many = number[head] < number[np.append(head[1:], len(number)) - 1]
        cell, anchor = cell[head], anchor[head]
        shard = (anchor % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        out: dict[str, list] = {"shard": [], "count": [], "blob": []}
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            out["shard"].append(int(shard[part[0]]))
            out["count"].append(len(part))
            out["blob"].append(_pack(many[part].view(np.uint8), _deltas(anchor[part]), _planes(cell[part])))
        yield pa.RecordBatch.from_pydict(out, schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        held = 0
        for batch in batches:
            for cell, doc, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                if len(data) < length:
                    continue
                rows.append((cell.as_py(), doc.as_py(), data))
                held += len(data)
                if held >= _FLUSH:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)

    return run


_PER_CELL = pa.schema([("cell", pa.int64()), ("count", pa.int32()), ("blob", pa.binary())])


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """Shard side: for each range of documents, its anchors that stand in more than one document."""
    marks, anchors, cells = [], [], []
    for count, blob in zip(table.column("count").to_pylist(), table.column("blob").to_pylist(), strict=True):
        mark, planes = _unpack(blob, count, ["u1"])
        marks.append(mark)
        anchors.append(_undeltas(planes, count))
        cells.append(_unplaned(planes[8 * count :], count, np.int64))
    many, anchor, cell = (np.concatenate(x) for x in (marks, anchors, cells))
    order = np.argsort(anchor, kind="stable")
    head = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    size = np.diff(np.append(head, len(order)))
    repeated = (size > 1) | (np.maximum.reduceat(many[order], head) > 0)
    order = order[np.repeat(repeated, size)]
    order = order[np.lexsort((anchor[order], cell[order]))]
    out: dict[str, list] = {"cell": [], "count": [], "blob": []}
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if len(part):
            found = np.unique(anchor[part])
            out["cell"].append(int(cell[part[0]]))
            out["count"].append(len(found))
            out["blob"].append(_pack(_deltas(found)))
    return pa.Table.from_pydict(out, schema=_PER_CELL)


def _piece_blobs(length: int, shards: int):
    """Range side: folded pieces of a cell under repeated anchors, by shard. Columns of the documents: cell, id, text."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "count": [], "blob": []}
        lists = [_undeltas(_unpack(b, n, [])[0], n) for n, b in zip(told.column("count").to_pylist(), told.column("blob").to_pylist(), strict=True)]
        if not lists:
            return pa.Table.from_pydict(out, schema=_BLOBS)
        repeated = np.unique(np.concatenate(lists))
        cell = docs.column(0)[0].as_py()
        ids = docs.column(1).to_numpy()
        rows = np.argsort(ids, kind="stable")
        texts = [(docs.column(2)[i].as_py() or "").encode("utf-8", "replace") for i in rows.tolist()]
        ids = ids[rows]
        # Equal pieces have equal anchors. Documents ascend, so the first one found is the least.
        first: dict[bytes, int] = {}
        many, docs_of = bytearray(), []
        offsets, shard_of = [], []
        for buffer, number, start, _, size, offset in cut_pieces(texts, length):
            anchor = _anchor_hash(_words(np.frombuffer(buffer, np.uint8)))[start + offset]
            known = _under(anchor, repeated)
            base = len(docs_of)
            docs_of += ids[number[known]].tolist()
            many += bytes(len(known))
            offsets.append(offset[known])
            shard_of.append(anchor[known] % np.uint64(shards))
            begin = start[known]
            for i, s, e in zip(range(base, len(docs_of)), begin.tolist(), (begin + size[known]).tolist(), strict=True):
                j = first.setdefault(buffer[s:e], i)
                if j != i and docs_of[j] != docs_of[i]:
                    many[j] = 1
        if first:
            kept = np.fromiter(first.values(), np.int64, len(first))
            pieces = list(first)
            doc, offset, shard = np.array(docs_of, np.int64)[kept], np.concatenate(offsets)[kept], np.concatenate(shard_of)[kept]
            mark = np.frombuffer(many, np.uint8)[kept]
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                held = [pieces[i] for i in part.tolist()]
                sizes = np.fromiter(map(len, held), np.int32, len(held))
                blob = _pack(doc[part], np.full(len(part), cell), sizes, offset[part].astype(np.uint8), mark[part], np.frombuffer(b"".join(held), np.uint8))
                out["shard"].append(int(shard[part[0]]))
                out["count"].append(len(part))
                out["blob"].append(blob)
        return pa.Table.from_pydict(out, schema=_BLOBS)

    return run


def comparable(pieces: list[bytes], offsets: list[int], length: int = LENGTH) -> np.ndarray:
    """Whether each of the distinct ``pieces`` may have a window of another one, given where their anchors are.

    Equal windows have their anchor at one place. The places are cut into ranges, and all windows of a range
    hold the same bytes around the anchor: pieces share those too, else they share no window of the range.
    """
    found = np.zeros(len(pieces), bool)
    places = length - GRAM + 1
    cuts = [places * k // _RANGES for k in range(_RANGES + 1)]
    for low, behind in zip(cuts, cuts[1:], strict=False):
        if low == behind:
            continue
        reach = places + GRAM - behind
        kept = [p[o - low : o + reach] if o >= low and o + reach <= len(p) else None for p, o in zip(pieces, offsets, strict=True)]
        times = Counter(kept)
        times[None] = 0
        found |= np.fromiter((times[k] > 1 for k in kept), bool, len(kept))
    return found


def least_windows(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, least) per window, piece by piece: the least of ``docs`` among the pieces that hold an equal window."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes + 1) - sizes - 1
    joined = b"\0".join(pieces) + b"\0"
    text = np.frombuffer(joined, np.uint8).astype(np.uint16) + np.uint16(2)
    text[begins + sizes] = 1
    text = np.append(text, np.uint16(0))
    order = suffix_array(text, 258)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    window = np.arange(length, len(owner) + length, dtype=np.int32) <= (begins + sizes).astype(np.int32)[owner]
    order = order[order < len(owner)]
    order = order[window[order]]
    before = np.full(len(owner), -1, np.int32)
    before[order[1:]] = order[:-1]
    common = permuted_common_prefixes(_words(np.frombuffer(joined, np.uint8)), before, length)
    first = np.flatnonzero(np.r_[True, common[order[1:]] < length])
    least = np.minimum.reduceat(docs[owner[order]], first)
    found = np.empty(len(owner), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return owner[window], found[window]


def _answer(length: int):
    """Shard side: for each range of documents, the pieces with windows seen in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        kinds = ["<i8", "<i8", "<i4", "u1", "u1"]
        blobs = zip(table.column("blob").to_pylist(), table.column("count").to_pylist(), strict=True)
        read = [_unpack(b, c, kinds) for b, c in blobs]
        doc, cell, size, offset, many, data = (np.concatenate([r[i] for r in read]) for i in range(6))
        ends = np.cumsum(size.astype(np.int64))
        starts = ends - size
        grams = data[(starts + offset)[:, None] + np.arange(GRAM)].view("<u8")
        anchor = np.zeros(len(doc), np.uint64)
        for i in range(0, len(doc), _STEP):
            words = np.ascontiguousarray(grams[i : i + _STEP])
            anchor[i : i + _STEP] = _gram_hash(words.T)
        buffer = data.tobytes()
        number: dict[bytes, int] = {}
        index = np.fromiter(
            (number.setdefault(buffer[s:e], len(number)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(doc)
        )
        pieces = list(number)
        least = np.full(len(pieces), NO_ID)
        np.minimum.at(least, index, doc)
        # Pieces alone under their anchor or with what surrounds it need no comparison; all others are sorted together.
        by_piece = np.empty(len(pieces), np.uint64)
        by_piece[index] = anchor
        _, where, under = np.unique(by_piece, return_inverse=True, return_counts=True)
        place = np.empty(len(pieces), np.int64)
        place[index] = offset
        shared = under[where] > 1
        met = np.flatnonzero(shared)
        shared[met] = comparable([pieces[i] for i in met.tolist()], place[met].tolist(), length)
        compared, alone = np.flatnonzero(shared), np.flatnonzero(~shared)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner, value = alone, least[alone]
        count = sizes[alone] - length + 1
        if len(compared):
            of, found = least_windows([pieces[i] for i in compared.tolist()], least[compared], length)
            head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (found[1:] != found[:-1])])
            owner = np.concatenate([owner, compared[of[head]]])
            value = np.concatenate([value, found[head]])
            count = np.concatenate([count, np.diff(np.append(head, len(of)))])
        by = np.argsort(owner, kind="stable")
        owner, value, count = owner[by], value[by], count[by]
        lowest = np.full(len(pieces), NO_ID)
        np.minimum.at(lowest, owner, value)
        wanted = np.flatnonzero((many > 0) | (lowest[index] < doc))
        runs = np.bincount(owner, minlength=len(pieces))
        digests = {i: xxhash.xxh3_128_digest(pieces[i]) for i in np.unique(index[wanted]).tolist()}
        out: dict[str, list] = {"cell": [], "count": [], "total": [], "blob": []}
        wanted = wanted[np.argsort(cell[wanted], kind="stable")]
        first = np.cumsum(runs) - runs
        for part in np.split(wanted, np.flatnonzero(np.diff(cell[wanted])) + 1):
            if not len(part):
                continue
            own = index[part]
            per = runs[own]
            flat = np.repeat(first[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            names = np.frombuffer(b"".join([digests[i] for i in own.tolist()]), np.uint8)
            out["cell"].append(int(cell[part[0]]))
            out["count"].append(len(part))
            out["total"].append(len(flat))
            out["blob"].append(_pack(names, by_piece[own], per.astype(np.int32), count[flat].astype(np.int32), value[flat]))
        kinds = [("cell", pa.int64()), ("count", pa.int32()), ("total", pa.int32()), ("blob", pa.binary())]
        return pa.Table.from_pydict(out, schema=pa.schema(kinds))

    return run


def _known(answers: pa.Table) -> tuple[np.ndarray, dict[bytes, list[tuple[int, int]]]]:
    """(ascending anchors, runs by digest) of what the shards told a cell."""
    known: dict[bytes, list[tuple[int, int]]] = {}
    anchors = [np.zeros(0, np.uint64)]
    for count, total, blob in zip(*(answers.column(c).to_pylist() for c in ("count", "total", "blob")), strict=True):
        body = zstandard.ZstdDecompressor().decompress(blob)
        anchors.append(np.frombuffer(body, np.uint64, count, 16 * count))
        per = np.frombuffer(body, np.int32, count, 24 * count)
        sizes = np.frombuffer(body, np.int32, total, 28 * count)
        least = np.frombuffer(body, np.int64, total, 28 * count + 4 * total)
        flat = list(zip(sizes.tolist(), least.tolist(), strict=True))
        at = 0
        for i, n in enumerate(per.tolist()):
            known[body[16 * i : 16 * i + 16]] = flat[at : at + n]
            at += n
    return np.unique(np.concatenate(anchors)), known


def _under(anchors: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Positions of those ``anchors`` which are in the ascending ``among``."""
    at = np.minimum(np.searchsorted(among, anchors), len(among) - 1)
    return np.flatnonzero(among[at] == anchors)


def _removed(texts: list[bytes], ids: list[int], answers: pa.Table, length: int) -> list[np.ndarray]:
    """Per text: a mask of the bytes to remove."""
    marks = [np.zeros(len(t) + 1, np.int32) for t in texts]
    anchors, known = _known(answers)
    if known:
        digest = xxhash.xxh3_128_digest
        for buffer, number, start, inside, size, offset in cut_pieces(texts, length):
            hashed = _anchor_hash(_words(np.frombuffer(buffer, np.uint8)))[start + offset]
            told = _under(hashed, anchors)
            spans = zip(number[told].tolist(), start[told].tolist(), inside[told].tolist(), size[told].tolist(), strict=True)
            for n, s, i, z in spans:
                runs = known.get(digest(buffer[s : s + z]))
                if runs is None:
                    continue
                at, mark = i, marks[n]
                for count, least in runs:
                    if least < ids[n]:
                        mark[at] += 1
                        mark[at + count + length - 1] -= 1
                    at += count
    return [np.cumsum(m[:-1]) > 0 for m in marks]


def _apply(length: int, text_at: int, keep_text: bool):
    """Range side: documents of a cell with what the shards found. Input columns: cell, id, the documents' own."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column(1).to_pylist()
        column = docs.column(2 + text_at)
        given = column.to_pylist()
        texts = [(t or "").encode("utf-8", "replace") for t in given]
        masks = _removed(texts, ids, answers, length)
        kept = [np.frombuffer(t, np.uint8)[~m].tobytes() for t, m in zip(texts, masks, strict=True)]
        if keep_text:
            # A span may start or end inside a character; its other bytes go too.
            new = pa.array([None if g is None else k.decode("utf-8", "ignore") for g, k in zip(given, kept, strict=True)], pa.string())
            return docs.set_column(2 + text_at, docs.schema.field(2 + text_at).name, new).select(range(2, docs.num_columns))
        spans = [int(np.count_nonzero(m[1:] & ~m[:-1]) + (len(m) > 0 and m[0])) for m in masks]
        return pa.table(
            {
                "id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    return run


def _repeats(docs: DataFrame, length: int, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS * partitions
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_at = names.index(text_col)
    key, text = f"c{names.index(id_col)}", f"c{text_at}"
    weight = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)
    celled = with_cells(plain, key, weight, CELL_BYTES, "cell", F.col(text))
    number = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id")
    at_cells = celled.select("cell", number, *plain.columns)
    mine = at_cells if keep_text else at_cells.select("cell", "id", text)
    to_pieces = at_cells.select("cell", "id", F.col(text).cast("string").alias("text"))
    anchors = to_pieces.mapInArrow(at_end(_anchor_blobs(length, shards)), "shard int, count int, blob binary")
    told = anchors.groupBy("shard").applyInArrow(after_group(_repeated_anchors), "cell long, count int, blob binary")
    place = text_at if keep_text else 0
    pieces = _piece_blobs(length, shards)

    def cut(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        return pieces(docs.select([0, 1, 2 + place]), repeated)

    # Both steps over the ranges read one exchange of the texts.
    ranges = mine.groupBy("cell")
    blobs = ranges.cogroup(told.groupBy("cell")).applyInArrow(after_groups(cut), "shard int, count int, blob binary")
    answers = blobs.groupBy("shard").applyInArrow(after_group(_answer(length)), "cell long, count int, total int, blob binary")
    schema = (
        ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names)))
        if keep_text
        else "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return ranges.cogroup(answers.groupBy("cell")).applyInArrow(after_groups(_apply(length, place, keep_text)), schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row per document.

    Removed is each byte covered by a string of ``length`` bytes (UTF-8) which also starts
    in a document with a smaller id, judged on the input; a match never crosses
    documents. A null text is empty. Rows without an id come after all others and do
    not count against each other, nor do rows repeated under one id. An empty table
    gives no rows. Runs one small job for the ranges.
    """
    return _repeats(docs, length, id_col, text_col, False)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with those bytes removed from the text; all other columns stay.

    Characters of which only some bytes are removed go whole. Null texts stay null.
    """
    return _repeats(docs, length, id_col, text_col, True).toDF(*docs.columns)
