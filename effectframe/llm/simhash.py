"""SimHash near-duplicates found through one-wildcard segment variants.

Two 64-bit fingerprints which differ in at most ``bits`` bits are cut into
``bits // 2 + 1`` segments; were each of them off by two bits or more, the total
would exceed ``bits``, so one segment is off by at most one bit. Every segment is
indexed as it is and once per wildcard position (that bit deleted): such a pair
meets in an equal segment or in one deletion variant. Pairs that meet are verified
on the whole fingerprint.

A key under which many fingerprints meet is cut into blocks, and every pair of
blocks is a task of its own. From what meets under a key only a spanning forest of
the verified links leaves the task, never all pairs, so a group of near copies costs
as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.components import connected_components
from effectframe.llm.give_back import at_end
from effectframe.session import cut_lineage

SEED = 42
BLOCK = 4096
_CHUNK = 65_536
_SMALL = 8
#: Members of a group of candidates which one task compares, and how many of them every block of a larger group has.
GROUP = 256
SHARED = 8
#: MinHash bands and the hashes in each: texts of similarity s share a band with chance 1 - (1 - s^6)^32, 0.9999 for 0.8.
BANDS = 32
BAND_ROWS = 6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def _parts(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_set_fingerprint(text: str | None) -> int:
    """64-bit SimHash of the distinct words of ``text``; 0 without words."""
    return _majority([xxhash.xxh64_intdigest(w, SEED) for w in set(_parts(text))])


def _majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    ones = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """Distinct word shingles, joined by a space; a shorter text is one shingle."""
    parts = _parts(text)
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def text_fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words.

    A-Z are lower-cased, words are runs of anything but space and \\t to \\r, shingles
    are joined by one space and counted as often as they occur. Texts shorter than a
    shingle are one shingle. A bit is 1 if more than half of the XXH64 hashes have it.
    """
    parts = _parts(text)
    if not parts:
        return 0
    buffer = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(buffer, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :]
    total = len(ends)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=False)
        hashes = np.array([digest(buffer[s:e], SEED) for s, e in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``, the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (text_fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(at_end(run), "id long, fp long")


def _segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    count = bits // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variants(fp: str, bits: int) -> Column:
    """All index keys of a fingerprint: the variant's number above the masked segment.

    Variant numbers 0 to 63 have that bit deleted, 64 and above are whole segments.
    """
    keys = []
    for number, (first, width) in enumerate(_segments(bits)):
        value = F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(((64 + number) << 56, value))
        keys += [((first + j) << 56, value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))) for j in range(width)]
    return F.array(*[F.lit(head).bitwiseOR(value) if head else value for head, value in keys])


def _forest(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``fp``, breadth first."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rest = np.arange(len(fp))
    while len(rest):
        queue = [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= bits
            found = rest[near]
            if len(found):
                left.append(np.full(len(found), node[u]))
                right.append(node[found])
                queue.extend(found.tolist())
                rest = rest[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal ``key`` (sorted): all of them in small runs, a forest in others."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes <= _SMALL, sizes)
    number = key.astype(np.uint64) >> np.uint64(56)
    for step in range(1, _SMALL):
        i = np.flatnonzero((key[:-step] == key[step:]) & small[:-step]) if len(key) > step else np.zeros(0, np.int64)
        differ = fp[i] ^ fp[i + step]
        near = np.bitwise_count(differ) <= bits
        # Pairs equal in the deleted bit meet in the whole segment as well.
        deleted = number[i] < 64
        near &= ~deleted | ((differ >> np.minimum(number[i], np.uint64(63))) & np.uint64(1)).astype(bool)
        left.append(node[i[near]])
        right.append(node[i[near] + step])
    for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        a, b = _forest(fp[s : s + n], node[s : s + n], bits)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def link_edges(prints: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``bits`` bits.

    ``prints`` holds fingerprints ``fp`` with a distinct ``node`` id each.
    """
    keyed = prints.select(F.explode(_variants("fp", bits)).alias("key"), "fp", "node")
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block)
    blocks = F.ceil(F.coalesce("__n", F.lit(1)) / F.lit(block)).cast("int")
    met = keyed.join(hot, "key", "left").withColumn("__blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("__blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("__blocks") - 1),
        lambda other: F.least(F.col("__own"), other) * F.col("__blocks") + F.greatest(F.col("__own"), other),
    )
    dealt = met.withColumn("__own", own).select("key", F.explode(pair).alias("part"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held:
                now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0] if len(now[0]) else 0
            held = [x[last:] for x in now]
            yield from emit([x[:last] for x in now])
        if held:
            yield from emit(held)

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, fp, node = rows
        if not len(key):
            return
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        # Keys stay recognisable: the variant's number above a running group number.
        tagged = ((key.view(np.uint64) >> np.uint64(56)) << np.uint64(56)) | group.astype(np.uint64)
        a, b = _links(tagged, fp.view(np.uint64), node, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # In order of nodes: a forest starts at the least node, under every key the same.
    placed = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return placed.mapInArrow(at_end(run), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fp, component): the least id reachable by links, for every row of ``docs``.

    Texts without words have fingerprint zero and link like any other. Rows without an
    id take part with the least id of their fingerprint, and get a null component if
    there is none; repeated rows get equal answers. An empty table gives no rows.
    Runs a few jobs.
    """
    prints = cut_lineage(fingerprints(docs, words, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    known = cut_lineage(nodes.filter(F.col("node").isNotNull()))
    components = connected_components(link_edges(known, bits))
    labelled = known.join(components, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component")
    )
    return prints.join(labelled, "fp", "left").select("id", "fp", "component")


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per MinHash band of a set of 64-bit hashes; sets share a band where all its minima are equal."""
    if not len(hashes):
        return np.arange(BANDS, dtype=np.uint64)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        least = np.minimum(least, (_FACTORS * low[at : at + 4096]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _meet(bits: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether signs (fingerprint, band keys) make candidates."""
    return lambda one, many: (np.bitwise_count(many[:, 0] ^ one[0]) <= bits) | (many[:, 1:] == one[1:]).any(axis=1)


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small)) if len(small) else 0
    return both >= similarity * (len(x) + len(y) - both)


def _verified(words: int, similarity: float, meets: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Task over rows (group, part, node, label, copy, sign, text) sorted by group and part: a forest of verified links.

    In a part without copies all rows are compared, otherwise copies with the others.
    Rows of one label are linked already.
    """

    def forest(rows: pa.Table, left: list[int], right: list[int]) -> None:
        seen: dict[int, int] = {}
        node, label, copy = (rows.column(i).to_pylist() for i in (2, 3, 4))
        sign = _matrix(rows.column(5))
        for i, (n, c) in enumerate(zip(node, copy, strict=True)):
            seen.setdefault((n, c), i)
        one = list(seen.values())
        first = [i for i in one if copy[i]] or one
        second = np.array([i for i in one if not copy[i]] or [], np.int64)
        if not len(second):
            return
        up = {x: x for x in label}
        sets: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def hashes(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _shingle_hashes(rows.column(6)[i].as_py(), words)
            return sets[i]

        for u in first:
            for v in second[meets(sign[u], sign[second])].tolist():
                if v == u or (v < u and not copy[u]):
                    continue
                x, y = root(label[u]), root(label[v])
                if x != y and _alike(hashes(u), hashes(v), similarity):
                    up[max(x, y)] = min(x, y)
                    left.append(node[u])
                    right.append(node[v])

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, part = (rows.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]), True])
        left: list[int] = []
        right: list[int] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            forest(rows.slice(a, b - a), left, right)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            group, part = (now.column(i).to_numpy() for i in (0, 1))
            last = int(np.flatnonzero((group == group[-1]) & (part == part[-1]))[0])
            if last:
                yield from emit(now.slice(0, last))
            held = now.slice(last)
        if held is not None:
            yield from emit(held)

    return run


def _matrix(signs: pa.ChunkedArray) -> np.ndarray:
    """Equally long arrays as the rows of a matrix."""
    return signs.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(signs), -1)


def _verified_links(members: DataFrame, words: int, similarity: float, meets) -> DataFrame:
    """(a, b): links whose components are those of all pairs in a group that meet and are alike.

    ``members`` holds (group, node, degree, sign, id) and ``text``. Up to ``GROUP`` members of a
    group are compared in one task. Larger groups are dealt over blocks, and the members with
    the most candidates go to every block; then all that is outside the largest component
    found so far is compared with all the group, in pairs of blocks. Runs jobs.
    """
    run = _verified(words, similarity, meets)
    links = "a long, b long"
    columns = ["group", "part", "node", "label", "copy", "sign", "text"]
    placed = lambda df: df.select(*columns).repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(at_end(run), links)
    every = F.when(F.col("shared"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    plain = members.withColumns({"label": F.col("node"), "copy": F.lit(0), "part": F.explode(every)})
    first = cut_lineage(placed(plain))
    large = members.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return first
    labels = connected_components(first).select("node", F.col("component").alias("label"))
    named = cut_lineage(large.select("group", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = named.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    hosts = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("host"), F.sum("n").alias("all"))
    hosts = hosts.filter(F.col("all") > F.col("host.n")).select(
        "group", F.col("host.label").alias("host"), F.ceil((F.col("all") - F.col("host.n")) / F.lit(GROUP)).cast("int").alias("chunks")
    )
    told = named.join(hosts, "group").select("node", "label", "host", "chunks")
    rest = large.join(told, "node")
    upto = lambda n, part: F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), part))
    dealt = rest.withColumn("copy", F.lit(0)).withColumn("part", upto("chunks", lambda chunk: F.col("own") * F.col("chunks") + chunk))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    loose = rest.filter(F.col("label") != F.col("host")).withColumn("copy", F.lit(1))
    loose = loose.withColumn("part", upto("blocks", lambda block: block * F.col("chunks") + mine))
    return first.unionByName(placed(dealt.select(*columns).unionByName(loose.select(*columns))))


def _with_blocks(members: DataFrame) -> DataFrame:
    """Columns (blocks, own, shared): how many blocks the group has, the member's, and whether it goes to all."""
    counts = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP)
    large = counts.select("group", F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("blocks"))
    sized = members.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    most = W.partitionBy("group").orderBy(F.col("degree").desc(), "node")
    top = members.join(large, "group", "left_semi").select("group", "node", F.row_number().over(most).alias("k")).filter(F.col("k") <= SHARED)
    marked = sized.join(top.select("node", F.lit(True).alias("shared")), "node", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return marked.withColumns({"own": own, "shared": F.coalesce("shared", F.lit(False))})


def _least_of_group(docs: DataFrame, bits: int = 7, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, least) per id and text: the number of the text, and (id, node) of the least one in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, signs = [], []
            for value in batch.column(1):
                t = value.as_py()
                heads.append(_text_node(t))
                signs.append(np.r_[np.uint64(word_set_fingerprint(t)), band_keys(_shingle_hashes(t, words))].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], ["id", "node", "sign"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(at_end(run), "id long, node long, sign array<long>")
    prints = cut_lineage(made.groupBy("id", "node").agg(F.min("sign").alias("sign")))
    nodes = cut_lineage(prints.groupBy("node").agg(F.min("id").alias("id"), F.min("sign").alias("sign")))
    near = link_edges(nodes.select("node", F.element_at("sign", 1).alias("fp")), bits)
    keyed = nodes.select("node", F.explode(F.slice("sign", 2, BANDS)).alias("key"))
    bands = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    met = cut_lineage(keyed.join(bands, "key").groupBy("node", "least").agg(F.sum("n").alias("n")))
    groups = connected_components(near.unionByName(met.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree"))
    members = nodes.join(groups.withColumnRenamed("component", "group"), "node").join(degrees, "node", "left")
    members = cut_lineage(_with_blocks(members.select("group", "node", F.coalesce("degree", F.lit(0)).alias("degree"), "sign", "id")))
    mine = _only_own_text(members.join(rows, "id"))
    found = connected_components(_verified_links(cut_lineage(mine), words, similarity, _meet(bits)))
    named = nodes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min(F.struct("id", "node")).alias("least"))
    labelled = named.join(least, "group").select("node", "least")
    return prints.select("id", "node").join(labelled, "node").select("id", "node", "least")


def similar_documents(
    docs: DataFrame,
    bits: int = 7,
    words: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, component) of near copies: candidates by fingerprint or MinHash, verified on the texts.

    Texts with equal words are one. Texts whose fingerprints of the distinct words differ in
    at most ``bits`` bits, or whose shingle sets share a MinHash band, are candidates. They
    link if their sets of ``words``-word shingles have a Jaccard similarity of at least
    ``similarity``; components are those of all such links. Every candidate is compared
    unless other links join the two. Rows without an id have no row here, texts without
    words are one; an id with several texts has a row for each. Runs jobs.
    """
    return _least_of_group(docs, bits, words, similarity, id_col, text_col).select("id", F.col("least.id").alias("component"))


def _text_node(text: str | None) -> int:
    """Number of a text, by its words: the head of a 128-bit digest."""
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(_parts(text)))[:8], "big", signed=True)


def _only_own_text(rows: DataFrame) -> DataFrame:
    """Rows whose ``text`` is that of ``node``; ids may be repeated for different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)
            yield batch.filter(pa.array([n == _text_node(t.as_py()) for n, t in pairs], pa.bool_()))

    return rows.mapInArrow(at_end(run), rows.schema)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the least id.

    Rows without an id stay, as nothing names them. An id may be repeated for different
    texts, which are documents of their own; of rows with one id and equal words one stays.
    """
    found = _least_of_group(docs, id_col=id_col, text_col=text_col, **settings)
    kept = found.filter(F.struct("id", "node") == F.col("least")).select(F.col("id").alias("__id"), F.col("node").alias("__node"))
    number = F.arrow_udf(lambda texts: pa.array([_text_node(t) for t in texts.to_pylist()], pa.int64()), "long")
    named = docs.filter(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col).cast("long"), "__node": number(F.col(text_col).cast("string"))})
    rows = named.join(kept, ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"])
    return rows.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
