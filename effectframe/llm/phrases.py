"""Frequent phrases and how strongly their parts belong together.

Counting goes by vertical partitioning. Word prefixes are counted level by level - words,
pairs inside frequent words, longer runs inside frequent pairs - and every suffix of a piece
is cut where it stops to be frequent, after ``DEPTH`` words at the latest. Equal cut suffixes are
the leaves, counted before they move. A prefix with more leaves than a task should hold is
replaced by its longer prefixes; prefixes are then put into groups of one memory budget, and
each group builds the subtrees of its prefixes on its own: leaves sorted, node starts where a
column changes, counts as totals of the leaves below. Nodes above a divided prefix add up
over groups.

What is frequent is known to the tasks as bit tables of a fixed size (``hash_counts``). A bit set
by something else only lets a suffix go on for longer; the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.hash_counts import HASH_BITS, PACKED, TABLE_BITS, bit_table, marked, mixed, often, parts_for, sent
from effectframe.llm.word_scan import byte_table, chunked, grouped_texts, scan
from effectframe.operators.ranks import running_sums
from effectframe.session import cut_lineage

DEPTH = 5
LEAST = 100
TOP = 2000
#: Leaves of a group, and distinct leaves a task holds before it sends them.
BUDGET = 100_000
HOLD_LEAVES = 500_000
_GAP = byte_table(b"\x20\x09.,;:!?\x0a\x0b\x0c\x0d")
_BREAK = byte_table(b".,;:!?\x0a\x0b\x0c\x0d")


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(group, word numbers, piece of each word, distinct words) of chunks of texts, A-Z in lower case."""
    for group, texts in chunked(grouped_texts(batches)):
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        words = scan(data, _GAP)
        if len(words.ids):
            yield group, words.ids, np.cumsum(_BREAK[data], dtype=np.int32)[words.starts], words.names


def _keys(names: pa.Array, salt: str) -> np.ndarray:
    salted = salt.encode()
    return np.array([xxhash.xxh64_intdigest(salted + w, 42) for w in names.to_pylist()], np.uint64).view(np.int64)


def _words_marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return marked(bits, keys.view(np.uint64) >> np.uint64(64 - TABLE_BITS))


def _runs_marked(bits: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    return marked(bits, mixed(keys) >> np.uint64(HASH_BITS - TABLE_BITS))


def _word_bits(words: DataFrame) -> np.ndarray:
    """Bits of the keys of frequent words. Runs a job."""
    at = words.select(F.shiftrightunsigned("key", 64 - TABLE_BITS).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    return bit_table(at.select(F.shiftright("at", 6).alias("word"), bit.alias("bits")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, _, names in _chunks(batches):
            f = np.bincount(ids, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(names), pa.string()), names.cast(pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], ["lang", "word", "f"])

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _salt(counts: DataFrame, least: int) -> str:
    """A prefix of the hashed words under which no other word has the key of a frequent one."""
    for attempt in range(16):
        salt = f"{attempt}\t" if attempt else ""
        keyed = counts.groupBy("lang", F.xxhash64(F.concat(F.lit(salt), "word")).alias("key"))
        same = keyed.agg(F.count("*").alias("n"), F.sum("f").alias("f"))
        if same.filter((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            return salt
    raise RuntimeError("word keys collide under every salt")


def _pair_places(ids: np.ndarray, pieces: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places at which two words of a piece follow each other, both marked frequent."""
    of_words = frequent[ids]
    return np.flatnonzero(of_words[:-1] & of_words[1:] & (pieces[:-1] == pieces[1:]))


def _lang_keys(group: str, names: pa.Array, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, and the same told apart by language."""
    keys = _keys(names, salt)
    return keys, keys ^ np.int64(xxhash.xxh64_intdigest(group.encode(), 7) >> 1)


def _pair_bits(texts: DataFrame, salt: str, words, least: int, parts: int) -> np.ndarray:
    """Bit table of the pairs found often enough. Runs a job."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for group, ids, pieces, names in _chunks(batches):
            keys, own = _lang_keys(group, names, salt)
            at = _pair_places(ids, pieces, _words_marked(words.value, keys))
            yield mixed([own[ids[at]], own[ids[at + 1]]])

    return often(texts.mapInArrow(lambda batches: sent(hashes(batches), parts), PACKED), least)


def _going_on(ids: np.ndarray, pieces: np.ndarray, keys: np.ndarray, own: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a frequent pair starts, and the same as marks, ``DEPTH`` longer than the words."""
    at = _pair_places(ids, pieces, _words_marked(words, keys))
    at = at[_runs_marked(pairs, [own[ids[at]], own[ids[at + 1]]])]
    goes_on = np.zeros(len(ids) + DEPTH, bool)
    goes_on[at] = True
    return at, goes_on


def _longer_bits(texts: DataFrame, salt: str, words, pairs, least: int, parts: int) -> np.ndarray:
    """Bit table of the runs of three words and more found often enough, all pairs in them marked. Runs a job."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for group, ids, pieces, names in _chunks(batches):
            keys, own = _lang_keys(group, names, salt)
            at, goes_on = _going_on(ids, pieces, keys, own, words.value, pairs.value)
            for length in range(3, DEPTH + 1):
                at = at[goes_on[at + length - 2]]
                yield mixed([own[ids[at + k]] for k in range(length)])

    return often(texts.mapInArrow(lambda batches: sent(hashes(batches), parts), PACKED), least)


def _sorted_starts(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the rows, and per column whether a row differs from the one before it there or further left."""
    order = np.lexsort(columns[::-1])
    changed, starts = np.zeros(len(order), bool), []
    changed[:1] = True
    for column in columns:
        sorted_column = column[order]
        changed = changed.copy()
        changed[1:] |= sorted_column[1:] != sorted_column[:-1]
        starts.append(changed)
    return order, starts


def _paths(matrix: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of a matrix, each up to its length, as lists."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[np.arange(matrix.shape[1]) < lengths[:, None]]))


def _with_lengths(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.column_stack([lengths.astype(np.int64), matrix])


def _summed_rows(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of matrices and what their counts add up to."""
    matrix, f = np.concatenate([m for m, _ in found]), np.concatenate([f for _, f in found])
    order, starts = _sorted_starts(list(matrix.T))
    first = np.flatnonzero(starts[-1])
    return matrix[order[first]], np.add.reduceat(f[order], first)


def _leaves(texts: DataFrame, salt: str, words, pairs, longer, parts: int) -> DataFrame:
    """(lang, path, f): suffixes of two words and more, cut where they stop to be frequent or after ``DEPTH`` words.

    A task adds up its leaves and sends them packed, in ``parts`` by their hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for group, ids, pieces, names in _chunks(batches):
            keys, own = _lang_keys(group, names, salt)
            at, goes_on = _going_on(ids, pieces, keys, own, words.value, pairs.value)
            if not len(at):
                continue
            columns = [ids[at], ids[at + 1]]
            alive = np.arange(len(at))
            for length in range(3, DEPTH + 1):
                alive = alive[goes_on[at[alive] + length - 2]]
                place = at[alive]
                alive = alive[_runs_marked(longer.value, [own[ids[place + k]] for k in range(length)])]
                column = np.full(len(at), -1, ids.dtype)
                column[alive] = ids[at[alive] + length - 1]
                columns.append(column)
            matrix = np.stack([np.where(c >= 0, keys[c], 0) for c in columns], axis=1)
            inside = np.stack([c >= 0 for c in columns], axis=1)
            yield group, _with_lengths(matrix, inside.sum(axis=1)), np.ones(len(at), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def batch() -> pa.RecordBatch:
            rows = []
            for group, found in held.items():
                matrix, f = _summed_rows(found)
                part = (mixed(list(matrix.T)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                cuts = [*np.flatnonzero(np.append(True, np.diff(part[order]) != 0)).tolist(), len(f)]
                rows += [(group, int(part[order[i]]), zstandard.compress(matrix[order[i:j]].T.tobytes() + f[order[i:j]].tobytes(), 1)) for i, j in zip(cuts, cuts[1:])]
            kinds = pa.string(), pa.int32(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "part", "packed"])

        for group, matrix, f in cut(batches):
            held[group] = [_summed_rows([*held.get(group, []), (matrix, f)])]
            size = sum(len(found[0][1]) for found in held.values())
            if size >= HOLD_LEAVES:
                yield batch()
                held, size = {}, 0
        if size:
            yield batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            matrix, f = _summed_rows(held)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(f), pa.string()), _paths(matrix[:, 1:], matrix[:, 0]), pa.array(f)], ["lang", "path", "f"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["lang"], row["part"]) != at:
                    if held:
                        yield found()
                    at, held = (row["lang"], row["part"]), []
                values = np.frombuffer(zstandard.decompress(row["packed"]), np.int64).reshape(DEPTH + 2, -1)
                held = [_summed_rows([*held, (values[:-1].T, values[-1])])]
        if held:
            yield found()

    packed = texts.mapInArrow(run, "lang string, part int, packed binary")
    placed = packed.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return placed.mapInArrow(merge, "lang string, path array<long>, f long")


def _grouped(leaves: DataFrame, budget: int) -> DataFrame:
    """Leaves with ``cut``, the length of their prefix, and ``group``. Runs jobs.

    A prefix with more than ``budget`` leaves is replaced by its prefixes of one word more; a
    whole path is one leaf, so this ends. Groups take prefixes in order while they fit.
    """
    cut = leaves.withColumn("cut", F.lit(1))
    for depth in range(1, DEPTH):
        prefix = F.slice("path", 1, depth).alias("prefix")
        heavy = cut.filter(F.col("cut") == depth).groupBy("lang", prefix).agg(F.count("*").alias("n")).filter(F.col("n") > budget)
        heavy = cut_lineage(heavy.select("lang", "prefix", F.lit(True).alias("heavy")))
        if heavy.isEmpty():
            break
        marked = cut.withColumn("prefix", F.when(F.col("cut") == depth, F.slice("path", 1, depth))).join(heavy, ["lang", "prefix"], "left")
        cut = marked.select("lang", "path", "f", F.when(F.col("heavy"), depth + 1).otherwise(F.col("cut")).alias("cut"))
    cut = cut.withColumn("prefix", F.slice("path", F.lit(1), F.col("cut")))
    prefixes = cut.groupBy("lang", "prefix").agg(F.count("*").alias("n"))
    placed = running_sums(prefixes, ["lang", "prefix"], {"upto": "n"}).select("lang", "prefix", F.expr(f"(upto - n) div {budget}L").alias("group"))
    return cut.join(placed, ["lang", "prefix"]).select("group", "lang", "path", "f", "cut")


def _subtrees(least: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        langs = table["lang"].combine_chunks().dictionary_encode()
        paths, f, cut = table["path"].combine_chunks(), table["f"].to_numpy(), table["cut"].to_numpy()
        lengths = np.diff(paths.offsets.to_numpy())
        values = paths.values.to_numpy()
        inside = np.arange(DEPTH) < lengths[:, None]
        matrix = np.zeros((len(f), DEPTH), np.int64)
        matrix[inside] = values[paths.offsets[0].as_py() : paths.offsets[-1].as_py()]
        # A path that ends sorts before those that go on.
        columns = [langs.indices.to_numpy()] + [c for k in range(DEPTH) for c in (inside[:, k], matrix[:, k])]
        order, starts = _sorted_starts(columns)
        found = []
        for depth in range(2, DEPTH + 1):
            rows = np.flatnonzero(inside[order, depth - 1])
            if not len(rows):
                break
            first = np.flatnonzero(starts[2 * depth][rows])
            total = np.add.reduceat(f[order][rows], first)
            at = order[rows[first]]
            whole = cut[at] <= depth
            keep = ~whole | (total >= least)
            at = at[keep]
            path = _paths(matrix[at, :depth], np.full(len(at), depth))
            found.append(pa.table({"lang": langs.take(pa.array(at)).cast(pa.string()), "path": path, "f": total[keep]}))
        return pa.concat_tables(found)

    return run


def phrase_counts(leaves: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, path, f) of all paths of two words and more with ``f >= least``. Runs jobs."""
    nodes = _grouped(leaves, budget).groupBy("group").applyInArrow(_subtrees(least), "lang string, path array<long>, f long")
    return nodes.groupBy("lang", "path").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _scored(found: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, path, a, l, r, n, score) by the cut of least score, of several the first."""
    known = found.unionByName(words.select("lang", F.array("key").alias("path"), "f"))
    size = F.size("path")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("path", F.lit(1), F.col("k"))).withColumn("right", F.slice("path", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.withColumnRenamed("f", "a")
    cuts = cuts.join(known.select("lang", F.col("path").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("path").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"  # noqa: E731  counts up to 10^15, products up to 10^34
    score = F.expr(f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})").alias("score")
    cuts = cuts.join(totals, "lang").select("lang", "path", "a", "n", "l", "r", "k", score)
    least = cuts.groupBy("lang", "path").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "path", "a", "cut.l", "cut.r", "n", "cut.score")


def _maximal(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Without paths inside a longer one of the same count.

    A count never rises with length, so what lies in a longer phrase of its own count lies in one of
    one word more as well.
    """
    size = F.size("path")
    inner = F.explode(F.array(F.slice("path", F.lit(1), size - 1), F.slice("path", F.lit(2), size - 1)))
    longer = found.filter(size > 2).select("lang", inner.alias("path"), F.col("f").alias("a"))
    return scored.join(longer, ["lang", "path", "a"], "left_anti")


def _named(paths: DataFrame, words: DataFrame) -> DataFrame:
    """``path`` replaced by the phrase."""
    others = [c for c in paths.columns if c != "path"]
    spelled = paths.select("*", F.posexplode("path").alias("at", "key")).join(words.select("lang", "key", "word"), ["lang", "key"])
    put = F.array_sort(F.collect_list(F.struct("at", "word")))
    grouped = spelled.groupBy("lang", "path").agg(put.alias("put"), *[F.first(c).alias(c) for c in others if c != "lang"])
    return grouped.select(*others, F.concat_ws(" ", F.transform("put", lambda p: p["word"])).alias("phrase"))


def _top(scored: DataFrame, top: int) -> DataFrame:
    """First ``top`` phrases of each language with their rank.

    A language may hold most phrases: parts of it keep their first ``top`` before they meet.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in (parts, isqrt(parts), 1):
        part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part).cast("long")).filter(F.col("rank") <= top)
    return scored


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int | None = TOP,
    budget: int = BUDGET,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``DEPTH`` words found at least ``least`` times.

    A-Z are lower-cased, texts split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at
    blanks and tabs. ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut, ``n`` all
    words of the language. Phrases inside a longer one of the same count are left out; the first
    ``top`` of each language stay (None: all), by score, count and bytes of the phrase. A null language
    is ``und``, a null or empty text has no words, a repeated row counts again, an empty table
    gives no rows; other columns are not read. Runs jobs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = cut_lineage(word_counts(texts))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    salt = _salt(counts, least)
    words = counts.filter(F.col("f") >= least).withColumn("key", F.xxhash64(F.concat(F.lit(salt), "word")))
    share = spark.sparkContext.broadcast
    parts = parts_for(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    word_bits = share(_word_bits(words))
    pair_bits = share(_pair_bits(texts, salt, word_bits, least, parts))
    longer_bits = share(_longer_bits(texts, salt, word_bits, pair_bits, least, parts))
    leaves = cut_lineage(_leaves(texts, salt, word_bits, pair_bits, longer_bits, parts))
    found = cut_lineage(phrase_counts(leaves, least, budget))
    kept = _named(_maximal(_scored(found, words, totals), found), words)
    ranked = kept.withColumn("rank", F.lit(None).cast("long")) if top is None else _top(kept, top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
