"""Tries of conversations: every distinct beginning is a node with its members and totals.

A conversation is a row of turn ids (126 bits of a digest of role and text). Rows are
sorted into shards by range, along the ids and then the conversation, so a node's members
stand together. A shard lays its rows into matrices padded to a few turns, blocks of columns
at a time, sorts them with lexsort from the last block to the first, and marks where a node
starts: where a row differs from the one before it in a column or in any to its left.
Totals of every depth are sums over the runs between the marks.

A node that goes on in a neighbouring shard is known by how many turns the last row of one
shard shares with the first row of the next. What a shard says of such a node is a part:
a node belongs to the shard in which it starts and closes in the one in which it ends, so
parts add up. Only these boundary nodes are shuffled again, as one row per shard and node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.mixing import word_count
from effectframe.operators.joins import salted_join
from effectframe.session import cut_lineage

#: Turns of a shard, on average, and turns of a block of columns.
SHARD_TURNS = 200_000
BLOCK = 8
#: Conversations dealt from one: the ids from a multiple of this number on.
FAMILY = 20


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with empty strings for nulls; rows without conv_id belong to none."""
    clean = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), clean("role"), clean("text"))


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): two ids and one word count per turn, by turn (null first), then role and text digest.

    One conversation is one row, 24 bytes a turn; texts do not move.
    """
    part = lambda start: F.shiftrightunsigned(F.conv(F.substring("__digest", start, 16), 16, -10).cast("long"), 1)
    marked = _turns(conversations).withColumn("__digest", _digest())
    one = F.struct("turn", "role", part(1).alias("a"), part(17).alias("b"), word_count(F.col("text")).alias("words"))
    rows = marked.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    ids = F.flatten(F.transform("all", lambda t: F.array(t["a"], t["b"])))
    return rows.select("conv_id", ids.alias("ids"), F.transform("all", lambda t: t["words"]).alias("words"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of c - c % 20 and its own after its first h; h = crc32(c) % 4."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    own = sequences.withColumn("__h", head).withColumn("__base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    base = sequences.select(F.col("conv_id").alias("__base"), F.col("ids").alias("__ids"), F.col("words").alias("__words"))
    joined = own.join(base, "__base", "left")

    def grown(name: str, per_turn: int) -> Column:
        width = F.col("__h") * per_turn
        first = F.slice(F.coalesce(f"__{name}", F.array().cast("array<long>")), F.lit(1), width)
        return F.concat(first, F.slice(name, width + 1, F.size(name))).alias(name)

    return joined.select("conv_id", grown("ids", 2), grown("words", 1))


def _shared_turns(left: Column, right: Column) -> Column:
    """Turns which two rows of ids share at their start; -1 beside a missing row."""
    differs = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    same = F.when(differs == 0, F.size(left)).otherwise(differs - 1)
    return F.when(left.isNull() | right.isNull(), -1).otherwise(F.floor(same / 2)).cast("int")


def _boundaries(sharded: DataFrame) -> DataFrame:
    """(shard, before, after): turns shared with the last row before the shard and the first row after it.

    One row per shard passes the window.
    """
    row = F.struct("ids", "conv_id")
    ends = sharded.groupBy("shard").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last"))
    along = W.orderBy("shard")
    near = ends.withColumn("last_before", F.lag("last").over(along)).withColumn("first_after", F.lead("first").over(along))
    before = _shared_turns(F.col("last_before"), F.col("first"))
    return near.select("shard", before.alias("before"), _shared_turns(F.col("last"), F.col("first_after")).alias("after"))


class _Rows:
    """Rows of a shard: ids of turn t of row i at ``starts[i] + t``."""

    def __init__(self, table: pa.Table):
        self.conv = table["conv_id"].to_numpy()
        ids, words = table["ids"].combine_chunks(), table["words"].combine_chunks()
        offsets = words.offsets.to_numpy().astype(np.int64)
        self.starts, self.lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        pairs = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()].reshape(-1, 2)
        self.a, self.b = pairs[:, 0], pairs[:, 1]
        self.words = words.values.to_numpy()[offsets[0] : offsets[-1]]

    def block(self, rows: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Padded matrices of both ids and of where they are real, and the cells they are taken from."""
        at = begin + np.arange(BLOCK)
        inside = at < self.lengths[rows][:, None]
        cells = np.minimum(self.starts[rows][:, None] + at, len(self.a) - 1)
        return np.where(inside, self.a[cells], -1), np.where(inside, self.b[cells], -1), inside, cells

    def sorted(self) -> np.ndarray:
        """Order of the rows by ids, a beginning before what goes on, then by conversation."""
        n = len(self.conv)
        by_conv = np.empty(n, np.int64)
        by_conv[np.argsort(self.conv, kind="stable")] = np.arange(n)
        rank = by_conv
        for begin in range((int(self.lengths.max()) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            rows = np.flatnonzero(self.lengths > begin)
            a, b, _, _ = self.block(rows, begin)
            columns = [c for j in range(BLOCK) for c in (a[:, j], b[:, j])]
            order = np.lexsort([rank[rows], *columns[::-1]])
            rank = by_conv.copy()
            rank[rows[order]] = n + np.arange(len(rows))
        return np.argsort(rank, kind="stable")

    def depths(self, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per depth from 1: places in the order of the rows that reach it, where a node starts, words of the turn."""
        found, carry = [], np.zeros(len(order), bool)
        carry[:1] = True
        for begin in range(0, int(self.lengths.max()), BLOCK):
            at = np.flatnonzero(self.lengths[order] > begin)
            a, b, inside, cells = self.block(order[at], begin)
            changed = np.zeros(a.shape, bool)
            changed[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            changed[1:, 0] |= np.diff(at) > 1  # The row before it is too short to be here.
            changed[:1, 0] = True
            changed = np.logical_or.accumulate(changed, axis=1) | carry[at][:, None]
            carry[at] = changed[:, -1]
            for j in range(BLOCK):
                real = inside[:, j]
                if not real.any():
                    break
                found.append((at[real], changed[real, j], self.words[cells[real, j]]))
        return found

    def keys(self, row: int, turns: int) -> list[bytes]:
        """Digest of the first 0, 1, ... ``turns`` turns of a row."""
        state, found = hashlib.sha256(), [hashlib.sha256().digest()]
        for t in range(self.starts[row], self.starts[row] + turns):
            state.update(self.a[t].tobytes() + self.b[t].tobytes())
            found.append(state.copy().digest())
        return found


_PARTS = (
    "shard long, key binary, depth long, conv_id long, parent_conv_id long, parent_key binary, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string"
)


def _shard_nodes(table: pa.Table, info: pa.Table) -> pa.Table:
    """All nodes of a shard, the boundary nodes with a key and as parts."""
    shard, before, after = (info[c][0].as_py() for c in ("shard", "before", "after"))
    rows = _Rows(table)
    n = len(rows.conv)
    order = rows.sorted()
    conv, lengths = rows.conv[order], rows.lengths[order]
    first_keys, last_keys = rows.keys(order[0], max(before, 0)), rows.keys(order[-1], max(after, 0))
    root = np.zeros(n, bool)
    root[0] = True
    levels = [(np.arange(n), root, np.zeros(n, np.int64)), *rows.depths(order)]
    saved, leaves, begun = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    made: list[pa.RecordBatch] = []
    waiting: tuple[list, np.ndarray] | None = None  # Columns of the depth below and the places its nodes start at.

    def flush(parents: np.ndarray, parent_key: list, above: np.ndarray) -> None:
        columns, places = waiting
        run = np.searchsorted(above, places, "right") - 1
        keys = [parent_key[r] for r in run]
        known = pa.array(parents[run], pa.int64(), mask=np.array([k is not None for k in keys], bool))
        columns[4:4] = [known, pa.array(keys, pa.binary())]
        made.append(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PARTS.split(", ")]))

    for depth in range(len(levels) - 1, -1, -1):
        at, start, words = levels[depth]
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(at)) - 1
        mine = np.ones(len(first), bool)
        mine[0] = not (at[0] == 0 and depth <= before)
        goes_on = np.zeros(len(first), bool)
        goes_on[-1] = at[-1] == n - 1 and depth <= after
        saved[at] += words
        saved[at[first[mine]]] -= words[first[mine]]
        leaves[at[last]] += (lengths[at[last]] == depth) & ~goes_on
        smallest = np.minimum.reduceat(conv[at], first)
        ended = np.add.reduceat((lengths[at] == depth).astype(np.int64), first)
        key: list[bytes | None] = [None] * len(first)
        if not mine[0]:
            key[0] = first_keys[depth]
        if goes_on[-1]:
            key[-1] = last_keys[depth]
        texts = [",".join(map(str, conv[at[f : f + e]].tolist())) for f, e in zip(first.tolist(), ended.tolist(), strict=True)]
        digests = [hashlib.sha256(t.encode()).hexdigest() if k is None else None for t, k in zip(texts, key, strict=True)]
        if waiting is not None:
            flush(smallest, key, at[first])
        whole = [
            pa.array(np.full(len(first), shard), pa.int64()),
            pa.array(key, pa.binary()),
            pa.array(np.full(len(first), depth), pa.int64()),
            pa.array(smallest, pa.int64()),
            pa.array(last - first + 1, pa.int64()),
            pa.array(np.add.reduceat(begun[at], first), pa.int64()),
            pa.array(np.add.reduceat(leaves[at], first), pa.int64()),
            pa.array(np.add.reduceat(saved[at], first), pa.int64()),
            pa.array(digests, pa.string()),
            pa.array([t if k is not None else None for t, k in zip(texts, key, strict=True)], pa.string()),
        ]
        waiting = whole, at[first]
        begun[:] = 0
        begun[at[first[mine]]] = 1
    columns, places = waiting
    columns[4:4] = [pa.nulls(len(places), pa.int64()), pa.nulls(len(places), pa.binary())]
    made.append(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PARTS.split(", ")]))
    return pa.Table.from_batches(made)


_MERGED = "key binary, depth long, conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes from their parts, which come by key and shard; holds one node at a time."""
    names = [c.split()[0] for c in _MERGED.split(", ")]
    key, state, row = None, None, None

    def done() -> list:
        return [key, *row, state.hexdigest()]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        schema = pa.schema(list(zip(names, [pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string()], strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        ready = []
        for part in batch.to_pylist():
            if part["key"] != key:
                if key is not None:
                    ready.append(done())
                key, state, row, begun = part["key"], hashlib.sha256(), [part["depth"], part["conv_id"], part["parent_key"], 0, 0, 0, 0], False
            row[1] = min(row[1], part["conv_id"])
            for i, name in enumerate(names[4:8], 3):
                row[i] += part[name]
            if part["ends"]:
                state.update(("," if begun else "").encode() + part["ends"].encode())
                begun = True
        if ready:
            yield batch_of(ready)
    if key is not None:
        yield batch_of([done()])


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``sequences`` (conv_id, ids, words; conv_id unique). Runs jobs.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    the least member, the turns from the root, the least member of the parent (null at the
    root), members, children, childless nodes below (itself included), words that repeat
    below, and the SHA-256 of the ids that end here, ascending and comma-joined. Without
    sequences there are no nodes.
    """
    spark = sequences.sparkSession
    kept = cut_lineage(sequences)
    turns = kept.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    sharded = cut_lineage(kept.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")))
    info = _boundaries(sharded)
    nodes = sharded.groupBy("shard").cogroup(info.groupBy("shard")).applyInArrow(_shard_nodes, _PARTS)
    nodes = cut_lineage(nodes)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = nodes.filter(F.col("key").isNotNull())
    merged = cut_lineage(parts.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_merge, _MERGED))
    inner = nodes.filter(F.col("key").isNull())
    under = ["depth", "conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    waiting = inner.filter(F.col("parent_key").isNotNull()).select(under).unionByName(merged.select(under))
    counts = waiting.groupBy("parent_key").agg(F.count("*").alias("n"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    found = salted_join(waiting, parents, ["parent_key"], counts)
    return inner.filter(F.col("parent_key").isNull()).select(columns).unionByName(found.select(columns))


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of the trie of ``turn_sequences(conversations)`` with role and text of their last turn (null at the root)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", _digest())
    turns = _turns(conversations).withColumn("depth", F.row_number().over(order).cast("long"))
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text).

    Turns go by ``turn``, null first; equal turns by role and text digest, so repeated rows are turns
    of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation.
    Other columns are not read; an empty table has no nodes, not even a root.
    """
    return prefix_trie(rebuilt(cut_lineage(turn_sequences(conversations))), shard_turns)
