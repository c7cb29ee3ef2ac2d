"""Shards chosen by weighted hash draws down a tree of regions, racks and shards.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and
the child's name, and the least draw wins. So a child is chosen in proportion to its
weight, and its draw depends on nothing but itself: if a subtree's weight changes, rows
move into it or out of it, but not between other subtrees. A shard added as a region
of its own takes rows only into itself; one added inside a region draws rows to its
region, of which its siblings take their part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe.operators.ranks import range_rank


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def regular_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Shards 0 to ``shards - 1`` of equal weight, filled rack by rack and region by region."""
    per_region = racks * per_rack
    return [Shard(i, f"region{i // per_region}", f"rack{i % per_region // per_rack}") for i in range(shards)]


def _children(nodes: Sequence[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for n, w, i in nodes])


def _chosen(key: Column, children: Column) -> Column:
    """``at`` of the child with the least draw."""
    u = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11) + F.lit(0.5)) / F.lit(2.0**53)
    draws = F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("draw"), c["at"].alias("at")))
    return F.array_min(draws)["at"]


def tree_shard(key: Column, tree: Sequence[Shard]) -> Column:
    """Shard number of a row by its key. Weights must be positive; the tree is small configuration."""
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a tree needs shards of positive weight")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weigh = lambda shards: sum(s.weight for s in shards)
    top = _children([(r, sum(map(weigh, racks.values())), i) for i, (r, racks) in enumerate(regions.items())])
    middle = F.array(
        *[_children([(f"{r}/{k}", weigh(s), i) for i, (k, s) in enumerate(racks.items())]) for r, racks in regions.items()]
    )
    leaves = F.array(
        *[
            F.array(*[_children([(f"{r}/{k}/{s.number}", s.weight, s.number) for s in shards]) for k, shards in racks.items()])
            for r, racks in regions.items()
        ]
    )
    place = F.transform(F.array(_chosen(key, top)), lambda r: F.struct(r.alias("region"), _chosen(key, middle[r]).alias("rack")))[0]
    return F.transform(F.array(place), lambda p: _chosen(key, leaves[p["region"]][p["rack"]]))[0].cast("int")


def shard_documents(
    docs: DataFrame,
    tree: Sequence[Shard],
    grown: Sequence[Shard],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard), one row per row.

    ``shard`` follows from the id and the tree alone, ``grown_shard`` from the id and the
    grown tree. A row without an id goes by the checksum of its text. ``size`` is the
    text's UTF-8 bytes plus 1; a null text has no bytes and checksum 0. ``slot`` numbers
    the rows of a shard from 0 without gaps, by id, checksum and size; rows equal in all
    of these take any order. An empty table gives no rows. Runs a job (the range cut).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    key = F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text_crc32")))
    placed = rows.select("*", key.alias("__key")).select(
        "id", "size", "text_crc32", tree_shard(F.col("__key"), tree).alias("shard"), tree_shard(F.col("__key"), grown).alias("grown_shard")
    )
    ranked = range_rank(placed, ["id", "text_crc32", "size"], "slot", ["shard"])
    return ranked.withColumn("slot", F.col("slot") - 1)
