"""Joins under skew.

Plain equi-joins here rely on adaptive execution, which splits a skewed partition at
run time and needs no second pass over the data. Salting is used where the rows per
key are known anyway, because a distinct or a group aggregate came before the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot above its share of a partition's rows: at most this many keys per partition can be.
HOT_KEYS_PER_PARTITION = 4
MEMBER_BITS = 1 << 27
_SALT = "__salt"
_SALTS = "__salts"


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    counts: DataFrame,
    how: str = "left",
    hot_rows: int | None = None,
) -> DataFrame:
    """``left`` join ``right``; left keys above ``hot_rows`` rows are split.

    ``counts`` holds the key columns and ``n``, the left rows per key (an upper bound
    will do). Rows of a hot key get one of ``ceil(n / hot_rows)`` salts and the right
    rows of that key are copied once per salt. By default a key is hot above
    ``1 / HOT_KEYS_PER_PARTITION`` of what a shuffle partition holds on average, so
    the broadcast table of hot keys has at most ``HOT_KEYS_PER_PARTITION`` rows per
    partition by arithmetic, whatever the data. ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keys = list(on)
    payload = [c for c in right.columns if c not in keys]
    clash = sorted(set(payload) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    if hot_rows is None:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
        limit = F.greatest(F.ceil(total / F.lit(HOT_KEYS_PER_PARTITION * partitions)), F.lit(1))
    else:
        limit = F.lit(hot_rows)
    hot = F.broadcast(
        counts.filter(F.col("n") > limit).select(
            *[F.col(k).alias(f"__h_{k}") for k in keys],
            F.ceil(F.col("n") / limit).cast("int").alias(_SALTS),
        )
    )

    def with_salts(side: DataFrame) -> DataFrame:
        # Null keys are salted too: left rows without a key may be the hot group.
        same = reduce(lambda a, b: a & b, [side[k].eqNullSafe(F.col(f"__h_{k}")) for k in keys])
        return side.join(hot, same, "left").drop(*[f"__h_{k}" for k in keys])

    # The partition id tells exact copies of one row apart.
    spread = F.pmod(
        F.xxhash64(*[F.col(c) for c in left.columns], F.spark_partition_id()), F.col(_SALTS)
    )
    salted_left = with_salts(left).withColumn(
        _SALT, F.when(F.col(_SALTS).isNull(), F.lit(0)).otherwise(spread).cast("int")
    )
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
    salted_right = with_salts(right).select(*keys, *payload, copies.alias(_SALT))
    joined = salted_left.join(salted_right, [*keys, _SALT], how)
    return joined.select(*left.columns, *payload)


def mark_members(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` and ``flag``: false if its ``key`` is none of ``keys``, else true, and true for a few others.

    A table of ``MEMBER_BITS`` bits (16 MB), one of which every key sets, goes to all tasks: rows that would
    meet nothing in a join after it need not be shuffled. A null key is no member.
    """

    def place():
        return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(MEMBER_BITS)) + 1)

    # Bits are numbered from 1; a bucket is a row of 4 KB.
    bucket, at = F.bitmap_bucket_number(place()), F.bitmap_bit_position(place())
    marks = keys.select(bucket.alias("__bucket"), at.alias("__at")).filter(F.col("__bucket").isNotNull()).distinct()
    table = marks.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    met = df.withColumns({"__bucket": bucket, "__at": at}).join(F.broadcast(table), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return met.select(*df.columns, inside.alias(flag))


def possible_members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows which :func:`mark_members` marks."""
    return mark_members(df, keys, key, "__member").filter("__member").drop("__member")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key equals a null key; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in on])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in on])


def left_join_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Left join; right columns which clash with left ones take ``suffix``."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})
    return left.join(renamed, list(on), "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least in ``order``, then in the other columns.

    ``row_number() = 1`` is planned with a limit before the shuffle, so every map
    task sends one row per key at most, also for a key with very many copies.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    by = [F.col(c).asc_nulls_last() for c in [*order, *rest]]
    if not by:
        return df.dropDuplicates(list(keys))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col("__rn") == 1).drop("__rn")


def merge_back(base: DataFrame, update: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Left-join ``update`` (first row per key) on the key's text, replacing its columns in ``base``."""
    one = first_per_key(update, [key], order)
    columns = [c for c in one.columns if c != key]
    keyed = one.select(F.col(key).cast("string").alias("__key"), *columns)
    kept = base.drop(*[c for c in columns if c in base.columns])
    return kept.withColumn("__key", F.col(key).cast("string")).join(keyed, "__key", "left").drop("__key")
