"""Global ranks and running sums without pulling a group into one task.

A window without ``partitionBy``, or partitioned by a hot key, sorts all its rows
in one task. Both helpers here cut the order into buckets first, rank or sum
inside each bucket, and add the total of the buckets before it; only one row per
(group, bucket) takes part in that second step. The window has already placed the
rows by (group, bucket), so the join with the offsets does not move them again.
Rows of a null group are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.operators.joins import HOT_KEYS_PER_PARTITION
from effectframe.session import cut_lineage

_BUCKET = "__bucket"
_OFFSET = "__offset"


def _bucket_offsets(
    df: DataFrame, group: Sequence[str], sums: dict[str, Column], whole: bool = False
) -> DataFrame:
    """Per (group, bucket): what all earlier buckets of the group add up to, and all of the group (``whole``)."""
    totals = df.groupBy(*group, _BUCKET).agg(*[c.alias(n) for n, c in sums.items()])
    before = W.partitionBy(*group).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *group,
        _BUCKET,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{_OFFSET}_{n}") for n in sums],
        *[F.sum(n).over(W.partitionBy(*group)).alias(f"__total_{n}") for n in sums if whole],
    )


def hash_rank(
    df: DataFrame,
    hash_text: Column,
    tie_break: Sequence[str],
    rank_col: str = "rank",
    group: Sequence[str] = (),
    hex_digits: int | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """1-based rank inside ``group`` by ``md5(hash_text)``, ties by ``tie_break``; ``size_col`` is the rows of the group.

    The bucket is the head of the digest, so it follows the order, depends on the
    row only and spreads evenly whatever the keys are: ``hash_text`` must be
    (nearly) unique per row. All rows, or a group which holds many of them, are cut into
    ``16 ** hex_digits`` parts, by default at least 256 per shuffle partition; the
    order is the same for any number. A group below its share of a partition stays in
    one piece: cut up, its edges would be as many buckets as rows. With ``hex_digits``
    every group is cut. Rows are shuffled once, without their digest, which is made again behind the shuffle.
    """
    group = list(group)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sparing = bool(group) and hex_digits is None
    if hex_digits is None:
        hex_digits = (256 * partitions - 1).bit_length() // 4 + 1
    digest = F.md5(hash_text.cast("binary"))
    head = F.substring(digest, 1, hex_digits)
    if sparing:
        named = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])
        given = df.filter(named)
        counts = given.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        total = given.agg(F.count(F.lit(1)).alias("total")).scalar()
        # The sum of all groups bounds the number of large ones.
        large = counts.filter(F.col("n") * F.lit(HOT_KEYS_PER_PARTITION * partitions) > total)
        marked = F.broadcast(large.select(*group, F.lit(True).alias("__large")))
        dealt = given.join(marked, group, "left")
        dealt = dealt.withColumn(_BUCKET, F.when(F.col("__large"), head).otherwise("")).drop("__large")
    else:
        dealt = df.withColumn(_BUCKET, head)
    cut = dealt.filter(F.col(_BUCKET) != "") if sparing else dealt
    sums = {"n": F.count(F.lit(1))}
    offsets = _bucket_offsets(cut, group, sums, size_col is not None)
    inside = W.partitionBy(*group, _BUCKET).orderBy("__md5", *tie_break)
    ranked = dealt.repartition(*group, _BUCKET).withColumn("__md5", F.unhex(digest))
    ranked = ranked.withColumn("__inside", F.row_number().over(inside))
    found = []
    if size_col is not None:
        whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ranked = ranked.withColumn("__size", F.count(F.lit(1)).over(whole))
        found = [F.coalesce(F.col("__total_n"), F.col("__size")).alias(size_col)]
    before = F.coalesce(F.col(f"{_OFFSET}_n"), F.lit(0)) if sparing else F.col(f"{_OFFSET}_n")
    return ranked.drop("__md5").join(offsets, [*group, _BUCKET], "left" if sparing else "inner").select(
        *df.columns, (before + F.col("__inside")).cast("long").alias(rank_col), *found
    )


def range_bucketed(df: DataFrame, order: Sequence[Column | str], buckets: int | None = None) -> DataFrame:
    """Rows with a bucket number which grows along ``order``.

    Range partitioning cuts at sampled quantiles of the whole order, so a hot
    prefix (one contig, one position) is cut as well as long as ``order`` ends in
    a nearly unique column. The bounds come from a sample, hence the reliable
    checkpoint: every later use sees the same buckets. Runs a job.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order)
    return cut_lineage(ranged.withColumn(_BUCKET, F.spark_partition_id()))


def range_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank_col: str = "rank",
    group: Sequence[str] = (),
) -> DataFrame:
    """1-based global (or per ``group``) rank along ``order``. Runs a job."""
    group = list(group)
    bucketed = range_bucketed(df, [*group, *order])
    offsets = _bucket_offsets(bucketed, group, {"n": F.count(F.lit(1))})
    inside = W.partitionBy(*group, _BUCKET).orderBy(*order)
    ranked = bucketed.withColumn("__inside", F.row_number().over(inside))
    return ranked.join(offsets, [*group, _BUCKET]).select(
        *df.columns, (F.col(f"{_OFFSET}_n") + F.col("__inside")).cast("long").alias(rank_col)
    )


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums along ``order``: ``{new column: summed column}``. Runs a job."""
    group = list(group)
    bucketed = range_bucketed(df, [*group, *order])
    offsets = _bucket_offsets(bucketed, group, {n: F.sum(c) for n, c in sums.items()})
    inside = (
        W.partitionBy(*group, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    summed = bucketed.withColumns({f"__in_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    return summed.join(offsets, [*group, _BUCKET]).select(
        *df.columns,
        *[(F.col(f"{_OFFSET}_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums],
    )
