"""Group-disjoint stratified splits and balanced sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.operators.joins import salted_join
from effectframe.operators.ranks import hash_rank
from effectframe.schemas import require_columns


def majority_label(df: DataFrame, group: str, label: str = "_y") -> DataFrame:
    """One row per group: rounded mean label (a half goes to the even side, 0) and rows ``n``."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.bround(F.avg(F.col(label).cast("double")), 0).cast("int").alias("group_label"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def assign_groups(
    groups: DataFrame,
    group: str,
    seed: int = 42,
    test_size: float = 0.1,
    val_size: float = 0.1,
) -> DataFrame:
    """``(group, group_label)`` plus ``split``, drawn per label class in md5 order."""
    ranked = hash_rank(
        groups.select(group, "group_label"),
        F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")),
        tie_break=[group],
        rank_col="__rank",
        group=["group_label"],
    )
    # One row per label class: at most two, whatever the table's size.
    cuts = groups.groupBy("group_label").agg(F.count(F.lit(1)).alias("__n"))
    cuts = cuts.select(
        "group_label",
        F.bround(F.lit(test_size) * F.col("__n"), 0).alias("__test"),
        F.bround(F.lit(val_size) * F.col("__n"), 0).alias("__val"),
    )
    split = (
        F.when(F.col("__rank") <= F.col("__test"), "test")
        .when(F.col("__rank") <= F.col("__test") + F.col("__val"), "val")
        .otherwise("train")
    )
    return ranked.join(F.broadcast(cuts), "group_label").select(
        group, "group_label", split.alias("split")
    )


def split_by_group(
    df: DataFrame,
    group: str = "GeneSymbol",
    label: str = "_y",
    seed: int = 42,
    test_size: float = 0.1,
    val_size: float = 0.1,
) -> DataFrame:
    """``df`` plus ``split``; all rows of a group share one split.

    Rows without a group (null) belong to no split and are left out.
    """
    require_columns(df, [group, label])
    groups = majority_label(df, group, label)
    assigned = assign_groups(groups, group, seed, test_size, val_size).select(group, "split")
    return salted_join(df, assigned, [group], groups.select(group, "n"), "inner")


def split_summary(df: DataFrame, label: str = "_y") -> DataFrame:
    """Per split: rows, positives, negatives, share of positives."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"),
        F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("frac_pos"),
    )


def class_weights(df: DataFrame, label: str = "_y") -> DataFrame:
    """Per class present: loss weight ``n / (2 n_c)`` and sampling weight ``1 / n_c``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # The window runs over the class counts, one row per class.
    total = F.sum("n_class").over(W.partitionBy(F.lit(0)))
    return counts.select(
        label,
        "n_class",
        (total / (2.0 * F.col("n_class"))).alias("loss_weight"),
        (1.0 / F.col("n_class")).alias("sample_weight"),
    )


def with_class_weight(df: DataFrame, label: str = "_y") -> DataFrame:
    """Rows with the loss weight of their class (a two-row lookup)."""
    weights = class_weights(df, label).select(label, F.col("loss_weight").alias("weight"))
    return df.join(F.broadcast(weights), label)


def balanced_sample(df: DataFrame, key: str, label: str = "_y", seed: int = 0) -> DataFrame:
    """As many draws with replacement as there are rows, both classes equally likely.

    Every row's key makes one draw: a hash picks the class, another one the member.
    Output: ``draw_key`` and the drawn row's columns. When one class is absent all
    draws go to the other.
    """
    positive = df.withColumn("__class", (F.col(label) > 0).cast("int"))
    members = hash_rank(
        positive.select(F.col(key).alias("__member"), "__class"),
        F.concat_ws(":", F.lit(f"{seed}:member"), F.col("__member").cast("string")),
        tie_break=["__member"],
        rank_col="__index",
        group=["__class"],
    )
    n0, n1 = F.count_if(F.col("__class") == 0), F.count_if(F.col("__class") == 1)
    # Two rows: what each side of the coin draws from.
    sides = positive.agg(n0.alias("__n0"), n1.alias("__n1")).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).cast("long").alias("__coin"),
                    F.when(F.col("__n0") > 0, 0).otherwise(1).alias("__class"),
                    F.when(F.col("__n0") > 0, F.col("__n0")).otherwise(F.col("__n1")).alias("__size"),
                ),
                F.struct(
                    F.lit(1).cast("long").alias("__coin"),
                    F.when(F.col("__n1") > 0, 1).otherwise(0).alias("__class"),
                    F.when(F.col("__n1") > 0, F.col("__n1")).otherwise(F.col("__n0")).alias("__size"),
                ),
            )
        )
    )

    def digits(tag: str):
        text = F.concat_ws(":", F.lit(f"{seed}:{tag}"), F.col("draw_key").cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")

    draws = (
        df.select(F.col(key).alias("draw_key"))
        .withColumn("__coin", F.pmod(digits("class"), F.lit(2)))
        .join(F.broadcast(sides), "__coin")
        .select("draw_key", "__class", (F.pmod(digits("row"), F.col("__size")) + 1).alias("__index"))
    )
    # A row of a small class is drawn very often: the draws of each member are counted
    # once for both joins.
    times = draws.groupBy("__class", "__index").agg(F.count(F.lit(1)).alias("n"))
    picked = salted_join(draws, members, ["__class", "__index"], times, "inner")
    per_member = times.join(members, ["__class", "__index"]).select("__member", "n")
    rows = df.withColumnRenamed(key, "__member")
    drawn = salted_join(
        picked.select("draw_key", "__member"), rows, ["__member"], per_member, "inner"
    )
    return drawn.withColumnRenamed("__member", key)
