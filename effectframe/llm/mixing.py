"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies an average document gets.
Each document's expected copies lie around it, moved by a preference between 0 and 1
such that the source's total stays and no document passes the highest ratio. The
whole part is certain; for the rest, documents are ranked by random odds over
inclusion odds, and enter in that order until the source's words are reached. The
sample has a fixed size in words: the last document enters if it brings the total
nearer, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
#: Steps of the preference, size at which a document is half preferred, steps of the rank.
STEPS = 1024
HALF = 512
LEVELS = 65_536
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """Number in (0, 1) from the head of an md5 digest; the same in every run."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``target`` per source of a table (source, source_size, ...) with one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words; none gets more than ``most`` times its size, what is left over goes to the
    others by weight. One row per source takes part in the two windows.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("__weight", weigh).withColumn("__full", F.col("source_size").cast("double") * most)
    # Filled from the source that is full first; the level is the greatest of those on the way.
    filling = W.orderBy(F.col("__full") / F.col("__weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything).cast("double") * share
    level = (budget - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    target = F.least(F.col("__full"), F.col("__level") * F.col("__weight"))
    return levels.withColumn("target", target).drop("__weight", "__full", "__level")


def copies(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies), one row per row of ``docs``.

    ``size`` is the number of words, ``copies`` how often the mix takes the document (0 to
    ``most``). Longer documents are preferred a little, as ``size / (size + HALF)``. Null
    texts have size 0, a null source is a source of its own, rows without an id draw
    alike, ties go to the lesser id; repeated rows are documents of their own. Every run
    takes the same copies. An empty table gives no rows. Runs a job on the sizes.
    """
    if not 0 < share <= most:
        raise ValueError("share must be above 0 and at most the highest ratio")
    size = word_count(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = cut_lineage(rows.withColumn("__like", F.expr(f"({STEPS} * size) div (size + {HALF})")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("__like") * F.col("size")).alias("__liked"))
    targets = source_targets(totals, weights, share, most).select(F.struct("source").alias("__s"), "source_size", "target", "__liked")
    joined = rows.withColumn("__s", F.struct("source")).join(targets, "__s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("source_size") > 0, F.col("__liked").cast("double") / F.col("source_size")).otherwise(0.0)
    expected = F.col("__ratio") + F.col("__ratio") * (1.0 - F.col("__ratio") / float(most)) * ((F.col("__like") - F.col("__mean")) / float(STEPS))
    odds = joined.withColumns({"__ratio": ratio, "__mean": mean}).withColumn("__expected", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), expected)))
    odds = odds.withColumn("__whole", F.floor("__expected").cast("long"))
    part = F.col("__expected") - F.col("__whole")
    u = F.col("__u")
    # Odds over odds as a number in (0, 1): the same order.
    rank = (u * (1.0 - F.col("__part"))) / (u * (1.0 - F.col("__part")) + (1.0 - u) * F.col("__part"))
    odds = odds.withColumns({"__part": part, "__u": draw(F.col("id"), seed)}).withColumn("__rank", F.when(F.col("__part") > 0, rank).otherwise(1.0))
    drawn = odds.withColumn("__level", F.least(F.floor(F.col("__rank") * LEVELS), F.lit(LEVELS)).cast("int"))
    drawn = drawn.drop("__like", "__liked", "__ratio", "__mean", "__expected", "__u")
    # Words per (source, level), then the level in which the rest of the target is reached.
    sums = drawn.groupBy("__s", "__level").agg(
        F.sum("size").alias("__words"), F.sum(F.col("__whole") * F.col("size")).alias("__certain"), F.first("target").alias("__target")
    )
    by_source = W.partitionBy("__s")
    upto = F.sum("__words").over(by_source.orderBy("__level").rowsBetween(W.unboundedPreceding, W.currentRow))
    rest = F.col("__target") - F.sum("__certain").over(by_source)
    cuts = sums.withColumns({"__upto": upto, "__rest": rest}).filter(F.col("__upto") > F.col("__rest"))
    cut = F.min(F.struct("__level", (F.col("__upto") - F.col("__words")).alias("before"), "__rest"))
    cuts = cuts.groupBy("__s").agg(cut.alias("__cut"))
    placed = drawn.join(cuts, "__s", "left")
    clear = placed.filter(F.col("__cut").isNull() | (F.col("__level") != F.col("__cut.__level")))
    close = placed.filter(F.col("__cut").isNotNull() & (F.col("__level") == F.col("__cut.__level")))
    ordered = W.partitionBy("__s").orderBy("__rank", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    so_far = F.col("__cut.before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    clear = clear.withColumn("__in", (F.col("__part") > 0) & (F.col("__cut").isNull() | (F.col("__level") < F.col("__cut.__level"))))
    close = close.withColumn("__in", (F.col("__part") > 0) & (so_far + F.col("size") / 2.0 < F.col("__cut.__rest")))
    both = clear.unionByName(close)
    return both.select(
        "id", "source", "size", "source_size", "target", (F.col("__whole") + F.col("__in").cast("long")).alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken. Rows without an id, or which share one, are taken as often as the first of them."""
    taken = copies(docs, id_col=id_col, **settings).groupBy("id").agg(F.max("copies").cast("int").alias("__copies"))
    joined = docs.join(taken.filter(F.col("__copies") > 0).withColumnRenamed("id", "__id"), F.col(id_col).eqNullSafe(F.col("__id")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")
