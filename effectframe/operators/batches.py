"""Batches of even cost for plug-in encoders, and long sequences in overlapping pieces.

All pieces stand in one order by length, so that a batch pads little. The running sum of their letters cuts that order
into batches: whatever the lengths are, no batch holds a piece more or less than its even share.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.operators.ranks import running_sums
from effectframe.operators.sequences import Encoder

#: Batches are at least so many times the length limit: then the dearest is below 1.2 times the cheapest.
SHARE = 12

Model = Callable[[pd.Series], list]


def pieces(sequences: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """``(seq_id, piece, seq, weight)``: texts cut into at most ``limit`` letters, each sharing ``overlap`` with the next.

    ``weight`` counts the letters of a piece which the piece after it does not begin with, so tokens of ``overlap + 1``
    letters stand in one piece each and weights count them. A text within the limit is one piece; an empty one too. No
    letter is left out. Null texts are no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap lies below the limit")
    step = limit - overlap
    # One scan of the text; a piece which only repeats the end of the one before is dropped.
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{limit}}})).{{1,{step}}}"), F.lit(1))
    long = F.filter(cut, lambda p: F.length(p) > overlap)
    parts = F.when(F.length("seq") <= limit, F.array("seq")).otherwise(long)
    rows = sequences.filter(F.col("seq").isNotNull()).select("seq_id", F.posexplode(parts).alias("piece", "seq"))
    weight = F.greatest(F.length("seq") - overlap, F.lit(1)).cast("long")
    return rows.withColumn("weight", weight)


def batched(parts: DataFrame, budget: int, limit: int) -> DataFrame:
    """``parts`` plus ``batch``, numbered from 0 along (length, id, piece). Runs jobs.

    A batch takes an even share of all letters, at most ``budget``, give or take one piece: from two batches on, the
    dearest costs less than 1.2 times the cheapest as long as the budget is not hardly exceeded (half a batch more
    than it gives two small ones). An empty text costs one letter. ``budget`` must be ``SHARE`` times the limit.
    """
    if budget < SHARE * limit:
        raise ValueError(f"a batch needs a budget of {SHARE} times the limit of a piece")
    costed = parts.withColumn("__cost", F.greatest(F.length("seq"), F.lit(1)).cast("long"))
    summed = running_sums(costed, ["__cost", "seq_id", "piece"], {"__through": "__cost"})
    total = summed.agg(F.max("__through")).first()[0] or 0
    count = max(1, math.ceil(total / budget))
    # The middle of a piece decides, in whole numbers.
    batch = F.expr(f"(2 * __through - __cost) * {count}L div {max(1, 2 * total)}L")
    return summed.withColumn("batch", F.least(batch, F.lit(count - 1))).select(*parts.columns, "batch")


def merged(encoded: DataFrame) -> DataFrame:
    """``(seq_id, vec)`` of ``(seq_id, piece, weight, vec)``: the mean over the pieces by weight."""
    counted = encoded.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("piece") == 0, F.col("vec"))).alias("vec")
    )
    alone = counted.filter("n = 1").select("seq_id", "vec")
    several = encoded.join(counted.filter("n > 1").select("seq_id"), "seq_id", "left_semi")
    dims = several.select("seq_id", "weight", F.posexplode("vec").alias("dim", "x"))
    sums = dims.groupBy("seq_id", "dim").agg(
        (F.sum(F.col("weight") * F.col("x").cast("double")) / F.sum("weight")).cast("float").alias("x")
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    pooled = sums.groupBy("seq_id").agg(F.transform(ordered, lambda s: s["x"]).alias("vec"))
    return alone.unionByName(pooled)


def budget_encoder(model: Model, limit: int, budget: int, overlap: int = 0) -> Encoder:
    """A plug-in encoder: ``model`` turns a series of texts, one batch, into as many vectors.

    No text is cut off at the limit: its pieces are encoded apart and their vectors averaged by weight.
    """

    def encode_batch(batch: pd.DataFrame) -> pd.DataFrame:
        vecs = [list(v) for v in model(batch["seq"])]
        if len(vecs) != len(batch):
            raise ValueError(f"{len(vecs)} vectors for {len(batch)} texts")
        return batch[["seq_id", "piece", "weight"]].assign(vec=vecs)

    def encode(sequences: DataFrame) -> DataFrame:
        parts = batched(pieces(sequences, limit, overlap), budget, limit)
        schema = "seq_id string, piece int, weight long, vec array<float>"
        return merged(parts.groupBy("batch").applyInPandas(encode_batch, schema))

    return encode
