"""Contiguous id ranges of about equal weight, as a column.

The weights are summed per id and run along the ids; a cell starts at the first id
before which the running weight has passed the next multiple of the target, however
the ids cluster. Rows find their cell through equal bins of the span of the ids: a bin
knows the cell it begins in and the starts inside it. The table of bins has at most
``BINS`` rows and one number per cell, so it is safe to broadcast.
"""

from __future__ import annotations

from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe.operators.ranks import running_sums

BINS = 16_384


def _starts(df: DataFrame, id_col: str, weight: Column, target: int) -> list[int]:
    """Least id of every cell, ascending. Runs jobs; one number per cell comes to the driver."""
    narrow = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), weight.cast("long").alias("w"))
    summed = running_sums(narrow.groupBy("id").agg(F.sum("w").alias("w")), ["id"], {"upto": "w"})
    cells = summed.groupBy(F.expr(f"(upto - w) div {target}L").alias("cell")).agg(F.min("id").alias("start"))
    return sorted(r.start for r in cells.select("start").collect())


def with_cells(df: DataFrame, id_col: str, weight: Column, target: int, cell_col: str, spread: Column) -> DataFrame:
    """``df`` with a cell number which grows with ``id_col``; a cell weighs about ``target``.

    No cell weighs more than ``target`` and its last id. Rows without an id get negative
    cells, dealt by the hash of ``spread``. Equal ids share a cell. An empty table gets no
    rows. Runs a few jobs on ids and weights.
    """
    bounds = df.agg(F.min(id_col), F.max(id_col), F.sum(F.when(F.col(id_col).isNull(), weight))).first()
    low, high, nulls = (int(x or 0) for x in bounds)
    starts = _starts(df, id_col, weight, target)
    shift = 2 if high - low >= 1 << 62 else 0  # so that no difference overflows
    low, high = low >> shift, high >> shift
    width = -(-(high - low + 1) // min(BINS, 4 * len(starts) + 1))
    inside: dict[int, list[int]] = {}
    for start in starts:
        inside.setdefault(((start >> shift) - low) // width, []).append(start)
    bins, begins, chunks, before = [], [], [], -1
    for number in range((high - low) // width + 1):
        mine = inside.get(number, [])
        step = isqrt(len(mine)) + 1
        bins.append(number)
        begins.append(before)
        chunks.append([mine[i : i + step] for i in range(0, len(mine), step)])
        before += len(mine)
    table = df.sparkSession.createDataFrame(
        pa.table({"__bin": pa.array(bins, pa.int64()), "__begin": pa.array(begins, pa.int64()), "__chunks": pa.array(chunks, pa.list_(pa.list_(pa.int64())))})
    )
    null_cells = max(1, -(-nulls // target))
    number = F.col(id_col).cast("long")
    at = F.shiftright(number, shift) - F.lit(low) if shift else number - F.lit(low)
    binned = df.withColumn("__at", at).withColumn("__bin", F.expr(f"__at div {width}L"))
    none = -1 - F.pmod(F.xxhash64(spread), F.lit(null_cells))
    # The cell is that of the last start up to the id: the last chunk which begins there, then inside it.
    chunk = F.size(F.filter("__chunks", lambda c: c[0] <= number))
    last = F.size(F.filter(F.element_at("__chunks", F.col("__chunk")), lambda s: s <= number))
    earlier = (F.col("__chunk") - 1) * F.size(F.col("__chunks")[0])
    cell = F.when(F.col("__chunk") > 0, F.col("__begin") + earlier + last).otherwise(F.col("__begin"))
    placed = binned.join(F.broadcast(table), "__bin", "left").withColumn("__chunk", chunk)
    return placed.select(*[F.col(c) for c in df.columns], F.when(number.isNotNull(), cell).otherwise(none).cast("long").alias(cell_col))
