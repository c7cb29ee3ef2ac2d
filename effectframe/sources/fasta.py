"""FASTA files as tables, without one row per contig.

A text scan yields lines in file order inside every split; the split's start gives
the order of the splits. A line's base position is the sum of the lengths before it
in its contig: added up inside the split, plus what the splits before carry over
(one row per split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.functions.text import protein_change, strip_protein_version
from effectframe.operators.windows import BIN_SIZE, HALO, bins_from_pieces

_SPLIT = ["__file", "__block"]


def _file_order() -> list:
    return [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    ]


def sequence_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, start, bases)``: every sequence line with its 0-based start."""
    lines = spark.read.text(path).select(*_file_order(), "value")
    clean = F.regexp_replace("value", r"\s+$", "")
    is_header = F.startswith(F.col("value"), F.lit(">"))
    typed = lines.select(
        *_SPLIT,
        "__line",
        F.when(is_header, F.regexp_extract("value", r"^>(\S*)", 1)).alias("__name"),
        F.when(~is_header, clean).alias("bases"),
    )
    inside = W.partitionBy(*_SPLIT).orderBy("__line").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = typed.withColumns(
        {
            "__contig": F.last("__name", ignorenulls=True).over(inside),
            "__run": F.count("__name").over(inside),
            "__length": F.coalesce(F.length("bases"), F.lit(0)),
        }
    )
    run = (
        W.partitionBy(*_SPLIT, "__run").orderBy("__line").rowsBetween(W.unboundedPreceding, -1)
    )
    placed = named.withColumn("__before", F.coalesce(F.sum("__length").over(run), F.lit(0)))

    # One row per split: its last contig name and the bases which follow that name.
    tail = named.groupBy(*_SPLIT).agg(
        F.max_by("__contig", "__line").alias("__last"),
        F.max("__run").alias("__headers"),
    )
    sizes = named.groupBy(*_SPLIT, "__run").agg(F.sum("__length").alias("__size"))
    tail = tail.join(sizes, (F.col("__headers") == sizes["__run"]) & _same_split(tail, sizes)).select(
        tail["__file"], tail["__block"], "__last", "__headers", "__size"
    )
    earlier = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = tail.withColumns(
        {
            "__carry_contig": F.last("__last", ignorenulls=True).over(earlier),
            "__opened": F.count(F.when(F.col("__headers") > 0, 1)).over(upto),
        }
    )
    # A split with a header starts a new carry; later splits without one add to it.
    same = W.partitionBy("__file", "__opened").orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = opened.withColumn("__through", F.sum("__size").over(same))
    previous = W.partitionBy("__file").orderBy("__block")
    carried = summed.select(
        *_SPLIT,
        "__carry_contig",
        F.coalesce(F.lag("__through").over(previous), F.lit(0)).alias("__carry"),
    )
    joined = placed.join(carried, _SPLIT)
    first_run = F.col("__run") == 0
    return joined.filter(F.col("__length") > 0).select(
        F.when(first_run, F.col("__carry_contig")).otherwise(F.col("__contig")).alias("contig"),
        (F.when(first_run, F.col("__carry")).otherwise(F.lit(0)) + F.col("__before"))
        .cast("long")
        .alias("start"),
        "bases",
    )


def _same_split(a: DataFrame, b: DataFrame):
    return (a["__file"] == b["__file"]) & (a["__block"] == b["__block"])


def read_reference_bins(
    spark: SparkSession, path: str, bin_size: int = BIN_SIZE, halo: int = HALO
) -> DataFrame:
    """``bins(contig, bin, bases)`` of a reference FASTA; write it once and reuse it."""
    pieces = sequence_pieces(spark, path).filter(F.col("contig").isNotNull())
    return bins_from_pieces(pieces, bin_size, halo)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(id, seq)`` plus the file order, for FASTA files of short records."""
    records = spark.read.option("lineSep", "\n>").text(path).select(*_file_order(), "value")
    body = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(body, r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_extract(body, r"(?s)\n(.*)$", 1), r"\s+", "")
    return records.select(*_SPLIT, "__line", head.alias("id"), seq.alias("seq")).filter(
        F.col("id") != ""
    )


def read_wild_type_proteins(spark: SparkSession, path: str) -> DataFrame:
    """``(protein_id_norm, seq_wt)``: version-free id, first record of each id."""
    records = read_records(spark, path).withColumn(
        "protein_id_norm", strip_protein_version(F.col("id"))
    )
    order = F.struct("__file", "__block", "__line")
    return records.groupBy("protein_id_norm").agg(F.min_by("seq", order).alias("seq_wt"))


def read_mutant_proteins(spark: SparkSession, path: str) -> DataFrame:
    """``(protein_id_norm, hgvsp_norm, seq_mt)``; all records are kept."""
    records = read_records(spark, path)
    return records.select(
        strip_protein_version(F.element_at(F.split("id", ":"), 1)).alias("protein_id_norm"),
        protein_change(F.col("id")).alias("hgvsp_norm"),
        F.col("seq").alias("seq_mt"),
    )
