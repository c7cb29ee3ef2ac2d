"""Variant table curation: filters, binary label, gene symbol, value guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe import constants as C
from effectframe.functions import text, vectors
from effectframe.schemas import require_columns


def binary_label(col: Column) -> Column:
    """1 pathogenic, 0 benign, null for any other significance."""
    s = F.lower(text.strip(col))
    return F.when(s.isin(C.PATHOGENIC_TERMS), 1).when(s.isin(C.BENIGN_TERMS), 0)


def gene_from_name(name: Column) -> Column:
    found = F.regexp_extract(F.coalesce(name, F.lit("")), C.GENE_IN_NAME_PATTERN, 1)
    return F.when(found.rlike(C.GENE_SYMBOL_PATTERN), found)


def gene_from_symbol(symbol: Column) -> Column:
    s = text.strip(F.coalesce(symbol, F.lit("")))
    low = F.lower(s)
    described = F.lit(False)
    for word in C.NON_GENE_WORDS:
        described = described | F.contains(low, F.lit(word))
    head = F.element_at(F.split(s, C.GENE_SEPARATOR_PATTERN), 1)
    return F.when(~described & head.rlike(C.GENE_SYMBOL_PATTERN), head).otherwise(F.lit(""))


def pick_gene(name: Column, symbol: Column) -> Column:
    """Gene named in the variant's title, else a clean gene symbol, else empty."""
    return F.coalesce(gene_from_name(name), gene_from_symbol(symbol))


def curate_variants(df: DataFrame) -> DataFrame:
    """High-confidence labelled variants: source columns plus ``_y``."""
    require_columns(df, C.VARIANT_COLUMNS)
    required = [
        "ChromosomeAccession",
        "PositionVCF",
        "ReferenceAlleleVCF",
        "AlternateAlleleVCF",
    ]
    return (
        df.select(*C.VARIANT_COLUMNS)
        .filter(F.col("Assembly") == C.ASSEMBLY)
        .filter(F.col("ReviewStatus") == C.REVIEW_STATUS)
        .dropna(subset=required)
        .filter(F.col("PositionVCF") > 0)
        .withColumn("_y", binary_label(F.col("ClinicalSignificance")))
        .filter(F.col("_y").isNotNull())
        .withColumn("GeneSymbol", pick_gene(F.col("Name"), F.col("GeneSymbol")))
    )


def filter_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose text is one of ``allowed``; null counts as the empty text."""
    if not allowed:
        raise ValueError("at least one allowed value is required")
    require_columns(df, [column])
    return df.filter(F.coalesce(F.col(column).cast("string"), F.lit("")).isin(list(allowed)))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the result is empty. Runs a job which stops at the first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def feature_violations(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """One row of counts which must all be zero before features are used."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y.isNull()).alias("label_missing"),
        F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("label_not_binary"),
        F.count_if(F.col(vec).isNull()).alias("vector_missing"),
        F.count_if(F.size(vec) != dim).alias("vector_wrong_size"),
        F.count_if(F.exists(vec, lambda x: ~vectors.is_finite(x))).alias("vector_not_finite"),
    )
