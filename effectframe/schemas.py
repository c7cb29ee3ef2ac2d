"""Explicit reader schemas and the schema contract check."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from effectframe.constants import ANNOTATION_LONG_COLUMNS, TRANSCRIPT_FIELDS, VARIANT_COLUMNS

_LONG_VARIANT_COLUMNS = {"VariationID", "PositionVCF", "Start", "Stop"}

VARIANT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name in _LONG_VARIANT_COLUMNS else T.StringType())
        for name in VARIANT_COLUMNS
    ]
)

_LIST_TRANSCRIPT_FIELDS = {"consequence_terms", "swissprot", "uniprot_isoform", "uniparc"}
_LONG_TRANSCRIPT_FIELDS = set(ANNOTATION_LONG_COLUMNS) | {"protein_length"}


def _transcript_type(name: str) -> T.DataType:
    if name in _LIST_TRANSCRIPT_FIELDS:
        return T.ArrayType(T.StringType())
    return T.LongType() if name in _LONG_TRANSCRIPT_FIELDS else T.StringType()


TRANSCRIPT_SCHEMA = T.StructType(
    [T.StructField(name, _transcript_type(name)) for name in TRANSCRIPT_FIELDS]
)

CONSEQUENCE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("most_severe_consequence", T.StringType()),
        T.StructField("assembly_name", T.StringType()),
        T.StructField("allele_string", T.StringType()),
        T.StructField("transcript_consequences", T.ArrayType(TRANSCRIPT_SCHEMA)),
    ]
)

_EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("sub", "pred", "obj")])
_GRAPH = T.StructType([T.StructField("edges", T.ArrayType(_EDGE))])
ONTOLOGY_SCHEMA = T.StructType([T.StructField("graphs", T.ArrayType(_GRAPH))])


class SchemaError(ValueError):
    """A DataFrame does not carry the columns or types a job needs."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def require_types(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Check ``{column: simple type string}``; runs no job."""
    require_columns(df, sorted(contract))
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{c}: expected {t}, found {found[c]}" for c, t in contract.items() if found[c] != t]
    if wrong:
        raise SchemaError("mismatched types: " + "; ".join(wrong))
    return df
