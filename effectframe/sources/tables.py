"""Variant tables, annotation tables, graph inputs and vector stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectframe import constants as C
from effectframe.functions.text import missing_to_null
from effectframe.operators.graph import annotation_edges, gene_term_edges, term_term_edges
from effectframe.schemas import CONSEQUENCE_SCHEMA, ONTOLOGY_SCHEMA, VARIANT_SCHEMA, SchemaError, require_columns
from effectframe.sources import files, formats


def read_variants(
    spark: SparkSession, path: str, partitions: int | None = None, blocks: bool = False
) -> DataFrame:
    """Tab-separated variant summary, plain or gzip, with a header row.

    All columns are read as text by position of their header name, the kept ones
    get their types. A gzip file is one split: ``partitions`` spreads it afterwards.
    With ``blocks`` a block-compressed file is unpacked by many tasks, see ``read_block_table``.
    """
    raw = read_block_table(spark, path, "\t") if blocks else _delimited(spark, path, "\t")
    require_columns(raw, C.VARIANT_COLUMNS)
    typed = raw.select(
        *[
            missing_to_null(F.col(f.name)).try_cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, T.LongType)
            else missing_to_null(F.col(f.name)).alias(f.name)
            for f in VARIANT_SCHEMA.fields
        ]
    )
    return typed.repartition(partitions) if partitions else typed


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", True).option("escape", '"')
    return reader.csv(path)


def read_block_table(spark: SparkSession, path: str, sep: str = "\t", range_bytes: int | None = None) -> DataFrame:
    """A delimited table with a header row, dealt to tasks by byte range although it is compressed in blocks.

    All columns are texts. Rows equal to the header are no rows, so every file of a folder may have it; the driver
    reads the first line of the first file. A plain gzip file is read too, by one task; a field holds no line end.
    """
    formats.register(spark)
    ranges = files.byte_ranges(path, range_bytes or formats.RANGE_BYTES)
    header = next(files.own_lines(ranges[0]), "") if ranges else ""
    if not header:
        raise SchemaError(f"no header row in {path}")
    names = header.removeprefix("\ufeff").split(sep)
    schema = T.StructType([T.StructField(n.strip('"'), T.StringType()) for n in names])
    reader = spark.read.format("bgzf").option("range_bytes", range_bytes or formats.RANGE_BYTES)
    lines = reader.load(path).filter((F.col("value") != "") & (F.col("value") != header))
    options = {"sep": sep, "escape": '"'}
    return lines.select(F.from_csv("value", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def read_table(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A table by suffix: parquet, orc, json (one object per line), csv, or tab-separated tsv, tab and txt."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    name = source.rstrip("/").lower()
    for suffix in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(suffix)
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(source)
    if name.endswith((".feather", ".ft", ".arrow")):
        raise ValueError("convert feather files to parquet first; Spark reads no feather")
    if name.endswith(".orc"):
        return spark.read.orc(source)
    if name.endswith((".json", ".jsonl", ".ndjson")):
        return spark.read.json(source)
    if name.endswith(".csv"):
        return _delimited(spark, source, ",")
    if name.endswith((".tsv", ".tab", ".txt")):
        return _delimited(spark, source, "\t")
    raise ValueError(f"unknown kind of table: {source}")


def json_rows(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, broken lines) of a table with one JSON object per row.

    Records have the columns of ``schema``, broken lines what else the table holds and the line. A line is
    broken when it is no JSON object or a field does not fit its type. Blank lines and nulls are neither.
    """
    broken, record = "__broken", "__record"
    whole = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    parsed = lines.filter(F.trim(F.col(column)) != "").withColumn(record, F.from_json(column, whole, options))
    bad = F.col(record).isNull() | F.col(record)[broken].isNotNull()
    return parsed.filter(~bad).select(*[F.col(record)[f.name].alias(f.name) for f in schema.fields]), parsed.filter(bad).drop(record)


def read_consequences(spark: SparkSession, path: str) -> DataFrame:
    """Nested consequence records, one JSON object per line; a broken line fails the job which reads it."""
    return spark.read.schema(CONSEQUENCE_SCHEMA).option("mode", "FAILFAST").json(path)


def read_consequences_apart(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines with their file) of consequence records: every line is in one of the two."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return json_rows(lines, CONSEQUENCE_SCHEMA)


def read_gene_term_edges(
    spark: SparkSession,
    path: str,
    taxon: str = C.HUMAN_TAXON,
    curated_only: bool = False,
    aspects: Sequence[str] | None = ("P", "F"),
) -> DataFrame:
    """``(gene, term)`` from a gene annotation file, plain or gzip."""
    evidence = C.CURATED_EVIDENCE if curated_only else None
    return gene_term_edges(spark.read.text(path), "value", taxon, evidence, aspects)


def read_annotation_edges(
    spark: SparkSession,
    path: str,
    taxon: str = C.HUMAN_TAXON,
    curated_only: bool = False,
    aspects: Sequence[str] | None = ("P", "F"),
) -> DataFrame:
    """``read_gene_term_edges`` through ``format("gaf")``: block-compressed files by range, needed fields only."""
    formats.register(spark)
    needed = "symbol string, qualifier string, term string, evidence string, aspect string, taxon string"
    table = spark.read.format("gaf").schema(needed).load(path)
    return annotation_edges(table, taxon, C.CURATED_EVIDENCE if curated_only else None, aspects)


def read_term_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)`` is-a edges from an ontology document."""
    document = spark.read.schema(ONTOLOGY_SCHEMA).option("multiLine", True).json(path)
    graphs = document.select(F.explode("graphs").alias("g"))
    return term_term_edges(graphs.select(F.inline("g.edges")))


def read_vectors(spark: SparkSession, path: str, key: str, dim: int | None = None) -> DataFrame:
    """``(key, vec)`` from Parquet. With ``dim`` all sizes are checked; that runs a job."""
    store = spark.read.parquet(path)
    require_columns(store, [key, "vec"])
    typed = store.select(key, F.col("vec").cast("array<float>").alias("vec"))
    if dim is not None:
        wrong = typed.filter(F.col("vec").isNull() | (F.size("vec") != dim)).limit(1)
        if not wrong.isEmpty():
            raise ValueError(f"vectors of another size than {dim} in {path}")
    return typed
