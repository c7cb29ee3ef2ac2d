"""Formats by name and the offset index: the given tables are written in a format and read back from it.

What is written goes to the shared folder of checkpoints, as the result is read from there later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectframe import constants as C
from effectframe.operators import curate, windows
from effectframe.plans.variants import curated_splits
from effectframe.queries import curation, graphs
from effectframe.queries import standins as S
from effectframe.queries.base import query, table
from effectframe.session import ensure_checkpoint_dir
from effectframe.sinks import writers
from effectframe.sources import fasta, fasta_index, formats, tables

#: Small ranges, so that the test files are read by several tasks too.
_RANGE = 1 << 20


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/formats-{uuid.uuid4().hex}"


def _written_fasta(spark: SparkSession, folder: str) -> str:
    """The contigs as FASTA files with ``S.LINE`` bases a line."""
    lines = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{S.LINE}}}"), F.lit(0))
    record = F.concat(F.lit(">"), "contig", F.lit(" a document\n"), F.array_join(lines, "\n"))
    out = _folder(spark)
    S.contigs(spark, folder).select(record.alias("value")).write.text(out)
    return out


def _written_blocks(df: DataFrame, columns: list[str]) -> str:
    """Tab-separated lines in block-compressed files which all begin with the header; nulls are empty."""
    formats.register(df.sparkSession)
    out = _folder(df.sparkSession)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    lines = df.select(F.concat_ws("\t", *fields).alias("value"))
    lines.write.format("bgzf").option("header", "\t".join(columns)).mode("append").save(out)
    return out


@query(
    "block_variants",
    f"""WITH {S.CURATED_SQL}
    SELECT VariationID, GeneSymbol, _y, ChromosomeAccession, PositionVCF FROM curated""",
)
def block_variants(spark, folder):
    """A variant summary written block-compressed, unpacked by range and curated."""
    out = _written_blocks(S.variants(spark, folder), list(C.VARIANT_COLUMNS))
    read = tables.read_variants(spark, out, blocks=True)
    return curate.curate_variants(read).select(*curation._CURATED)


@query("gaf_format", graphs.GAF_SQL)
def gaf_format(spark, folder):
    """Annotation lines written block-compressed and read by name, the needed columns only."""
    out = _folder(spark)
    formats.register(spark)
    graphs.gaf_lines(spark, folder).write.format("bgzf").mode("append").save(out)
    edges = tables.read_annotation_edges(spark, out, curated_only=True)
    return edges.groupBy("gene", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fasta_format",
    f"""WITH {S.WINDOWS_SQL}
    SELECT contig AS id, 'a document' AS description, length(seq) AS n, md5(seq) AS digest FROM contigs""",
)
def fasta_format(spark, folder):
    """Contigs written as FASTA and read by name; records run over range ends."""
    formats.register(spark)
    read = spark.read.format("fasta").option("range_bytes", _RANGE).load(_written_fasta(spark, folder))
    length = F.length("seq").cast("long").alias("n")
    return read.select("id", "description", length, F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(
    "fasta_index",
    f"""WITH {S.WINDOWS_SQL}
    SELECT contig, length(seq) AS length, least(length(seq), {S.LINE}) AS line_bases,
      least(length(seq), {S.LINE}) + 1 AS line_width
    FROM contigs""",
)
def index_of_contigs(spark, folder):
    index = fasta_index.fasta_index(spark, _written_fasta(spark, folder), _RANGE)
    return index.select("contig", "length", "line_bases", "line_width")


@query(
    "indexed_windows",
    f"WITH {S.WINDOWS_SQL} SELECT VariationID, ref_seq, alt_seq, win_start, win_end FROM windows",
)
def indexed_windows(spark, folder):
    """Windows of all loci read from the touched bytes of a FASTA file."""
    index = fasta_index.fasta_index(spark, _written_fasta(spark, folder), _RANGE)
    found = fasta_index.indexed_windows(S.loci(spark, folder), index, S.WINDOW)
    return windows.kept_windows(found).select(
        "VariationID",
        F.col("dna_ref_seq").alias("ref_seq"),
        F.col("dna_alt_seq").alias("alt_seq"),
        F.col("dna_window_start").alias("win_start"),
        F.col("dna_window_end").alias("win_end"),
    )


@query(
    "split_table_trip",
    f"""WITH {S.SPLIT_SQL}
    SELECT VariationID, GeneSymbol, _y, split FROM curated JOIN assigned USING (GeneSymbol)""",
)
def split_table_trip(spark, folder):
    """The split variants, written by split and read back."""
    out = _folder(spark)
    writers.write_split_table(curated_splits(S.variants(spark, folder)), out)
    return tables.read_table(spark.read.parquet(out)).select("VariationID", "GeneSymbol", "_y", "split")


@query(
    "vector_trip",
    """WITH dims AS (SELECT vec_id, i - 1 AS dim, embedding[i] AS x FROM embeddings, unnest(range(1, 65)) AS u(i))
    SELECT 'V' || vec_id AS gene, CAST(dim AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 5) AS x, true AS near
    FROM dims""",
)
def vector_trip(spark, folder):
    """Vectors written as Parquet and as text: the stored ones, and whether the text agrees to its six decimals."""
    given = table(spark, folder, "embeddings")
    out = f"{_folder(spark)}/v"
    writers.write_gene_vectors(
        given.select(F.concat(F.lit("V"), "vec_id").alias("gene"), F.col("embedding").alias("vec")), out
    )
    stored = tables.read_vectors(spark, f"{out}_genes.parquet", "gene", 64)
    parts = F.split("value", "\t")
    shown = spark.read.text(f"{out}_genes.tsv").select(parts[0].alias("gene"), F.split(parts[1], " ").alias("text"))
    both = stored.join(shown, "gene").select("gene", F.posexplode(F.arrays_zip("vec", "text")).alias("dim", "p"))
    x = F.col("p.vec").cast("double")
    near = F.abs(x - F.col("p.text").cast("double")) <= 1e-6
    return both.select("gene", "dim", F.round(x, 5).alias("x"), near.alias("near"))


@query("predictions_trip", f"WITH {S.SCORED_SQL} SELECT doc_id, lang AS split, y, prob FROM scored")
def predictions_trip(spark, folder):
    out = _folder(spark)
    writers.write_predictions(S.scored(spark, folder).withColumnRenamed("lang", "split"), out)
    return spark.read.parquet(out).select("doc_id", "split", "y", "prob")


@query(
    "window_trip",
    f"""WITH {S.WINDOWS_SQL}
    SELECT VariationID, md5(ref_seq || '>' || alt_seq) AS pair, 'contigs' AS dna_fasta_path FROM windows""",
)
def window_trip(spark, folder):
    """The window table as written, with the name of its reference."""
    bins = windows.bins_from_pieces(S.contig_pieces(spark, folder), S.BIN, S.BIN // 2)
    found = windows.variant_windows(S.loci(spark, folder), bins, S.WINDOW, S.BIN, S.BIN // 2)
    out = _folder(spark)
    writers.write_windows(windows.kept_windows(found), out, "contigs")
    pair = F.md5(F.concat_ws(">", "dna_ref_seq", "dna_alt_seq").cast("binary"))
    return spark.read.parquet(out).select("VariationID", pair.alias("pair"), "dna_fasta_path")


@query(
    "protein_fasta_trip",
    """SELECT 'ENSP' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS protein_id_norm,
      md5(regexp_replace(upper(p_name || '-' || p_type), '\\s+', '', 'g')) AS digest
    FROM part""",
)
def protein_fasta_trip(spark, folder):
    """Proteins written as FASTA with versioned ids, wrapped lines and a second record per id, of which the first counts."""
    given = S.wild_type(spark, folder)
    lines = F.regexp_replace("seq_wt", r"(.{7})", "$1\n")
    first = F.concat(F.lit(">"), "protein_id_norm", F.lit(".3 a protein\n"), lines)
    again = F.concat(F.lit("\n>"), "protein_id_norm", F.lit(".4\nXXXX"))
    out = _folder(spark)
    given.select(F.concat(first, again).alias("value")).write.text(out)
    read = fasta.read_wild_type_proteins(spark, out)
    return read.select("protein_id_norm", F.md5(F.col("seq_wt").cast("binary")).alias("digest"))


@query(
    "table_trip",
    """SELECT kind, o_orderkey AS id, o_orderstatus AS status
    FROM orders CROSS JOIN (VALUES ('csv'), ('json'), ('orc'), ('tsv')) AS v(kind)""",
)
def table_trip(spark, folder):
    """One table written in four formats, read back by the suffix of its folder."""
    given = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    out, found = _folder(spark), None
    for kind in ("csv", "json", "orc", "tsv"):
        path = f"{out}/orders.{kind}"
        text = {"header": True, "sep": "\t" if kind == "tsv" else ","} if kind in ("csv", "tsv") else {}
        given.write.format("csv" if kind == "tsv" else kind).options(**text).save(path)
        read = tables.read_table(path, spark).select(
            F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "status"
        )
        found = read if found is None else found.unionByName(read)
    return found
