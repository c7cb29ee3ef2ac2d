"""Domain-shaped tables which Spark derives from the given tables.

The test tables hold no genomes. Orders stand in for variants, order lines for
transcripts and loci, parts for proteins and ontology terms, documents for contigs.
Every row of the tables used takes part. The SQL fragments describe the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectframe.constants import REVIEW_STATUS
from effectframe.functions.text import sanitize_dna
from effectframe.queries.base import placed, table
from effectframe.schemas import TRANSCRIPT_SCHEMA


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """One raw variant per order, in the shape of a variant summary."""
    orders, customers = placed(spark, folder, "orders", "o_custkey"), table(spark, folder, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    segment, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    gene = F.concat(F.lit("GENE"), F.col("c_custkey"))
    named = segment.isin("BUILDING", "MACHINERY", "HOUSEHOLD")
    position = F.when(F.col("o_totalprice") < 20000, -1).otherwise(
        F.floor("o_totalprice").cast("long")
    )
    base = F.substring(F.lit("ACGT"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1))
    other = F.substring(F.lit("TGAC"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1))
    null = F.lit(None).cast("string")
    return joined.select(
        F.col("o_orderkey").alias("VariationID"),
        F.when(named, F.concat(F.lit("NM_"), "o_orderkey", F.lit(".1("), gene, F.lit("):c.1A>G")))
        .otherwise(F.col("c_name"))
        .alias("Name"),
        F.when(segment == "FURNITURE", F.concat(F.lit(" "), gene, F.lit(";OTHER")))
        .otherwise("covers 12 genes, none of which curated")
        .alias("GeneSymbol"),
        F.when(status == "F", " Likely pathogenic")
        .when(status == "O", "Benign/Likely benign")
        .otherwise("Uncertain significance")
        .alias("ClinicalSignificance"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "no assertion criteria provided")
        .otherwise(REVIEW_STATUS)
        .alias("ReviewStatus"),
        F.when(F.col("c_nationkey") == 0, "GRCh37").otherwise("GRCh38").alias("Assembly"),
        F.col("c_nationkey").cast("string").alias("Chromosome"),
        F.when(F.col("c_nationkey") != 1, F.concat(F.lit("NC_"), "c_nationkey", F.lit(".1"))).alias(
            "ChromosomeAccession"
        ),
        position.alias("PositionVCF"),
        base.alias("ReferenceAlleleVCF"),
        other.alias("AlternateAlleleVCF"),
        position.alias("Start"),
        position.alias("Stop"),
        base.alias("ReferenceAllele"),
        other.alias("AlternateAllele"),
        null.alias("PhenotypeIDS"),
        segment.alias("PhenotypeList"),
    )


CURATED_SQL = """
raw AS (
  SELECT o_orderkey AS VariationID,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
      THEN 'NM_' || o_orderkey || '.1(GENE' || c_custkey || '):c.1A>G' ELSE c_name END AS Name,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN ' GENE' || c_custkey || ';OTHER'
      ELSE 'covers 12 genes, none of which curated' END AS RawGene,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS _y,
    CASE WHEN c_nationkey <> 1 THEN 'NC_' || c_nationkey || '.1' END AS ChromosomeAccession,
    CASE WHEN o_totalprice < 20000 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS PositionVCF,
    substr('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS ReferenceAlleleVCF,
    substr('TGAC', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS AlternateAlleleVCF
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority <> '1-URGENT' AND c_nationkey <> 0
),
curated AS (
  SELECT VariationID, _y, ChromosomeAccession, PositionVCF, ReferenceAlleleVCF, AlternateAlleleVCF,
    CASE WHEN regexp_extract(Name, '\\(([A-Za-z0-9\\-]+)\\)\\s*:', 1) <> ''
      THEN regexp_extract(Name, '\\(([A-Za-z0-9\\-]+)\\)\\s*:', 1)
      WHEN RawGene LIKE 'covers%' THEN ''
      ELSE split_part(trim(RawGene), ';', 1) END AS GeneSymbol
  FROM raw
  WHERE ChromosomeAccession IS NOT NULL AND PositionVCF > 0 AND _y IS NOT NULL
)"""


def assigned_sql(source: str) -> str:
    """``assigned(GeneSymbol, split)`` of the variants in ``source``."""
    return f"""genes AS (
  SELECT GeneSymbol, CAST(round_even(avg(_y), 0) AS INTEGER) AS cls FROM {source} GROUP BY 1
),
ranked AS (
  SELECT GeneSymbol, cls,
    row_number() OVER (PARTITION BY cls ORDER BY md5('42:' || GeneSymbol), GeneSymbol) AS r,
    count(*) OVER (PARTITION BY cls) AS n
  FROM genes
),
assigned AS (
  SELECT GeneSymbol, CASE
    WHEN r <= round_even(CAST(0.1 AS DOUBLE) * n, 0) THEN 'test'
    WHEN r <= 2 * round_even(CAST(0.1 AS DOUBLE) * n, 0) THEN 'val' ELSE 'train' END AS split
  FROM ranked
)"""


SPLIT_SQL = f"{CURATED_SQL},\n{assigned_sql('curated')}"


def line_id():
    """A key of the order lines, which have none of their own."""
    quantity = F.col("l_quantity").cast("long")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity)


LINE_ID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))"


def protein_id(key: str | Column):
    number = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("ENSP"), F.lpad(number.cast("string"), 11, "0"), F.lit(".2"))


def consequences(spark: SparkSession, folder: str) -> DataFrame:
    """One nested record per order; its lines are the transcripts, in a fixed order."""
    orders, lines = placed(spark, folder, "orders", "o_orderkey"), placed(spark, folder, "lineitem", "l_orderkey")
    # An order has a handful of lines; the list is as long as that. Its transcripts, many times
    # as wide as the lines, are made behind the shuffle and the sort.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    per_order = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ts"))
    most = F.when(F.col("o_orderstatus") == "F", "missense_variant").when(
        F.col("o_orderstatus") == "O", "synonymous_variant"
    )
    return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        most.alias("most_severe_consequence"),
        F.lit("GRCh38").alias("assembly_name"),
        F.col("o_orderpriority").alias("allele_string"),
        F.transform("ts", lambda t: _transcript(t, F.col("l_orderkey"))).alias("transcript_consequences"),
    )


def _transcript(line: Column, order: Column) -> Column:
    """The transcript of an order line, in the reader's full schema; fields which are not given are null."""
    flag, kind, number = line["l_returnflag"], line["l_linestatus"], line["l_linenumber"]
    protein = F.when(flag != "R", protein_id(line["l_partkey"]))
    null = F.lit(None).cast("string")
    given = {
        "gene_symbol": F.concat(F.lit("S"), line["l_suppkey"]),
        "gene_symbol_source": F.lit("HGNC"),
        "transcript_id": F.concat(F.lit("ENST"), order),
        "mane_select": F.when(kind == "F", "NM_1"),
        "impact": F.when(kind == "F", "HIGH").otherwise(""),
        "consequence_terms": F.array(
            F.lit("missense_variant"), F.lit(""), null, F.concat(F.lit("term_"), flag)
        ),
        "hgvsc": F.concat(F.lit("ENST"), order, F.lit(":c."), line["l_suppkey"], F.lit("A>G")),
        "hgvsp": F.when(
            (flag != "R") & (kind == "F"), F.concat(protein, F.lit(":p.Arg"), number, F.lit("Gly"))
        ),
        "protein_id": protein,
        "protein_start": number.cast("long"),
        "swissprot": F.array(null, F.lit("")),
    }
    return F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSCRIPT_SCHEMA.fields]
    )


FLAT_SQL = """
firsts AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
),
flat AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderstatus WHEN 'F' THEN 'missense_variant' WHEN 'O' THEN 'synonymous_variant' END
      AS most_severe_consequence,
    o_orderpriority AS allele_string,
    'S' || l_suppkey AS gene_symbol,
    CASE WHEN l_linestatus = 'F' THEN 'NM_1' END AS mane_select,
    CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_linestatus = 'F' THEN 'HIGH' ELSE '' END AS impact,
    'missense_variant,term_' || l_returnflag AS consequence_terms,
    'c.' || l_suppkey || 'A>G' AS hgvsc,
    CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN 'p.Arg' || l_linenumber || 'Gly' END AS hgvsp,
    CASE WHEN l_returnflag <> 'R' THEN 'ENSP' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') || '.2' END
      AS protein_id,
    CAST(l_linenumber AS BIGINT) AS protein_start
  FROM orders LEFT JOIN firsts ON l_orderkey = o_orderkey
)"""


def wild_type(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.concat(F.lit("ENSP"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias(
            "protein_id_norm"
        ),
        F.upper(F.concat_ws("-", "p_name", "p_type")).alias("seq_wt"),
    )


def mutant(spark: SparkSession, folder: str) -> DataFrame:
    """Mutant records by (part, line number); a missing change stands for no change."""
    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    seen = lines.select(
        "l_partkey", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("num")
    ).distinct()
    return seen.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("ENSP"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias(
            "protein_id_norm"
        ),
        F.concat(F.lit("p.Arg"), F.col("num"), F.lit("Gly")).alias("hgvsp_norm"),
        F.concat(F.upper("p_name"), F.coalesce(F.col("num").cast("string"), F.lit("*"))).alias("seq_mt"),
    )


JOINED_SQL = FLAT_SQL + """,
wt AS (
  SELECT 'ENSP' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS pid, upper(p_name || '-' || p_type) AS seq_wt
  FROM part
),
mt AS (
  SELECT DISTINCT 'ENSP' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS pid,
    CASE WHEN l_linenumber > 1 THEN 'p.Arg' || l_linenumber || 'Gly' END AS pdot,
    upper(p_name) || CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) ELSE '*' END AS seq_mt
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
joined AS (
  SELECT flat.*, wt.seq_wt, mt.seq_mt
  FROM flat
  LEFT JOIN wt ON wt.pid = regexp_extract(protein_id, '^(ENSP\\d+)', 1)
  LEFT JOIN mt ON mt.pid IS NOT DISTINCT FROM nullif(regexp_extract(protein_id, '^(ENSP\\d+)', 1), '')
    AND mt.pdot IS NOT DISTINCT FROM hgvsp
)"""


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts as contigs over A, C, G, T, N."""
    docs = placed(spark, folder, "documents", "doc_id")
    return docs.select(
        F.concat(F.lit("doc"), "doc_id").alias("contig"), sanitize_dna(F.col("text")).alias("seq")
    )


LINE = 60


def contig_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The contigs as sequence lines with their starts, as a FASTA reader gives them."""
    lines = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{LINE}}}"), F.lit(0))
    cut = contigs(spark, folder).select("contig", F.posexplode(lines).alias("k", "bases"))
    return cut.select("contig", (F.col("k").cast("long") * LINE).alias("start"), "bases")


#: Documents up to which their numbers of letters go to every task: 16 bytes each.
FEW_DOCUMENTS = 1_000_000


def loci(spark: SparkSession, folder: str) -> DataFrame:
    """One variant per order line on the contig of its part number, anywhere on it; some lack a position or an allele. Counts the documents."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("l_partkey"), "n_chars")
    # The lines stay where they are, unless there are too many documents for that.
    docs = F.broadcast(docs) if docs.count() <= FEW_DOCUMENTS else docs
    lines = table(spark, folder, "lineitem").join(docs, "l_partkey", "left")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    ref = F.when(flag == "A", "a").when(flag == "N", "N").otherwise("NN")
    ref = F.when(number == 7, F.repeat(F.lit("N"), 3)).otherwise(ref)
    span = F.greatest(F.coalesce("n_chars", F.lit(3000)), F.lit(1))
    place = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_suppkey") * 13, span) + 1
    alt = F.element_at(F.array(*[F.lit(a) for a in ("C", "g", "T", "AC", "GTT", "A", "")]), number)
    order = F.col("l_orderkey")
    return lines.select(
        line_id().alias("VariationID"),
        "l_returnflag",
        F.concat(F.lit("doc"), "l_partkey").alias("ChromosomeAccession"),
        F.when(order % 97 != 0, place).alias("PositionVCF"),
        F.when(order % 89 != 1, ref).alias("ReferenceAlleleVCF"),
        F.when(order % 83 != 2, alt).alias("AlternateAlleleVCF"),
    )


WINDOW = 20
BIN = 64
WINDOWS_SQL = f"""
contigs AS (
  SELECT 'doc' || doc_id AS contig, upper(regexp_replace(text, '[^ACGTNacgtn]', 'N', 'g')) AS seq
  FROM documents
),
loci AS (
  SELECT {LINE_ID_SQL} AS VariationID, l_returnflag, 'doc' || l_partkey AS contig,
    CASE WHEN l_orderkey % 97 <> 0 THEN (l_orderkey * 7919 + l_suppkey * 13) % greatest(coalesce(n_chars, 3000), 1) + 1 END AS pos,
    CASE WHEN l_orderkey % 89 = 1 THEN NULL WHEN l_linenumber = 7 THEN 'NNN' WHEN l_returnflag = 'A' THEN 'A'
      WHEN l_returnflag = 'N' THEN 'N' ELSE 'NN' END AS ref,
    CASE WHEN l_orderkey % 83 <> 2 THEN ['C', 'G', 'T', 'AC', 'GTT', 'A', ''][l_linenumber] END AS alt
  FROM lineitem LEFT JOIN documents ON doc_id = l_partkey
),
cut AS (
  SELECT loci.*, c.contig IS NULL AS lost, length(c.seq) AS len,
    greatest(1, pos - {WINDOW}) AS win_start, pos + length(ref) - 1 + {WINDOW} AS win_end,
    substr(c.seq, greatest(1, pos - {WINDOW}), pos + length(ref) + {WINDOW} - greatest(1, pos - {WINDOW}))
      AS slice
  FROM loci LEFT JOIN contigs c ON c.contig = loci.contig
),
checked AS (
  SELECT *, pos - win_start AS rel,
    coalesce(substr(slice, pos - win_start + 1, length(ref)) = ref, false) AND alt IS NOT NULL AND pos IS NOT NULL AS ok
  FROM cut
),
windows AS (
  SELECT VariationID, l_returnflag, slice AS ref_seq,
    substr(slice, 1, rel) || alt || substr(slice, rel + length(ref) + 1) AS alt_seq,
    win_start, win_end
  FROM checked WHERE ok
)"""


def graph_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(term edges, gene edges): parts below their brand, suppliers with their parts."""
    part, lines = table(spark, folder, "part"), table(spark, folder, "lineitem")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    terms = part.select(
        F.concat(F.lit("P"), "p_partkey").alias("child"), F.concat(F.lit("B"), brand).alias("parent")
    )
    genes = lines.select(
        F.concat(F.lit("S"), "l_suppkey").alias("gene"), F.concat(F.lit("P"), "l_partkey").alias("term")
    )
    return terms, genes


EDGES_SQL = """
edges AS (
  SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT 'G::S' || l_suppkey AS a, 'T::P' || l_partkey AS b FROM lineitem
    UNION ALL
    SELECT 'T::P' || p_partkey, 'T::B' || regexp_extract(p_brand, '(\\d+)', 1) FROM part)
),
ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges),
degree AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score which has many ties."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    share = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        F.col("quality").alias("y"),
        (F.floor(share * 50.0) / 50.0).alias("prob"),
    )


SCORED_SQL = """
scored AS (
  SELECT doc_id, lang, quality AS y,
    floor(n_chars / (n_chars + CAST(1000 AS DOUBLE)) * 50) / 50 AS prob
  FROM documents JOIN labels USING (doc_id)
)"""
