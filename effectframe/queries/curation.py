"""Curation, splits, filters and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectframe.operators import curate, splits
from effectframe.operators.ranks import range_rank
from effectframe.queries import standins as S
from effectframe.queries.base import query, table
from effectframe.sinks import writers

_CURATED = ["VariationID", "GeneSymbol", "_y", "ChromosomeAccession", "PositionVCF"]


@query(
    "curate_labels",
    f"""WITH {S.CURATED_SQL}
    SELECT VariationID, GeneSymbol, _y, ChromosomeAccession, PositionVCF FROM curated""",
)
def curate_labels(spark, folder):
    return curate.curate_variants(S.variants(spark, folder)).select(*_CURATED)


@query(
    "majority_labels",
    f"""WITH {S.CURATED_SQL}
    SELECT GeneSymbol, CAST(round_even(avg(_y), 0) AS INTEGER) AS group_label, count(*) AS n FROM curated GROUP BY 1""",
)
def majority_labels(spark, folder):
    groups = splits.majority_label(curate.curate_variants(S.variants(spark, folder)), "GeneSymbol")
    return groups.select("GeneSymbol", "group_label", "n")


@query(
    "group_split",
    f"""WITH {S.SPLIT_SQL}
    SELECT VariationID, GeneSymbol, _y, split FROM curated JOIN assigned USING (GeneSymbol)""",
)
def group_split(spark, folder):
    split = splits.split_by_group(curate.curate_variants(S.variants(spark, folder)))
    return split.select("VariationID", "GeneSymbol", "_y", "split")


@query(
    "split_prevalence",
    f"""WITH {S.SPLIT_SQL}
    SELECT split, count(*) AS n, CAST(sum(_y) AS BIGINT) AS pos,
      CAST(sum(1 - _y) AS BIGINT) AS neg, round(avg(_y), 9) AS frac_pos
    FROM curated JOIN assigned USING (GeneSymbol) GROUP BY 1""",
)
def split_prevalence(spark, folder):
    split = splits.split_by_group(curate.curate_variants(S.variants(spark, folder)))
    return splits.split_summary(split).withColumn("frac_pos", F.round("frac_pos", 9))


@query(
    "consequence_filter",
    "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'purchase')",
)
def consequence_filter(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    return curate.filter_values(events, "event_type", ["click", "purchase"])


@query(
    "semi_slice",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def semi_slice(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    orders = table(spark, folder, "orders")
    wanted = curate.filter_values(orders, "o_orderpriority", ["1-URGENT"])
    keys = wanted.select(F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(keys, "l_orderkey", "left_semi")


@query(
    "first_rows",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def first_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "class_weights",
    """WITH c AS (SELECT quality, count(*) AS n_class FROM labels GROUP BY 1)
    SELECT quality, n_class, round((SELECT count(*) FROM labels) / (CAST(2 AS DOUBLE) * n_class), 9) AS loss_weight,
      round(CAST(1 AS DOUBLE) / n_class, 9) AS sample_weight FROM c""",
)
def class_weights(spark, folder):
    weights = splits.class_weights(table(spark, folder, "labels"), "quality")
    return weights.withColumns(
        {c: F.round(c, 9) for c in ("loss_weight", "sample_weight")}
    )


@query(
    "balanced_sample",
    """WITH members AS (
      SELECT doc_id, quality, row_number() OVER (
        PARTITION BY quality ORDER BY md5('0:member:' || doc_id), doc_id) AS idx,
        count(*) OVER (PARTITION BY quality) AS size
      FROM labels
    ),
    sizes AS (SELECT DISTINCT quality, size FROM members),
    coins AS (
      SELECT doc_id AS draw_key, ('0x' || substr(md5('0:class:' || doc_id), 1, 12))::BIGINT % 2 AS coin,
        ('0x' || substr(md5('0:row:' || doc_id), 1, 12))::BIGINT AS digits
      FROM labels
    )
    SELECT draw_key, m.doc_id, m.quality
    FROM coins JOIN sizes s ON s.quality = coin
    JOIN members m ON m.quality = coin AND m.idx = digits % s.size + 1""",
)
def balanced_sample(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return splits.balanced_sample(labels, "doc_id", "quality").select("draw_key", "doc_id", "quality")


@query(
    "chunk_ids",
    f"""WITH {S.CURATED_SQL}
    SELECT VariationID, (row_number() OVER (
      ORDER BY ChromosomeAccession, PositionVCF, VariationID) - 1) // 250 AS chunk FROM curated""",
)
def chunk_ids(spark, folder):
    curated = curate.curate_variants(S.variants(spark, folder))
    return writers.with_chunks(curated, 250).select("VariationID", "chunk")


@query(
    "dense_row_index",
    f"""SELECT {S.LINE_ID_SQL} AS line, row_number() OVER (
      ORDER BY l_shipdate, {S.LINE_ID_SQL}) AS row_index FROM lineitem""",
)
def dense_row_index(spark, folder):
    lines = table(spark, folder, "lineitem").select(S.line_id().alias("line"), "l_shipdate")
    return range_rank(lines, ["l_shipdate", "line"], "row_index").select("line", "row_index")


@query(
    "vcf_lines",
    f"""WITH {S.CURATED_SQL}
    SELECT ChromosomeAccession AS contig, PositionVCF AS position, CAST(VariationID AS VARCHAR) AS id,
      concat_ws(chr(9), ChromosomeAccession, PositionVCF, VariationID, upper(ReferenceAlleleVCF),
        upper(AlternateAlleleVCF), '.', '.', '.') AS line FROM curated""",
)
def vcf_lines(spark, folder):
    return writers.vcf_lines(curate.curate_variants(S.variants(spark, folder)))
