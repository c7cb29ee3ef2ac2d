"""Nested consequences, protein joins, merge-back, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectframe.functions import text
from effectframe.operators import annotate, audit, curate, joins
from effectframe.queries import standins as S
from effectframe.queries.base import query, table
from effectframe.sources.tables import json_rows

_FLAT = [
    "id", "most_severe_consequence", "allele_string", "gene_symbol", "mane_select", "impact",
    "consequence_terms", "hgvsc", "hgvsp", "protein_id", "protein_start",
]
_FLAT_LIST = ", ".join(_FLAT)


@query("json_flatten", f"WITH {S.FLAT_SQL} SELECT {_FLAT_LIST}, CAST(NULL AS VARCHAR) AS swissprot FROM flat")
def json_flatten(spark, folder):
    lines = S.consequences(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
    records = annotate.parse_consequences(lines)
    return annotate.flatten_consequences(records).select(*_FLAT, "swissprot")


@query(
    "props_json",
    """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def props_json(spark, folder):
    events = table(spark, folder, "events")
    parsed = F.from_json("props", "k bigint")
    return events.select("event_id", "event_type", parsed["k"].alias("k"))


@query(
    "protein_id_parts",
    """SELECT p_partkey, 'ENSP' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS protein,
      'p.' || replace(p_name, ' ', '') AS change, p_name AS bare, p_type || ':x' AS tail FROM part""",
)
def protein_id_parts(spark, folder):
    part = table(spark, folder, "part")
    full = F.concat(S.protein_id("p_partkey"), F.lit(":p."), F.replace("p_name", F.lit(" "), F.lit("")))
    noted = F.concat(full, F.lit(" extra|more"))
    return part.select(
        "p_partkey",
        text.strip_protein_version(full).alias("protein"),
        text.protein_change(noted).alias("change"),
        text.strip_reference_prefix(F.col("p_name")).alias("bare"),
        text.strip_reference_prefix(F.concat(F.col("p_brand"), F.lit(":"), "p_type", F.lit(":x"))).alias(
            "tail"
        ),
    )


@query("seq_annotation_join", f"WITH {S.JOINED_SQL} SELECT {_FLAT_LIST}, seq_wt, seq_mt FROM joined")
def seq_annotation_join(spark, folder):
    flat = annotate.flatten_consequences(S.consequences(spark, folder))
    joined = annotate.join_proteins(flat, S.wild_type(spark, folder), S.mutant(spark, folder))
    return joined.select(*_FLAT, "seq_wt", "seq_mt")


@query(
    "merge_back",
    f"""WITH {S.CURATED_SQL}, {S.JOINED_SQL.lstrip()}
    SELECT VariationID, _y, GeneSymbol, hgvsc, hgvsp, most_severe_consequence, impact, gene_symbol,
      protein_id, protein_start
    FROM curated LEFT JOIN joined ON id = CAST(VariationID AS VARCHAR)""",
)
def merge_back(spark, folder):
    curated = curate.curate_variants(S.variants(spark, folder))
    annotated, _ = annotate.annotate_variants(
        curated, S.consequences(spark, folder), S.wild_type(spark, folder), S.mutant(spark, folder)
    )
    return annotated.select(
        "VariationID", "_y", "GeneSymbol", "hgvsc", "hgvsp", "most_severe_consequence", "impact",
        "gene_symbol", "protein_id", "protein_start",
    )


@query(
    "protein_pairs",
    f"""WITH {S.JOINED_SQL},
    clean AS (
      SELECT id, protein_id, hgvsp, consequence_terms,
        regexp_replace(replace(seq_wt, '-', ''), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS seq_wt,
        regexp_replace(replace(seq_mt, '-', ''), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS seq_mt
      FROM joined WHERE seq_wt IS NOT NULL AND seq_mt IS NOT NULL
    )
    SELECT * FROM clean WHERE seq_wt <> '' AND seq_mt <> ''""",
)
def protein_pairs(spark, folder):
    flat = annotate.flatten_consequences(S.consequences(spark, folder))
    joined = annotate.join_proteins(flat, S.wild_type(spark, folder), S.mutant(spark, folder))
    return annotate.protein_pairs(joined)


@query(
    "first_annotation",
    """SELECT l_orderkey, l_shipdate_text, l_partkey, l_suppkey FROM (
      SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text, l_partkey, l_suppkey,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def first_annotation(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_text"),
        "l_partkey",
        "l_suppkey",
    )
    return joins.first_per_key(lines, ["l_orderkey"], ["l_shipdate_text", "l_partkey", "l_suppkey"])


@query(
    "suffixed_join",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, s_name AS name_vep, s_acctbal
    FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def suffixed_join(spark, folder):
    left = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")
    )
    right = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "s_acctbal"
    )
    return joins.left_join_suffixed(left, right, ["id"], "_vep")


@query(
    "annotation_report",
    f"""WITH {S.JOINED_SQL}
    SELECT most_severe_consequence, count(*) AS n,
      round(avg(CASE WHEN coalesce(trim(hgvsc), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_hgvsc,
      round(avg(CASE WHEN coalesce(trim(hgvsp), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_hgvsp,
      round(avg(CASE WHEN coalesce(trim(mane_select), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_mane_select,
      round(100 - avg(CASE WHEN coalesce(trim(seq_wt), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_seq_wt_missing,
      round(100 - avg(CASE WHEN coalesce(trim(seq_mt), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_seq_mt_missing
    FROM joined GROUP BY 1""",
)
def annotation_report(spark, folder):
    flat = annotate.flatten_consequences(S.consequences(spark, folder))
    joined = annotate.join_proteins(flat, S.wild_type(spark, folder), S.mutant(spark, folder))
    report = audit.annotation_report(joined, ["most_severe_consequence"])
    return report.withColumns({c: F.round(c, 6) for c in report.columns if c.startswith("pct_")})


@query(
    "completeness",
    """SELECT lang, count(*) AS n,
      round(avg(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_text,
      round(avg(CASE WHEN coalesce(CAST(quality AS VARCHAR), '') <> '' THEN 1.0 ELSE 0 END) * 100, 6) AS pct_quality
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def completeness(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    report = audit.completeness(docs, ["text", "quality"], ["lang"])
    return report.withColumns({c: F.round(c, 6) for c in ("pct_text", "pct_quality")})


@query(
    "top_values",
    f"""WITH {S.FLAT_SQL}
    SELECT CASE WHEN coalesce(trim(consequence_terms), '') = '' THEN 'missing'
      ELSE replace(trim(consequence_terms), '_', ' ') END AS value, count(*) AS n
    FROM flat GROUP BY 1 ORDER BY n DESC, value LIMIT 5""",
)
def top_values(spark, folder):
    flat = annotate.flatten_consequences(S.consequences(spark, folder))
    return audit.top_values(flat, "consequence_terms")


@query(
    "json_quarantine",
    """SELECT event_type, count_if(event_id % 10 > 2) AS n_records, count_if(event_id % 10 <= 2) AS n_broken,
      sum(CASE WHEN event_id % 10 > 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END)::BIGINT AS k_sum
    FROM events WHERE event_id % 10 <> 9 GROUP BY 1""",
)
def json_quarantine(spark, folder):
    """Lines of which some are cut short, no object, or of a wrong type; others are blank: sums of both outputs."""
    kind = F.col("event_id") % 10
    line = (
        F.when(kind == 0, F.expr("substring(props, 1, length(props) - 1)"))
        .when(kind == 1, F.lit("no JSON at all"))
        .when(kind == 2, F.lit('{"k": "seven", "type": "x"}'))
        .when(kind == 9, F.lit("  "))
        .otherwise(F.concat(F.lit('{"type": "'), "event_type", F.lit('", '), F.substr("props", F.lit(2))))
    )
    lines = table(spark, folder, "events").select("event_type", line.alias("value"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("type", T.StringType())])
    records, broken = json_rows(lines, schema)
    zero = F.lit(0).cast("long")
    both = records.select(F.col("type").alias("event_type"), F.lit(1).alias("good"), F.col("k")).unionByName(
        broken.select("event_type", F.lit(0).alias("good"), zero.alias("k"))
    )
    return both.groupBy("event_type").agg(
        F.count_if(F.col("good") == 1).alias("n_records"), F.count_if(F.col("good") == 0).alias("n_broken"), F.sum("k").alias("k_sum")
    )


@query(
    "split_slices",
    """WITH variants AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split FROM lineitem)
    SELECT split, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders o
    JOIN (SELECT DISTINCT id, split FROM variants) v ON v.id = o.o_orderkey GROUP BY 1""",
)
def split_slices(spark, folder):
    """Annotation slices of variants which stand on several rows, in several splits: rows are not multiplied."""
    turn = F.col("l_linenumber") % 3
    split = F.when(turn == 0, "test").when(turn == 1, "train").otherwise("val")
    variants = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("VariationID"), split.alias("split"))
    combined = table(spark, folder, "orders").select(F.col("o_orderkey").alias("VariationID"), "o_custkey")
    slices = annotate.split_slices(combined, variants)
    return slices.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))
