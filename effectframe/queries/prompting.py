"""Prompt contexts, chat records and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectframe.functions import text
from effectframe.operators import prompts
from effectframe.queries.base import placed, query, table


def _fields(spark, folder):
    """Prompt fields of every order, some of them blank, missing or ``nan``."""
    orders, customers = placed(spark, folder, "orders", "o_custkey"), table(spark, folder, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    segment, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    return joined.select(
        "o_orderkey",
        F.when(segment == "BUILDING", " nan ").when(segment == "MACHINERY", F.lit(None)).otherwise(
            segment
        ).alias("gene_symbol"),
        F.concat(F.lit(" GENE"), "o_custkey", F.lit(" ")).alias("GeneSymbol"),
        F.when(status != "P", F.concat(F.lit("c."), "o_custkey", F.lit("A>C"))).otherwise("").alias("hgvsc"),
        F.when(status == "F", F.concat(F.lit("p.Gln"), "o_custkey", F.lit("Pro"))).alias("hgvsp"),
        F.when(status == "F", "missense_variant").when(status == "O", "stop_gained").alias(
            "most_severe_consequence"
        ),
        F.when(segment == "FURNITURE", "a_b,A_b, c ,,benign_x").otherwise("missense_variant").alias(
            "consequence_terms"
        ),
        (status == "F").cast("int").alias("_y"),
    )


_FIELDS_SQL = """
fields AS (
  SELECT o_orderkey,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'GENE' || o_custkey ELSE c_mktsegment END AS gene,
    CASE WHEN o_orderstatus <> 'P' THEN 'c.' || o_custkey || 'A>C' END AS hgvsc,
    CASE WHEN o_orderstatus = 'F' THEN 'p.Gln' || o_custkey || 'Pro' END AS hgvsp,
    CASE o_orderstatus WHEN 'F' THEN 'missense variant' WHEN 'O' THEN 'stop gained' ELSE '' END AS most,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'a b, c, benign x' ELSE 'missense variant' END AS terms,
    CASE WHEN o_orderstatus = 'F' THEN 'Pathogenic' ELSE 'Benign' END AS target,
    c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey
),
contexts AS (
  SELECT o_orderkey, target, c_mktsegment, concat_ws(chr(10), 'Gene: ' || gene, 'HGVS.c: ' || hgvsc, 'HGVS.p: ' || hgvsp,
    'Most severe consequence: ' || most,
    CASE WHEN terms <> most THEN 'Consequence terms: ' || terms END) AS ctx
  FROM fields
),
prompted AS (
  SELECT o_orderkey, target, c_mktsegment, ctx,
    'Variant context:' || chr(10) || ctx || chr(10) || chr(10) || 'Predict label:' AS prompt
  FROM contexts
)"""


@query("prompt_context", f"WITH {_FIELDS_SQL} SELECT o_orderkey, ctx, target FROM prompted")
def prompt_context(spark, folder):
    fields = _fields(spark, folder)
    return prompts.with_contexts(prompts.with_prompts(fields), {"ctx": ()}).select(
        "o_orderkey", "ctx", "target"
    )


@query(
    "prompt_stats",
    f"""WITH {_FIELDS_SQL}
    SELECT target, count(*) AS n, CAST(0 AS BIGINT) AS n_blank, CAST(min(length(prompt)) AS INTEGER) AS len_min,
      CAST(floor(quantile_cont(length(prompt), 0.5)) AS BIGINT) AS len_median,
      CAST(max(length(prompt)) AS INTEGER) AS len_max,
      count(*) FILTER (WHERE regexp_matches(prompt, '(?i)\\bc\\.[A-Za-z0-9_+\\-*>=<]+')) AS hgvsc_hits,
      count(*) FILTER (WHERE regexp_matches(prompt, '(?i)\\bp\\.[A-Za-z0-9_=*]+')) AS hgvsp_hits,
      count(*) FILTER (WHERE regexp_matches(prompt, '(?i)\\b(benign|pathogenic)\\b')) AS label_hits
    FROM prompted GROUP BY 1""",
)
def prompt_stats(spark, folder):
    return prompts.prompt_stats(prompts.with_prompts(_fields(spark, folder)), group=["target"])


@query(
    "text_stats",
    """SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') AS n_blank,
      CAST(min(length(text)) AS INTEGER) AS len_min,
      CAST(floor(quantile_cont(length(text), 0.5)) AS BIGINT) AS len_median,
      CAST(max(length(text)) AS INTEGER) AS len_max
    FROM documents GROUP BY 1""",
)
def text_stats(spark, folder):
    stats = prompts.prompt_stats(table(spark, folder, "documents"), "text", ["lang"])
    return stats.drop("hgvsc_hits", "hgvsp_hits", "label_hits")


@query(
    "prompt_blank",
    f"""WITH {_FIELDS_SQL}
    SELECT o_orderkey, concat_ws(chr(10), 'Gene: ' || gene, 'HGVS.c: ' || hgvsc,
      'Most severe consequence: ' || most,
      CASE WHEN terms <> most THEN 'Consequence terms: ' || terms END) AS without_change,
      'Most severe consequence: ' AS blank
    FROM fields""",
)
def prompt_blank(spark, folder):
    fields = _fields(spark, folder)
    both = prompts.with_contexts(
        fields, {"without_change": ["HGVSP", "hgvs.p"], "blank": prompts.prompt_columns(fields)}
    )
    return both.select("o_orderkey", "without_change", "blank")


@query(
    "notation_counts",
    """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS hgvsp_rows,
      count(*) FILTER (WHERE o_orderstatus <> 'P') AS hgvsc_rows
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def notation_counts(spark, folder):
    fields = _fields(spark, folder)
    return prompts.real_notation_counts(fields, prompts.prompt_columns(fields))


@query(
    "prompt_source_diff",
    """WITH f AS (
      SELECT o_orderkey, concat_ws(' | ',
        CASE c_mktsegment WHEN 'BUILDING' THEN ' nan ' WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END,
        ' GENE' || o_custkey || ' ',
        CASE WHEN o_orderstatus <> 'P' THEN 'c.' || o_custkey || 'A>C' ELSE '' END) AS head,
        CASE WHEN o_orderstatus = 'F' THEN 'p.Gln' || o_custkey || 'Pro' ELSE '' END AS change,
        concat_ws(' | ', CASE o_orderstatus WHEN 'F' THEN 'missense_variant' WHEN 'O' THEN 'stop_gained' ELSE '' END,
          CASE WHEN c_mktsegment = 'FURNITURE' THEN 'a_b,A_b, c ,,benign_x' ELSE 'missense_variant' END) AS tail
      FROM orders JOIN customer ON o_custkey = c_custkey
    )
    SELECT o_orderkey, substr(sha256(concat_ws(' | ', head, change, tail)), 1, 10) AS sha_before,
      substr(sha256(concat_ws(' | ', head, '', tail)), 1, 10) AS sha_after
    FROM f WHERE change <> ''""",
)
def prompt_source_diff(spark, folder):
    fields = _fields(spark, folder)
    return prompts.source_diff(fields, ["hgvsp"], "o_orderkey")


@query("sha_prefix", "SELECT doc_id, substr(sha256(text), 1, 10) AS sha FROM documents")
def sha_prefix(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", text.sha_prefix(F.col("text")).alias("sha"))


@query(
    "chat_clean",
    """SELECT conv_id, turn, md5(trim(CASE role
      WHEN 'assistant' THEN trim(text, ' ' || chr(10) || chr(9) || chr(13))
      WHEN 'system' THEN trim(text, ' ' || chr(10) || chr(9) || chr(13))
      ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END)) AS digest FROM conversations""",
)
def chat_clean(spark, folder):
    """Answers wrapped in hidden reasoning or a code fence come back bare."""
    chats = table(spark, folder, "conversations")
    role, body = F.col("role"), F.col("text")
    wrapped = (
        F.when(role == "assistant", F.concat(F.lit("<THINK>hidden\n</think> "), body, F.lit("</think>")))
        .when(role == "system", F.concat(F.lit("```json```"), body))
        .otherwise(body)
    )
    clean = text.sanitize_model_text(wrapped)
    return chats.select("conv_id", "turn", F.md5(clean.cast("binary")).alias("digest"))


@query(
    "chat_records",
    """WITH m AS (
      SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'Pathogenic' ELSE 'Benign' END AS answer
      FROM conversations
    )
    SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, 'system' AS role, NULL AS digest FROM m
    UNION ALL SELECT conv_id, turn, 1, 'user', md5(text) FROM m
    UNION ALL SELECT conv_id, turn, 2, 'assistant', md5(answer) FROM m""",
)
def chat_records(spark, folder):
    chats = table(spark, folder, "conversations")
    answer = F.when(F.col("role") == "assistant", "Pathogenic").otherwise("Benign")
    messages = prompts.chat_messages(F.col("text"), answer)
    rows = chats.select("conv_id", "turn", F.posexplode(messages).alias("pos", "m"))
    digest = F.when(F.col("pos") > 0, F.md5(F.col("m.content").cast("binary")))
    return rows.select("conv_id", "turn", "pos", "m.role", digest.alias("digest"))
