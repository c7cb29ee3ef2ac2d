"""One registered query per operator, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectframe.llm import (
    grid_join,
    hash_tree,
    mixing,
    perplexity,
    phrases,
    prefix_bpe,
    prefix_trie,
    quality,
    simhash,
    sketches,
    suffix_dedup,
    token_counts,
    warc,
)
from effectframe.queries.base import Query, Run, table
from effectframe.session import ensure_checkpoint_dir

REGISTRY: dict[str, Query] = {}


def _query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        REGISTRY[name] = Query(run, sql)
        return run

    return register


_MIX_SQL = """
WITH docs AS (
  SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), liked AS (
  SELECT *, (1024 * size) // (size + 512) AS liking FROM docs
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(liking * size) AS BIGINT) AS total_liking
  FROM liked GROUP BY source
), weighed AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3 AS whole,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS weight
  FROM totals
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(whole) OVER before, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY whole / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, total_liking, least(whole, (max(level) OVER ()) * weight) AS target FROM levels
), ratios AS (
  SELECT l.id, l.size, l.liking, t.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
         CASE WHEN t.source_size > 0 THEN CAST(t.total_liking AS DOUBLE) / t.source_size ELSE 0.0 END AS mean,
         (CAST(('0x' || substr(md5(concat_ws(':', CAST(l.id AS VARCHAR), '7')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM liked l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source
), expected AS (
  SELECT *, least(3.0::DOUBLE, greatest(0.0::DOUBLE, ratio + ratio * (1.0::DOUBLE - ratio / 3.0::DOUBLE) * ((liking - mean) / 1024.0::DOUBLE))) AS copies FROM ratios
), parts AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS part FROM expected
), ranked AS (
  SELECT *, CASE WHEN part > 0 THEN (u * (1.0::DOUBLE - part)) / (u * (1.0::DOUBLE - part) + (1.0::DOUBLE - u) * part) ELSE 1.0 END AS place FROM parts
), summed AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM ranked
)
SELECT id AS doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN part > 0 AND so_far + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""


@_query("op1_pareto_mix", _MIX_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.copies(table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def quality_model(spark: SparkSession, sf: str) -> quality.OrdinalModel:
    """The classifier fitted on the labelled documents of a folder."""
    labels = table(spark, sf, "labels")
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.fit(table(spark, sf, "documents"), ratings)


@_query("op2_ordinal_quality")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = quality.graded(docs, quality_model(spark, sf)).drop("text")
    return found.withColumn("keep", F.col("p_top") >= quality.KEEP_AT)


@_query("op3_grid_join")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = grid_join.similar_vectors(table(spark, sf, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


@_query("op4_warc_shards")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH pages2 AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM pages2 WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM pages2 p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
REGISTRY["op4_warc_shards"] = Query(op4, OP4_SQL)


@_query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf, "documents"), path).withColumnRenamed("id", "doc_id")


@_query("op6_bottom_k")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_query("op7_hash_tree")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    tree, grown = hash_tree.regular_tree(8), hash_tree.regular_tree(9)
    found = hash_tree.shard_documents(table(spark, sf, "documents"), tree, grown)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query("op8_prefix_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.encode_documents(table(spark, sf, "documents"), path).withColumnRenamed("id", "doc_id")


@_query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_query("op10_simhash_variants")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


_TRIE_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS c FROM convs
), hashed AS (
  SELECT conv_id, own, base, xor(4294967295,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c) + 1), lambda i: ascii(substr(c, i, 1))::BIGINT)),
      lambda r, byte: list_reduce(list_prepend(xor(r, byte), range(8)), lambda s, step: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))) % 4 AS h
  FROM heads
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS path
  FROM hashed a LEFT JOIN convs b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, path[1:d] AS node, len(path) = d AS ends FROM rebuilt, unnest(range(len(path) + 1)) AS t(d)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM members GROUP BY node, depth
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node
), below AS (
  SELECT node[1:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted, unnest(range(depth + 1)) AS t(d) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""


@_query("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf, "conversations"))


@_query("op12_perplexity_rules")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.quality_verdicts(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


_PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM worded, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, t.n, k, l.f AS l, r.f AS r, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c JOIN totals t ON t.lang = c.lang, unnest(range(1, c.m)) AS s(k)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a
  FROM candidates, unnest(range(2, m)) AS p(s), unnest(range(1, m - s + 2)) AS q(i)
), kept AS (
  SELECT w.* FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.a >= 100 * w.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


@_query("op13_phrase_subtrees", _PHRASES_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))
