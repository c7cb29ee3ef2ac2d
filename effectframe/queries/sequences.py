"""Windows, distinct sequences, encoders and effect vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from effectframe.functions import text, vectors
from effectframe.operators import audit, batches, sequences, windows
from effectframe.queries import standins as S
from effectframe.queries.base import placed, query, table
from effectframe.session import cut_lineage, ensure_checkpoint_dir

_CODES = 8
_SORTED = 250_000


def _windows(spark, folder):
    """Windows of all loci; the bins are a stored table, as for a real reference."""
    bins = cut_lineage(windows.bins_from_pieces(S.contig_pieces(spark, folder), S.BIN, S.BIN // 2))
    found = windows.variant_windows(
        S.loci(spark, folder), bins, S.WINDOW, bin_size=S.BIN, halo=S.BIN // 2
    )
    return found, bins


@query(
    "reference_bins",
    f"""WITH {S.WINDOWS_SQL}
    SELECT contig, CAST(b AS BIGINT) AS bin, substr(seq, CAST(b * {S.BIN} + 1 AS BIGINT), {S.BIN + S.BIN // 2}) AS bases
    FROM contigs, unnest(range((length(seq) + {S.BIN - 1}) // {S.BIN})) AS u(b)""",
)
def reference_bins(spark, folder):
    return windows.bins_from_pieces(S.contig_pieces(spark, folder), S.BIN, S.BIN // 2)


@query(
    "variant_windows",
    f"WITH {S.WINDOWS_SQL} SELECT VariationID, ref_seq, alt_seq, win_start, win_end FROM windows",
)
def variant_windows(spark, folder):
    found, _ = _windows(spark, folder)
    return windows.kept_windows(found).select(
        "VariationID",
        F.col("dna_ref_seq").alias("ref_seq"),
        F.col("dna_alt_seq").alias("alt_seq"),
        F.col("dna_window_start").alias("win_start"),
        F.col("dna_window_end").alias("win_end"),
    )


@query(
    "window_rejects",
    f"""WITH {S.WINDOWS_SQL}
    SELECT VariationID, CASE WHEN lost THEN 'contig missing' WHEN pos IS NULL THEN 'no position'
      WHEN ref IS NULL THEN 'no reference allele' WHEN alt IS NULL THEN 'no alternate allele'
      WHEN win_start > (len + {S.BIN - 1}) // {S.BIN} * {S.BIN} THEN 'position outside contig'
      ELSE 'reference mismatch' END AS reject_reason
    FROM checked WHERE NOT ok""",
)
def window_rejects(spark, folder):
    found, bins = _windows(spark, folder)
    return windows.rejected_variants(found, bins).select("VariationID", "reject_reason")


@query(
    "window_rows",
    """SELECT 'kept or rejected' AS kind, count(*) AS n FROM lineitem
    UNION ALL SELECT 'loci', count(*) FROM lineitem
    UNION ALL SELECT 'without position or allele', count(*) FROM lineitem
      WHERE l_orderkey % 97 = 0 OR l_orderkey % 89 = 1 OR l_orderkey % 83 = 2""",
)
def window_rows(spark, folder):
    """No locus is lost or doubled between windows and rejects."""
    found, bins = _windows(spark, folder)
    # Windows are cut once for what is kept and what is rejected.
    found = cut_lineage(found.select("VariationID", "ChromosomeAccession", "reject_reason"))
    given = S.loci(spark, folder)
    out = windows.kept_windows(found).select("VariationID").unionByName(
        windows.rejected_variants(found, bins).select("VariationID")
    )
    # Partitions by the number of loci: as many as a task sorts without spilling.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // _SORTED))
    met = given.select("VariationID").repartition(partitions, "VariationID").join(out.repartition(partitions, "VariationID"), "VariationID")
    lacking = given.filter("PositionVCF is null or ReferenceAlleleVCF is null or AlternateAlleleVCF is null")
    kinds = {"loci": given, "kept or rejected": met, "without position or allele": lacking}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "stage_audit",
    f"""WITH {S.WINDOWS_SQL}
    SELECT l_returnflag, 'dna_input_rows' AS stage, count(*) AS n FROM loci GROUP BY 1
    UNION ALL SELECT l_returnflag, 'dna_rows', count(*) FROM windows GROUP BY 1""",
)
def stage_audit(spark, folder):
    found, _ = _windows(spark, folder)
    kept = windows.kept_windows(found)
    return audit.stage_counts({"dna_input_rows": found, "dna_rows": kept}, "l_returnflag")


@query(
    "stage_ledger",
    f"""WITH {S.WINDOWS_SQL}
    SELECT l_returnflag, 'dna_input_rows' AS stage, count(*) AS n FROM loci GROUP BY 1
    UNION ALL SELECT l_returnflag, 'dna_rows', count(*) FROM windows GROUP BY 1""",
)
def stage_ledger(spark, folder):
    """The counts of ``stage_audit``, taken while the windows are written."""
    found, _ = _windows(spark, folder)
    ledger = audit.StageLedger(spark, ("A", "N", "R"), "l_returnflag")
    kept = ledger.watch(windows.kept_windows(ledger.watch(found, "dna_input_rows")), "dna_rows")
    kept.write.parquet(f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return ledger.table()


_LIMIT, _OVERLAP, _BUDGET = 500, 50, 12_000


@query(
    "sequence_batches",
    f"""WITH texts AS (SELECT DISTINCT sha256(text) AS seq_id, text AS seq FROM documents),
    starts AS (
      SELECT seq_id, CAST(k AS INTEGER) AS piece, seq,
        substr(seq, CAST(k * {_LIMIT - _OVERLAP} + 1 AS BIGINT), {_LIMIT}) AS part
      FROM texts, unnest(range(length(seq) // {_LIMIT - _OVERLAP} + 1)) AS u(k)
    ),
    parts AS (
      SELECT seq_id, piece, greatest(length(part), 1) AS cost FROM starts
      WHERE piece = 0 OR (length(seq) > {_LIMIT} AND length(part) > {_OVERLAP})
    ),
    summed AS (
      SELECT *, CAST(sum(cost) OVER (ORDER BY cost, seq_id, piece) AS BIGINT) AS through,
        CAST(sum(cost) OVER () AS BIGINT) AS total FROM parts
    ),
    dealt AS (
      SELECT *, (total + {_BUDGET} - 1) // {_BUDGET} AS batches FROM summed
    )
    SELECT least((2 * through - cost) * batches // (2 * total), batches - 1) AS batch, count(*) AS pieces,
      CAST(sum(cost) AS BIGINT) AS letters, max(cost) AS longest, min(cost) AS shortest
    FROM dealt GROUP BY 1""",
)
def sequence_batches(spark, folder):
    """Whole texts in pieces, dealt into batches of even cost."""
    docs = sequences.distinct_sequences(table(spark, folder, "documents"), ["text"])
    dealt = batches.batched(batches.pieces(docs, _LIMIT, _OVERLAP), _BUDGET, _LIMIT)
    cost = F.greatest(F.length("seq"), F.lit(1)).cast("long")
    return dealt.groupBy("batch").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(cost).alias("letters"),
        F.max(cost).alias("longest"), F.min(cost).alias("shortest"),
    )


@query(
    "sequence_effects",
    f"""WITH {S.WINDOWS_SQL},
    texts AS (SELECT ref_seq AS seq FROM windows UNION SELECT alt_seq FROM windows),
    tokens AS (
      SELECT seq, substr(seq, CAST(i AS BIGINT), 3) AS token
      FROM texts, unnest(range(1, greatest(length(seq) - 2, 1) + 1)) AS u(i)
    ),
    slots AS (
      SELECT seq, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % {_CODES} AS INTEGER) AS slot, count(*) AS n
      FROM tokens GROUP BY 1, 2
    ),
    sizes AS (SELECT seq, sum(n) AS total FROM slots GROUP BY 1),
    dense AS (
      SELECT s.seq, CAST(d AS INTEGER) AS dim, CAST(coalesce(n, 0) / CAST(total AS DOUBLE) AS FLOAT) AS x
      FROM sizes s CROSS JOIN unnest(range({_CODES})) AS u(d)
      LEFT JOIN slots t ON t.seq = s.seq AND t.slot = d
    ),
    diffs AS (
      SELECT VariationID, l_returnflag, r.dim, a.x - r.x AS x
      FROM windows JOIN dense r ON r.seq = ref_seq JOIN dense a ON a.seq = alt_seq AND a.dim = r.dim
    ),
    norms AS (
      SELECT VariationID, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) + 1e-8 AS norm FROM diffs GROUP BY 1
    ),
    unit AS (
      SELECT l_returnflag, dim, CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS x FROM diffs JOIN norms USING (VariationID)
    )
    SELECT l_returnflag, dim, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 5) AS mean_effect
    FROM unit GROUP BY 1, 2""",
)
def sequence_effects(spark, folder):
    """Windows, one encoding per distinct sequence, unit effect vectors, summary per class."""
    found, _ = _windows(spark, folder)
    pairs = cut_lineage(
        windows.kept_windows(found).select("l_returnflag", "dna_ref_seq", "dna_alt_seq")
    )
    effects = sequences.effect_vectors(
        pairs, "dna_ref_seq", "dna_alt_seq", sequences.kmer_encoder(3, _CODES)
    )
    dims = effects.select("l_returnflag", F.posexplode("vec").alias("dim", "x"))
    return dims.groupBy("l_returnflag", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 5).alias("mean_effect")
    )


@query(
    "seq_dedup",
    "SELECT md5(text) AS digest, min(doc_id) AS first_key, count(*) AS n_rows FROM documents GROUP BY text",
)
def seq_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    first = sequences.first_occurrence(docs, "doc_id", "text")
    return first.select(F.md5(F.col("text").cast("binary")).alias("digest"), "first_key", "n_rows")


@query(
    "kmer_embed",
    """WITH texts AS (SELECT DISTINCT text AS seq FROM documents),
    tokens AS (
      SELECT seq, substr(seq, CAST(i AS BIGINT), 4) AS token
      FROM texts, unnest(range(1, greatest(length(seq) - 3, 1) + 1)) AS u(i)
    ),
    slots AS (
      SELECT seq, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 16 AS INTEGER) AS dim, count(*) AS n
      FROM tokens GROUP BY 1, 2
    )
    SELECT sha256(seq) AS digest, dim, round(CAST(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY seq) AS FLOAT)::DOUBLE, 6) AS x
    FROM slots""",
)
def kmer_embed(spark, folder):
    docs = sequences.distinct_sequences(table(spark, folder, "documents"), ["text"])
    encoded = sequences.kmer_encoder(4, 16)(docs)
    dims = encoded.select(F.col("seq_id").alias("digest"), F.posexplode("vec").alias("dim", "x"))
    return dims.filter(F.col("x") > 0).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(
    "token_pooling",
    """WITH tokens AS (
      SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token FROM conversations
    ),
    dims AS (
      SELECT conv_id, turn, d AS dim,
        avg(CAST(('0x' || substr(md5(token), CAST(d * 4 + 1 AS BIGINT), 4))::BIGINT AS DOUBLE)) AS x
      FROM tokens, unnest(range(4)) AS u(d) GROUP BY 1, 2, 3
    )
    SELECT conv_id || '-' || turn AS key, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3) AS x FROM dims""",
)
def token_pooling(spark, folder):
    chats = placed(spark, folder, "conversations", "conv_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"),
        F.posexplode(F.split("text", " ")).alias("pos", "token"),
    )
    digest = F.md5(F.col("token").cast("binary"))
    codes = [F.conv(F.substring(digest, 4 * d + 1, 4), 16, 10).cast("float") for d in range(4)]
    table_of_tokens = chats.select("token").distinct().select("token", F.array(*codes).alias("vec"))
    pooled = sequences.pool_tokens(chats, table_of_tokens, "key")
    dims = pooled.select("key", F.posexplode("vec").alias("dim", "x"))
    return dims.withColumn("x", F.round(F.col("x").cast("double"), 3))


@query(
    "sanitize",
    """SELECT doc_id, md5(upper(regexp_replace(text, '[^ACGTNacgtn]', 'N', 'g'))) AS dna,
      md5(upper(regexp_replace(replace(text, '-', ''), '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', 'X', 'g'))) AS protein
    FROM documents""",
)
def sanitize(spark, folder):
    docs = placed(spark, folder, "documents", "doc_id")
    return docs.select(
        "doc_id",
        F.md5(text.sanitize_dna(F.col("text")).cast("binary")).alias("dna"),
        F.md5(text.sanitize_protein(F.col("text")).cast("binary")).alias("protein"),
    )


_PAIR_DIMS_SQL = """
dims AS (
  SELECT a.vec_id, CAST(i - 1 AS INTEGER) AS dim, b.embedding[i] - a.embedding[i] AS x
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, unnest(range(1, 65)) AS u(i)
)"""


@query(
    "effect_vectors",
    f"""WITH {_PAIR_DIMS_SQL},
    norms AS (
      SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) + 1e-8 AS norm FROM dims GROUP BY 1
    )
    SELECT vec_id, dim, round(CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE), 5) AS x FROM dims JOIN norms USING (vec_id)""",
)
def effect_vectors(spark, folder):
    ref = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("ref"))
    alt = ref.select((F.col("vec_id") - 1).alias("vec_id"), F.col("ref").alias("alt"))
    effect = vectors.effect_vector(F.col("ref"), F.col("alt"))
    dims = ref.join(alt, "vec_id").select("vec_id", F.posexplode(effect).alias("dim", "x"))
    return dims.withColumn("x", F.round(F.col("x").cast("double"), 5))
