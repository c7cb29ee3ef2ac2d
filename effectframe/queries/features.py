"""Vector expressions, feature assembly, standardisation, ablations, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectframe.functions import vectors
from effectframe.operators import ablation, audit, curate, features, probes
from effectframe.operators.features import Blocks
from effectframe.queries.base import query, table
from effectframe.session import cut_lineage

_DIMS_SQL = """
dims AS (
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, embedding[i] AS x
  FROM embeddings, unnest(range(1, 65)) AS u(i)
)"""


def _long(df, key, vec, digits=5):
    dims = df.select(key, F.posexplode(vec).alias("dim", "x"))
    return dims.withColumn("x", F.round(F.col("x").cast("double"), digits))


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))


@query(
    "l2_normalise",
    f"""WITH {_DIMS_SQL},
    norms AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) + 1e-8 AS norm FROM dims GROUP BY 1)
    SELECT vec_id, dim, round(CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE), 5) AS x FROM dims JOIN norms USING (vec_id)""",
)
def l2_normalise(spark, folder):
    return _long(_embeddings(spark, folder), "vec_id", vectors.l2_normalize(F.col("x")))


@query(
    "dimension_stats",
    f"""WITH {_DIMS_SQL}
    SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std
    FROM dims GROUP BY 1, 2""",
)
def dimension_stats(spark, folder):
    stats = features.dimension_stats(_embeddings(spark, folder), "x", ["label"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "zscore_blocks",
    f"""WITH {_DIMS_SQL},
    stats AS (
      SELECT dim, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS s
      FROM dims WHERE label < 8 GROUP BY 1
    )
    SELECT vec_id, dim, round(CAST(CAST((CAST(x AS DOUBLE) - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS FLOAT) AS DOUBLE), 4) AS x
    FROM dims JOIN stats USING (dim)""",
)
def zscore_blocks(spark, folder):
    """Statistics of the training labels, applied to every row."""
    rows = _embeddings(spark, folder)
    scaler = features.fit_zscore(rows.filter(F.col("label") < 8))
    return _long(rows, "vec_id", scaler.apply(F.col("x")), 4)


@query(
    "vector_health",
    """SELECT vec_id, 64 AS dim, CAST(1 AS DOUBLE) AS finite_share,
      round(CAST(list_min(embedding) AS DOUBLE), 6) AS min_value,
      round(CAST(list_max(embedding) AS DOUBLE), 6) AS max_value FROM embeddings""",
)
def vector_health(spark, folder):
    health = features.vector_health(_embeddings(spark, folder), "vec_id", "x")
    return health.withColumns(
        {c: F.round(F.col(c).cast("double"), 6) for c in ("min_value", "max_value")}
    )


BLOCKS = Blocks(dna=64, go=64, prot=64)


def _feature_table(spark, folder):
    """Embeddings as DNA vectors, label means as gene vectors, labelled good ones as proteins."""
    rows = _embeddings(spark, folder)
    labels = table(spark, folder, "labels")
    means = features.dimension_stats(rows.filter(F.col("label") < 7), "x", ["label"])
    store = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("d"))
    genes = store.select(
        F.concat(F.lit("gene"), "label").alias("gene"),
        F.transform("d", lambda p: p["mean"].cast("float")).alias("vec"),
    )
    meta = rows.select(
        F.col("vec_id").cast("string").alias("variation_key"),
        F.concat(F.lit("Gene"), "label").alias("GeneSymbol"),
        (F.col("label") >= 5).cast("int").alias("_y"),
    )
    dna = rows.select(F.col("vec_id").cast("string").alias("variation_key"), F.col("x").alias("vec"))
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("string").alias("variation_key"))
    prot = dna.join(good, "variation_key", "left_semi")
    return features.assemble_features(meta, dna, genes, prot, BLOCKS)


@query(
    "feature_concat",
    f"""WITH {_DIMS_SQL},
    means AS (SELECT label, dim, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS m FROM dims WHERE label < 7 GROUP BY 1, 2),
    norms AS (SELECT label, sqrt(sum(CAST(m AS DOUBLE) * CAST(m AS DOUBLE))) + 1e-8 AS norm FROM means GROUP BY 1),
    good AS (SELECT doc_id FROM labels WHERE quality = 1)
    SELECT CAST(vec_id AS VARCHAR) AS variation_key, dim, round(CAST(x AS DOUBLE), 4) AS x FROM dims
    UNION ALL
    SELECT CAST(vec_id AS VARCHAR), dim + 64, round(coalesce(CAST(CAST(CAST(m AS DOUBLE) / norm AS FLOAT) AS DOUBLE), 0), 4)
    FROM dims LEFT JOIN means USING (label, dim) LEFT JOIN norms USING (label)
    UNION ALL
    SELECT CAST(vec_id AS VARCHAR), dim + 128,
      CASE WHEN doc_id IS NULL THEN 0 ELSE round(CAST(x AS DOUBLE), 4) END
    FROM dims LEFT JOIN good ON doc_id = vec_id""",
)
def feature_concat(spark, folder):
    return _long(_feature_table(spark, folder), "variation_key", F.col("x"), 4)


@query(
    "feature_coverage",
    """SELECT CAST(label >= 5 AS INTEGER) AS _y, count(*) AS n,
      round(avg(CASE WHEN label < 7 THEN 1.0 ELSE 0 END), 6) AS go_hit_rate,
      round(avg(CASE WHEN doc_id IS NULL THEN 0.0 ELSE 1 END), 6) AS protein_coverage
    FROM embeddings LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) ON doc_id = vec_id
    GROUP BY 1""",
)
def feature_coverage(spark, folder):
    report = features.coverage(_feature_table(spark, folder), ["_y"])
    return report.withColumns({c: F.round(c, 6) for c in ("go_hit_rate", "protein_coverage")})


@query(
    "feature_violations",
    """SELECT count(*) AS n_rows, count_if(label = 3) AS label_missing, count_if(label = 4) AS label_not_binary,
      count_if(vec_id % 7 = 1) AS vector_missing, count_if(vec_id % 7 = 2) AS vector_wrong_size,
      count_if(vec_id % 7 > 2) AS vector_not_finite FROM embeddings""",
)
def feature_violations(spark, folder):
    """Features of which some lack a label or a vector, or have a wrong one."""
    kind, x = F.col("vec_id") % 7, F.col("x")
    odd = F.when(kind == 3, F.lit(float("nan"))).when(kind == 5, F.lit(float("inf"))).when(kind == 6, F.lit(float("-inf")))
    broken = _embeddings(spark, folder).select(
        F.when(F.col("label") == 4, 2).when(F.col("label") != 3, 1).alias("_y"),
        F.when(kind == 2, F.slice(x, 1, 10))
        .when(kind > 2, F.concat(F.slice(x, 1, 63), F.array(odd.cast("float"))))
        .when(kind != 1, x)
        .alias("x"),
    )
    return curate.feature_violations(broken, "_y", "x", 64)


@query(
    "feature_repeats",
    """WITH sides AS (SELECT vec_id % 50 AS k, min(embedding) AS v FROM embeddings GROUP BY 1)
    SELECT e.vec_id, round(CAST(d.v[1] AS DOUBLE), 5) AS dna_first,
      round(CAST(CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE d.v[64] END AS DOUBLE), 5) AS prot_last,
      e.vec_id % 3 <> 0 AS has_protein
    FROM embeddings e JOIN sides d ON d.k = e.vec_id % 50""",
)
def feature_repeats(spark, folder):
    """Keys which repeat on both sides, and empty ones: as many features as rows."""
    rows = _embeddings(spark, folder)
    key = (F.col("vec_id") % 50).cast("string")
    meta = rows.select(
        "vec_id", key.alias("row_key"), F.when(F.col("vec_id") % 3 == 0, "").otherwise(key).alias("variation_key"), F.lit(1).alias("_y")
    )
    dna = rows.select(key.alias("row_key"), F.col("x").alias("vec"))
    prot = rows.select(key.alias("variation_key"), F.col("x").alias("vec"))
    prot = prot.unionByName(rows.select(F.lit("").alias("variation_key"), F.col("x").alias("vec")))
    table_ = features.assemble_features(meta, dna, None, prot, Blocks(dna=64, go=0, prot=64))
    return table_.select(
        "vec_id",
        F.round(F.get("x", 0).cast("double"), 5).alias("dna_first"),
        F.round(F.get("x", 127).cast("double"), 5).alias("prot_last"),
        "has_protein",
    )


@query(
    "ablate_zero",
    f"""WITH {_DIMS_SQL}
    SELECT vec_id, dim, CASE WHEN dim BETWEEN 8 AND 23 OR dim >= 60 THEN 0 ELSE round(CAST(x AS DOUBLE), 5) END AS x
    FROM dims""",
)
def ablate_zero(spark, folder):
    blanked = vectors.zero_ranges(F.col("x"), [(8, 24), (60, 99), (5, 5)])
    return _long(_embeddings(spark, folder), "vec_id", blanked)


@query(
    "ablate_scale",
    f"WITH {_DIMS_SQL} SELECT vec_id, dim, round(CAST(CAST(CAST(0.25 AS DOUBLE) * CAST(x AS DOUBLE) AS FLOAT) AS DOUBLE), 5) AS x FROM dims",
)
def ablate_scale(spark, folder):
    return _long(_embeddings(spark, folder), "vec_id", vectors.scale(F.col("x"), 0.25))


@query(
    "ablate_permute",
    """WITH r AS (
      SELECT vec_id, label, embedding,
        row_number() OVER (PARTITION BY label ORDER BY md5('13:row:' || vec_id), vec_id) AS a,
        row_number() OVER (PARTITION BY label ORDER BY md5('13:source:' || vec_id), vec_id) AS b
      FROM embeddings
    )
    SELECT r.vec_id, CAST(i - 1 AS INTEGER) AS dim, round(CAST(s.embedding[i] AS DOUBLE), 6) AS x
    FROM r JOIN r s ON s.label = r.label AND s.b = r.a, unnest(range(1, 65)) AS u(i)""",
)
def ablate_permute(spark, folder):
    moved = ablation.permute_vectors(_embeddings(spark, folder), "vec_id", group=["label"])
    dims = moved.select("vec_id", F.posexplode("x").alias("dim", "x"))
    return dims.withColumn("x", F.round(F.col("x").cast("double"), 6))


def _draw_sql(start: str) -> str:
    second = f"((({start} + dim * 48271) % 2147483647) * (({start} + dim * 48271) % 2147483647) + dim + 1) % 2147483647"
    third = f"((({second}) * 69621 + {start}) % 2147483647)"
    return f"((({third} * {third} + 7) % 2147483647 + 0.5::DOUBLE) / 2147483647::DOUBLE)"


@query(
    "ablate_noise",
    f"""WITH dims AS (
      SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) AS x,
        ('0x' || substr(md5('13:' || vec_id), 1, 12))::BIGINT % 2147483647 AS a,
        ('0x' || substr(md5('13:' || vec_id), 17, 12))::BIGINT % 2147483647 AS b
      FROM embeddings, unnest(range(1, 65)) AS u(i)
    ),
    noisy AS (
      SELECT vec_id, x, CAST(CAST(x + 1.5 * sqrt(-2 * ln({_draw_sql('a')})) * cos(2 * pi() * {_draw_sql('b')}) AS FLOAT) AS DOUBLE) AS y
      FROM dims
    )
    SELECT vec_id, round(sqrt(sum(x * x)), 4) AS norm_before, round(sqrt(sum(y * y)), 4) AS norm_after,
      round((stddev_pop(x) + 1e-8) / (stddev_pop(y - x) + 1e-8), 4) AS snr
    FROM noisy GROUP BY 1""",
)
def ablate_noise(spark, folder):
    rows = _embeddings(spark, folder)
    noisy = rows.withColumn("noisy", vectors.add_noise(F.col("x"), F.col("vec_id"), 13, std=1.5))
    report = ablation.noise_report(noisy, "vec_id", "x", "noisy")
    return report.withColumns({c: F.round(c, 4) for c in ("norm_before", "norm_after", "snr")})


def _stored(df):
    """Features as a stage table: their readers are many, their rows wide and few."""
    return cut_lineage(df.repartition(df.sparkSession.sparkContext.defaultParallelism))


def _linear_scorer(df):
    """A fixed linear score over vector and prompt, in place of a trained model."""
    raw = vectors.total(F.col("x")) + F.length("prompt") / 100.0 - 0.9
    p = 1.0 / (1.0 + F.exp(-raw))
    return df.withColumns({"prob": p, "pred": (p > 0.5).cast("int")})


def _prompted(spark, folder):
    return _feature_table(spark, folder).withColumns(
        {
            "gene_symbol": F.col("GeneSymbol"),
            "hgvsc": F.concat(F.lit("c."), "variation_key", F.lit("A>G")),
            "hgvsp": F.lit("p.Gln283Pro"),
            "most_severe_consequence": F.lit("missense_variant"),
            "consequence_terms": F.lit("missense_variant"),
        }
    )


@query("ablation_matrix")
def ablation_matrix(spark, folder):
    """All modes, scored in one union; noise modes make it rows-only."""
    rows = ablation.mode_rows(_stored(_prompted(spark, folder)), BLOCKS)
    results, _ = ablation.run_ablation(rows, _linear_scorer)
    return results.select("mode", "n", "accuracy", "f1", "roc_auc", "avg_precision")


_MODE_ROWS_SQL = f"""
{_DIMS_SQL.lstrip()},
means AS (SELECT label, dim, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS m FROM dims WHERE label < 7 GROUP BY 1, 2),
norms AS (SELECT label, sqrt(sum(CAST(m AS DOUBLE) * CAST(m AS DOUBLE))) + 1e-8 AS norm FROM means GROUP BY 1),
go AS (SELECT label, sum(CAST(CAST(m AS DOUBLE) / norm AS FLOAT)::DOUBLE) AS total FROM means JOIN norms USING (label) GROUP BY 1),
sums AS (
  SELECT vec_id, label, CAST(label >= 5 AS INTEGER) AS y, sum(CAST(x AS DOUBLE)) AS dna,
    CASE WHEN any_value(doc_id) IS NULL THEN 0 ELSE sum(CAST(x AS DOUBLE)) END AS prot
  FROM dims LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) ON doc_id = vec_id GROUP BY 1, 2, 3
),
base AS (
  SELECT vec_id, y, dna, prot, coalesce(total, 0) AS go,
    length('Gene: Gene' || label || chr(10)) AS gene_len,
    length('HGVS.c: c.' || vec_id || 'A>G' || chr(10)) AS c_len,
    length('HGVS.p: p.Gln283Pro' || chr(10)) AS p_len,
    length('Most severe consequence: missense variant') AS m_len,
    length('Variant context:' || chr(10) || chr(10) || chr(10) || 'Predict label:') AS frame_len
  FROM sums LEFT JOIN go USING (label)
),
modes AS (
  SELECT 'cond+prompt' AS mode, y, dna + go + prot AS v, gene_len + c_len + p_len + m_len + frame_len AS len FROM base
  UNION ALL SELECT 'cond_only', y, dna + go + prot, frame_len FROM base
  UNION ALL SELECT 'prompt_only', y, 0, gene_len + c_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'cond_zero_dna', y, go + prot, gene_len + c_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'cond_zero_go', y, dna + prot, gene_len + c_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'cond_zero_prot', y, dna + go, gene_len + c_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'prompt_no_hgvsp', y, dna + go + prot, gene_len + c_len + m_len + frame_len FROM base
  UNION ALL SELECT 'prompt_no_hgvsc', y, dna + go + prot, gene_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'prompt_no_gene', y, dna + go + prot, c_len + p_len + m_len + frame_len FROM base
  UNION ALL SELECT 'cond×scale=0.5', y, (dna + go + prot) * 0.5::DOUBLE, gene_len + c_len + p_len + m_len + frame_len FROM base
),
decided AS (SELECT mode, y, CAST(v + len / CAST(100 AS DOUBLE) - CAST(0.9 AS DOUBLE) > 0 AS INTEGER) AS p FROM modes),
counted AS (
  SELECT mode, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS good, count(*) AS n,
    sum(y * p) AS tp, sum(p) AS pp, sum(y) AS yp FROM decided GROUP BY 1
),
rates AS (SELECT mode, CAST(good AS DOUBLE) / n AS accuracy, 2 * CAST(tp AS DOUBLE) / (pp + yp) AS f1 FROM counted)"""


@query(
    "ablation_deltas",
    f"""WITH {_MODE_ROWS_SQL}
    SELECT r.mode, round(r.accuracy, 6) AS accuracy, round(r.f1, 6) AS f1,
      round(r.accuracy - b.accuracy, 6) AS delta_accuracy, round(r.f1 - b.f1, 6) AS delta_f1
    FROM rates r JOIN rates b ON b.mode = 'cond+prompt' WHERE r.mode <> 'cond+prompt'""",
)
def ablation_deltas(spark, folder):
    """The modes without noise or permutation, with their distance from the baseline."""
    rows = ablation.mode_rows(
        _stored(_prompted(spark, folder)), BLOCKS, noise=False, permute=False, noise_only=False, scales=(0.5,)
    )
    _, deltas = ablation.run_ablation(rows, _linear_scorer)
    wanted = ["accuracy", "f1", "delta_accuracy", "delta_f1"]
    return deltas.select("mode", *[F.round(c, 6).alias(c) for c in wanted])


def _split_features(spark, folder):
    by_hash = F.pmod(F.conv(F.substring(F.md5(F.col("variation_key").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(10))
    split = F.when(by_hash == 0, "test").when(by_hash == 1, "val").otherwise("train")
    return _feature_table(spark, folder).withColumn("split", split)


@query("probe_logistic")
def probe_logistic(spark, folder):
    """Iterative fit: rows only."""
    return probes.run_probe_modes(_stored(_split_features(spark, folder)), BLOCKS, ["dna"])


@query("probe_modes")
def probe_modes(spark, folder):
    """All seven block combinations; iterative fits, rows only."""
    return probes.run_probe_modes(_stored(_split_features(spark, folder)), BLOCKS)


@query("probe_perceptron")
def probe_perceptron(spark, folder):
    """Two-layer network on a balanced resample; iterative fit, rows only."""
    return probes.run_probe_modes(
        _stored(_split_features(spark, folder)), BLOCKS, ["dna+go"], model="perceptron", hidden=(32, 32), max_iter=20
    )


@query("probe_network")
def probe_network(spark, folder):
    """Class-weighted network with dropout, early stop on validation; iterative fit, rows only."""
    return probes.run_probe_modes(
        _stored(_split_features(spark, folder)), BLOCKS, ["dna+go"], model="network", hidden=(32, 16), max_iter=6,
        training={"batch_rows": 16_384, "lr": 5e-3},
    )


@query(
    "feature_check",
    """WITH parts AS (
      SELECT CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, label > 4 AS positive,
        vec_id % 7 IN (1, 2, 3) AS broken, embedding AS x FROM embeddings
    )
    SELECT split, count(*) AS n, 64 AS dim_min, 64 AS dim_max,
      round(avg(CASE WHEN broken THEN 0.0 ELSE 1.0 END), 9) AS finite_rows,
      round(CAST(min(list_min(CASE WHEN broken THEN x[1:63] ELSE x END)) AS DOUBLE), 5) AS value_min,
      round(CAST(max(list_max(CASE WHEN broken THEN x[1:63] ELSE x END)) AS DOUBLE), 5) AS value_max
    FROM parts GROUP BY split""",
)
def feature_check(spark, folder):
    """Checks before training, of features with a NaN, an infinity or a null in some rows."""
    kind, x = F.col("vec_id") % 7, F.col("x")
    odd = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("-inf"))).cast("float")
    rows = _embeddings(spark, folder).select(
        F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"),
        (F.col("label") > 4).cast("int").alias("_y"),
        F.when(kind.isin(1, 2, 3), F.concat(F.slice(x, 1, 63), F.array(odd))).otherwise(x).alias("x"),
    )
    found = audit.feature_check(rows)
    rounded = [F.round(F.col(c).cast("double"), d).alias(c) for c, d in (("finite_rows", 9), ("value_min", 5), ("value_max", 5))]
    return found.select("split", "n", "dim_min", "dim_max", *rounded)
