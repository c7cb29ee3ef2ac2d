import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectframe.operators import ablation, audit, curate, features, probes, prompts
from effectframe.operators.features import Blocks
from effectframe.plans import variants as plans
from effectframe.operators import sequences, windows
from effectframe.sinks import writers
from effectframe.sources.tables import read_vectors

BLOCKS = Blocks(2, 2, 1)


def inputs(spark):
    meta = spark.createDataFrame(
        [("1", "brca1", 1, "train"), ("2", "NONE", 0, "train"), ("3", None, 0, "val")],
        "variation_key string, GeneSymbol string, _y int, split string",
    )
    dna = spark.createDataFrame(
        [("1", [1.0, 2.0]), ("2", [3.0, 4.0]), ("3", [5.0, 6.0])], "variation_key string, vec array<float>"
    )
    go = spark.createDataFrame(
        [("BRCA1", [3.0, 4.0]), ("Brca1", [0.0, 2.0])], "gene string, vec array<float>"
    )
    prot = spark.createDataFrame([("2", [7.0])], "variation_key string, vec array<float>")
    return meta, dna, go, prot


def test_assembly(spark):
    table = features.assemble_features(*inputs(spark), BLOCKS)
    got = {r["variation_key"]: ([round(x, 4) for x in r["x"]], r["go_hit"], r["has_protein"]) for r in table.collect()}
    # "Brca1" sorts after "BRCA1", so it wins the shared key.
    assert got["1"] == ([1, 2, 0, 1, 0], True, False)
    assert got["2"] == ([3, 4, 0, 0, 7], False, True)
    assert got["3"] == ([5, 6, 0, 0, 0], False, False)
    row = features.coverage(table, []).first()
    assert math.isclose(row["go_hit_rate"], 1 / 3) and math.isclose(row["protein_coverage"], 1 / 3)
    checks = curate.feature_violations(table, "_y", "x", BLOCKS.total).first().asDict()
    assert checks.pop("n_rows") == 3 and not any(checks.values())
    assert curate.feature_violations(table, "_y", "x", 9).first()["vector_wrong_size"] == 3
    report = {r["split"]: r for r in audit.feature_check(table).collect()}
    assert report["train"]["dim_min"] == 5 and report["val"]["pos"] == 0


def test_assembly_without_genes(spark):
    meta, dna, _, prot = inputs(spark)
    table = features.assemble_features(meta, dna, None, prot, Blocks(2, 0, 1))
    assert {len(r["x"]) for r in table.collect()} == {3}


def test_variation_key(spark):
    df = spark.createDataFrame([(5,), (None,)], "VariationID long")
    assert [r[1] for r in features.keyed(df).collect()] == ["5", ""]


def test_zscore(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (200, 4)).astype("float32")
    x[:, 3] = 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<float>")
    model = features.fit_zscore(df)
    assert np.allclose(model.mean, x.astype("float64").mean(0)) and model.std[3] == 1.0
    assert np.allclose(model.std[:3], x.astype("float64").std(0)[:3])
    z = np.array([r[0] for r in df.orderBy("i").select(model.apply(F.col("x"))).collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-5) and np.allclose(z.std(0)[:3], 1, atol=1e-5)


PROMPT_SCHEMA = (
    "k string, gene_symbol string, GeneSymbol string, hgvsc string, hgvsp string, "
    "most_severe_consequence string, consequence_terms string, _y int"
)


def prompt_rows(spark):
    return spark.createDataFrame(
        [
            ("a", None, "HFE", "c.848A>C", "p.Gln283Pro", "missense_variant", "missense_variant", 1),
            ("b", "", None, None, "nan", None, "", 0),
            ("c", "G", "H", "", "", "stop_gained", "a_b,A_b,c", 0),
        ],
        PROMPT_SCHEMA,
    )


def test_prompts(spark):
    got = {r["k"]: r for r in prompts.with_prompts(prompt_rows(spark)).collect()}
    body = "Gene: HFE\nHGVS.c: c.848A>C\nHGVS.p: p.Gln283Pro\nMost severe consequence: missense variant"
    assert got["a"]["prompt"] == f"Variant context:\n{body}\n\nPredict label:" and got["a"]["target"] == "Pathogenic"
    assert got["b"]["prompt"] == "Variant context:\nMost severe consequence: \n\nPredict label:"
    assert "Gene: G\nMost severe consequence: stop gained\nConsequence terms: a b, c" in got["c"]["prompt"]


def test_blanking(spark):
    df = prompt_rows(spark)
    hidden = prompts.with_prompts(df, blank=["HGVSP"]).filter("k = 'a'").first()["prompt"]
    columns = prompts.with_prompts(prompts.blank_fields(df, ["hgvsp"])).filter("k = 'a'").first()["prompt"]
    assert hidden == columns and "HGVS.p" not in hidden and "HGVS.c" in hidden
    before = prompts.real_notation_counts(df, prompts.prompt_columns(df)).first()
    after = prompts.real_notation_counts(prompts.blank_prompts(df), prompts.prompt_columns(df)).first()
    assert tuple(before) == (1, 1) and tuple(after) == (0, 0)
    diff = prompts.source_diff(df, ["hgvsp"], "k").collect()
    # "nan" and a blank are the same source text.
    assert {r["k"] for r in diff} == {"a"} and all(len(r["sha_after"]) == 10 for r in diff)


def test_prompt_stats_and_chat(spark):
    stats = prompts.prompt_stats(prompts.with_prompts(prompt_rows(spark))).first()
    assert (stats["n"], stats["n_blank"], stats["hgvsc_hits"], stats["hgvsp_hits"]) == (3, 0, 1, 1)
    df = spark.createDataFrame([("hi", "Benign")], "u string, t string")
    both = df.select(prompts.chat_messages(F.col("u"), F.col("t"))).first()[0]
    assert [m["role"] for m in both] == ["system", "user", "assistant"] and both[2]["content"] == "Benign"
    assert len(df.select(prompts.chat_messages(F.col("u"))).first()[0]) == 2


def ablation_input(spark, n=60):
    return spark.range(n).select(
        F.col("id").cast("string").alias("variation_key"),
        F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (i + F.col("id")).cast("float")).alias("x"),
        (F.col("id") % 2).cast("int").alias("_y"),
        F.lit("HFE").alias("gene_symbol"),
        F.lit("c.1A>G").alias("hgvsc"),
        F.lit("p.A1G").alias("hgvsp"),
        F.lit("missense_variant").alias("most_severe_consequence"),
        F.lit("").alias("consequence_terms"),
    )


def test_ablation_rows(spark):
    df = ablation_input(spark)
    rows = ablation.mode_rows(df, BLOCKS).toPandas()
    modes = set(rows["mode"])
    assert len(modes) == 16 and (rows.groupby("mode").size() == 60).all()
    by = {m: p.set_index("variation_key").sort_index() for m, p in rows.groupby("mode")}
    base = np.array(by["cond+prompt"]["x"].tolist())
    assert np.array_equal(np.array(by["cond×scale=1"]["x"].tolist()), base)
    assert np.array_equal(np.array(by["cond×scale=0"]["x"].tolist()), np.array(by["prompt_only"]["x"].tolist()))
    zero_go = np.array(by["cond_zero_go"]["x"].tolist())
    assert not zero_go[:, 2:4].any() and np.array_equal(zero_go[:, [0, 1, 4]], base[:, [0, 1, 4]])
    moved = np.array(by["cond+permute"]["x"].tolist())
    assert not np.array_equal(moved, base)
    assert sorted(map(tuple, moved)) == sorted(map(tuple, base))
    assert (by["cond_only"]["prompt"] == "Variant context:\n\n\nPredict label:").all()
    assert not by["prompt_no_gene"]["prompt"].str.contains("Gene").any()
    assert by["pure-noise"]["prompt"].equals(by["cond+prompt"]["prompt"])


def test_ablation_results(spark):
    def scorer(rows):
        p = F.get("x", 0).cast("double") / 100 + F.length("prompt") / 1000
        return rows.withColumns({"prob": p, "pred": (p > 0.4).cast("int")})

    results, deltas = ablation.run_ablation(ablation.mode_rows(ablation_input(spark), BLOCKS), scorer)
    got = {r["mode"]: r for r in results.collect()}
    assert got["cond×scale=1"]["roc_auc"] == got["cond+prompt"]["roc_auc"]
    assert got["prompt_only"]["roc_auc"] == 0.5
    shift = {r["mode"]: r["delta_roc_auc"] for r in deltas.collect()}
    assert shift["cond×scale=1"] == 0 and "cond+prompt" not in shift


def probe_input(spark, n=400):
    y = (F.col("id") % 2).cast("int")
    split = F.when(F.col("id") % 20 < 4, "val").when(F.col("id") % 20 < 8, "test").otherwise("train")
    signal = (y * 2 - 1 + F.randn(3) * 0.4).cast("float")
    return spark.range(n).select(
        F.col("id").cast("string").alias("variation_key"), y.alias("_y"), F.lit("g").alias("GeneSymbol"),
        split.alias("split"),
        F.array(signal, F.randn(5).cast("float"), F.randn(6).cast("float"), F.randn(7).cast("float"), F.lit(0.0).cast("float")).alias("x"),
    )


@pytest.mark.parametrize("model", ["logistic", "perceptron"])
def test_probe(spark, model):
    rows = probe_input(spark)
    report = probes.run_probe_modes(rows, BLOCKS, ["dna"], model=model, hidden=(8, 8), max_iter=30)
    got = {(r["split"], r["at"]): r for r in report.collect()}
    assert set(got) == {(s, a) for s in ("val", "test") for a in ("0.5", "best")}
    assert got[("test", "0.5")]["roc_auc"] > 0.9 and got[("val", "best")]["balanced_accuracy"] > 0.85


def test_perceptron_stops_on_validation(spark):
    rows = probe_input(spark).withColumn("features", F.col("x"))
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    dim = len(rows.first()["x"])
    settings = dict(hidden=(4,), max_iter=12, slice_iter=3, patience=1)
    (scored,) = probes.perceptron_scores(train, [val], dim, "variation_key", validation=val, **settings)
    assert scored.count() == val.count() and scored.filter("prob between 0 and 1").count() == val.count()
    with pytest.raises(ValueError):
        probes.perceptron_scores(train, [val], dim, "variation_key", validation=val, metric="loss")


def test_probe_modes_follow_blocks():
    assert probes.available_modes(Blocks(2, 0, 0)) == ["dna"]
    assert len(probes.available_modes(BLOCKS)) == 7
    with pytest.raises(ValueError):
        probes.mode_vector(Blocks(2, 0, 1), "dna+go")


def test_probe_rows(spark):
    rows = probes.probe_rows(probe_input(spark), BLOCKS, limit=3).collect()
    assert [r["variation_key"] for r in rows] == ["0", "1", "10"] and len(rows[0]["dna"]) == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame(
        [(2, "NC_2", 5, "a", "g"), (1, "NC_1", 50, "c", "t"), (3, "NC_1", 7, "g", "")],
        "VariationID long, ChromosomeAccession string, PositionVCF long, ReferenceAlleleVCF string, AlternateAlleleVCF string",
    )
    writers.write_vcf(df, str(tmp_path / "vcf"))
    parts = sorted((tmp_path / "vcf").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines[:2] == ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    assert lines[2:] == [
        "NC_1\t7\t3\tG\t\t.\t.\t.", "NC_1\t50\t1\tC\tT\t.\t.\t.", "NC_2\t5\t2\tA\tG\t.\t.\t."
    ]
    chunks = {r["VariationID"]: r["chunk"] for r in writers.with_chunks(df, 2).collect()}
    assert chunks == {3: 0, 1: 0, 2: 1}
    vecs = spark.createDataFrame([("HFE", [0.5, -1.25])], "gene string, vec array<float>")
    writers.write_gene_vectors(vecs, str(tmp_path / "n2v"))
    assert spark.read.text(str(tmp_path / "n2v_genes.tsv")).first()[0] == "HFE\t0.500000 -1.250000"
    stored = read_vectors(spark, str(tmp_path / "n2v_genes.parquet"), "gene", 2)
    assert stored.count() == 1
    with pytest.raises(ValueError):
        read_vectors(spark, str(tmp_path / "n2v_genes.parquet"), "gene", 3)
    scored = spark.createDataFrame([("a", "val", "m1", 0.5)], "k string, split string, mode string, p double")
    writers.write_predictions(scored, str(tmp_path / "scored"))
    assert (tmp_path / "scored" / "split=val" / "mode=m1").is_dir()


def test_pipeline_end_to_end(spark, tmp_path):
    """Raw variants to features: every stage on small invented tables."""
    from effectframe import constants as C
    from effectframe.schemas import CONSEQUENCE_SCHEMA, VARIANT_SCHEMA

    genome = "ACGTTGCAACGT" * 40
    data, records = [], []
    for i in range(60):
        pos = 20 + 5 * i
        ref = genome[pos - 1]
        row = dict.fromkeys(C.VARIANT_COLUMNS)
        row |= {
            "VariationID": i, "Name": f"NM_1(GENE{i % 20}):c.1", "ClinicalSignificance": "Pathogenic" if i % 2 else "Benign",
            "ReviewStatus": C.REVIEW_STATUS, "Assembly": C.ASSEMBLY, "ChromosomeAccession": "NC_1.1",
            "PositionVCF": pos, "ReferenceAlleleVCF": ref, "AlternateAlleleVCF": "T" if ref != "T" else "G",
        }
        data.append(tuple(row[c] for c in C.VARIANT_COLUMNS))
        records.append({
            "id": str(i), "most_severe_consequence": "missense_variant" if i % 3 else "stop_gained",
            "transcript_consequences": [{"protein_id": "ENSP1.1", "hgvsp": f"ENSP1.1:p.A{i}G"}] if i % 4 else [],
        })
    raw = spark.createDataFrame(data, VARIANT_SCHEMA)
    nested = spark.createDataFrame(records, CONSEQUENCE_SCHEMA)
    wt = spark.createDataFrame([("ENSP1", "MKTAYIAK")], "protein_id_norm string, seq_wt string")
    mt = spark.range(60).select(
        F.lit("ENSP1").alias("protein_id_norm"), F.concat(F.lit("p.A"), "id", F.lit("G")).alias("hgvsp_norm"),
        F.lit("MKTAYIGK").alias("seq_mt"),
    )
    bins = windows.bins_from_pieces(
        spark.createDataFrame([("NC_1.1", 0, genome)], "contig string, start long, bases string"), 64, 32
    )
    annotated, combined = plans.annotated_splits(raw, nested, wt, mt)
    settings = plans.EffectSettings(window=6, dna_dim=8, protein_dim=4, go_dim=2, bin_size=64, halo=32)
    genes = spark.createDataFrame([("GENE1", [1.0, 0.0])], "gene string, vec array<float>")
    table, counts = plans.build_features(
        annotated, combined, bins, genes, sequences.kmer_encoder(3, 8), sequences.kmer_encoder(2, 4),
        settings, str(tmp_path),
    )
    rows = table.collect()
    assert len(rows) == 60 and all(len(r["x"]) == 14 for r in rows)
    assert sum(r["has_protein"] for r in rows) == 45 and sum(r["go_hit"] for r in rows) == 3
    by_stage = {}
    for r in counts.collect():
        by_stage[r["stage"]] = by_stage.get(r["stage"], 0) + r["n"]
    assert by_stage == {"dna_input_rows": 60, "dna_rows": 60, "protein_rows": 45, "protein_aligned": 45}
    split, filtered = plans.filtered_splits(raw, nested, wt, mt, ["stop_gained"])
    assert split.count() == 20 and filtered.count() == 20
    with pytest.raises(ValueError):
        plans.filtered_splits(raw, nested, wt, mt, ["no_such"])
