import json

import pytest
from pyspark.sql import functions as F

from effectframe.operators import annotate, audit
from effectframe.queries import standins
from effectframe.schemas import CONSEQUENCE_SCHEMA
from effectframe.sources import tables
from effectframe.sources.tables import read_consequences
from smallest import SF

RECORDS = [
    {
        "id": "1", "most_severe_consequence": "missense_variant",
        "transcript_consequences": [
            {"gene_symbol": "A", "hgvsc": "ENST1:c.1A>G", "hgvsp": "ENSP1.2:p.Arg1Gly", "protein_id": "ENSP1.2",
             "consequence_terms": ["missense_variant", "", None], "protein_start": 3, "strand": 1},
            {"gene_symbol": "SECOND"},
        ],
    },
    {"id": 2, "transcript_consequences": []},
    {"id": "3", "transcript_consequences": None, "most_severe_consequence": "intergenic_variant"},
    {"id": "4", "most_severe_consequence": "x", "transcript_consequences": [{"protein_id": "ENSP1.9", "hgvsp": None}]},
]


def records(spark, tmp_path):
    path = tmp_path / "vep.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RECORDS))
    return read_consequences(spark, str(path))


def proteins(spark):
    wt = spark.createDataFrame([("ENSP1", "MRK-*")], "protein_id_norm string, seq_wt string")
    mt = spark.createDataFrame(
        [("ENSP1", "p.Arg1Gly", "MGK"), ("ENSP1", None, "MM"), ("ENSP2", "p.x", "Q")],
        "protein_id_norm string, hgvsp_norm string, seq_mt string",
    )
    return wt, mt


def test_flatten(spark, tmp_path):
    flat = {r["id"]: r for r in annotate.flatten_consequences(records(spark, tmp_path)).collect()}
    assert set(flat) == {"1", "2", "3", "4"}
    one = flat["1"]
    assert (one["gene_symbol"], one["hgvsc"], one["hgvsp"]) == ("A", "c.1A>G", "p.Arg1Gly")
    assert one["consequence_terms"] == "missense_variant" and one["strand"] == "1"
    assert flat["2"]["gene_symbol"] is None and flat["3"]["most_severe_consequence"] == "intergenic_variant"


def test_join_pairs_and_merge(spark, tmp_path):
    wt, mt = proteins(spark)
    variants = spark.createDataFrame(
        [(1, "G1", "old", 1), (3, "G3", "old", 0), (4, "G4", "old", 0), (9, "G9", "old", 1)],
        "VariationID long, GeneSymbol string, impact string, _y int",
    )
    annotated, combined = annotate.annotate_variants(variants, records(spark, tmp_path), wt, mt)
    seqs = {r["VariationID"]: (r["seq_wt"], r["seq_mt"]) for r in combined.collect()}
    assert seqs == {1: ("MRK-*", "MGK"), 3: (None, None), 4: ("MRK-*", "MM"), 9: (None, None)}
    rows = {r["VariationID"]: r for r in annotated.collect()}
    assert rows[1]["hgvsp"] == "p.Arg1Gly" and rows[1]["impact"] is None and rows[9]["hgvsc"] is None
    assert dict(annotated.dtypes)["protein_start"] == "bigint" and len(rows) == 4
    pairs = {tuple(r) for r in annotate.protein_pairs(combined).collect()}
    assert pairs == {
        ("1", "ENSP1.2", "p.Arg1Gly", "missense_variant", "MRKX", "MGK"),
        ("4", "ENSP1.9", None, None, "MRKX", "MM"),
    }
    report = audit.annotation_report(combined).first()
    assert (report["n"], report["pct_hgvsp"], report["pct_seq_wt_missing"]) == (4, 25.0, 50.0)


def test_duplicate_annotations_do_not_multiply(spark):
    variants = spark.createDataFrame([(1, 1)], "VariationID long, _y int")
    table = spark.createDataFrame(
        [("1", "c.2", "9"), ("1", "c.1", "8")], "VariationID string, hgvsc string, protein_start string"
    )
    got = annotate.merge_annotations(variants, table).collect()
    assert [(r["hgvsc"], r["protein_start"]) for r in got] == [("c.1", 8)]


def test_attach_proteins(spark):
    variants = spark.createDataFrame([("1",), ("2",)], "variation_key string")
    prot = spark.createDataFrame(
        [("1", "P2", "b", "w2", "m2", "t"), ("1", "P1", "a", "w1", "m1", "t")],
        "variation_key string, protein_id string, hgvsp string, seq_wt string, seq_mt string, consequence_terms string",
    )
    got = {r["variation_key"]: (r["protein_seq_wt"], r["has_protein"]) for r in annotate.attach_proteins(variants, prot).collect()}
    assert got == {"1": ("w1", True), "2": (None, False)}


def test_top_values_and_completeness(spark):
    df = spark.createDataFrame([("a_b",), ("a_b",), ("",), (None,), ("c",)], "v string")
    got = [tuple(r) for r in audit.top_values(df, "v").collect()]
    assert got == [("a b", 2), ("missing", 2), ("c", 1)]
    assert audit.completeness(df, ["v"]).first()["pct_v"] == 60.0
    counts = audit.stage_counts({"all": df.withColumn("split", F.lit("train"))}).collect()
    assert [tuple(r) for r in counts] == [("train", "all", 5)]


def test_slices_are_taken_by_membership(spark):
    variants = spark.createDataFrame([(1, "train"), (1, "train"), (2, "val"), (3, "train"), (3, "test")], "VariationID long, split string")
    combined = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], "VariationID long, hgvsp string")
    got = sorted((r["split"], r["hgvsp"]) for r in annotate.split_slices(combined, variants).collect())
    assert got == [("test", "d"), ("train", "a"), ("train", "b"), ("train", "d"), ("val", "c")]


def test_broken_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"id": "1", "other": 1}', '{"id": "2"', "", "[1, 2", '{"id": "3", "transcript_consequences": "none"}', '{"id": "4"}', " "]
    (tmp_path / "records.json").write_text("\n".join(lines))
    records, broken = tables.read_consequences_apart(spark, str(tmp_path / "records.json"))
    assert records.columns == CONSEQUENCE_SCHEMA.fieldNames()
    assert sorted(r["id"] for r in records.collect()) == ["1", "4"]
    assert sorted(r["value"] for r in broken.collect()) == sorted([lines[1], lines[3], lines[4]])
    assert all(r["file"].endswith("records.json") for r in broken.collect())
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.read_consequences(spark, str(tmp_path / "records.json")).collect()


def test_order_lines_are_gathered_narrow(spark):
    """Lists of whole transcripts filled the sort under the aggregation and spilled."""
    records = standins.consequences(spark, SF)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    (gathered,) = [line for line in plan.splitlines() if "collect_list" in line]
    assert "l_suppkey" in gathered and "HGNC" not in gathered and "ENST" not in gathered
