import gzip

import pytest
from pyspark.sql import functions as F

from effectframe import constants as C
from effectframe.operators import curate, ranks, splits
from effectframe.schemas import SchemaError, require_types
from effectframe.sources.tables import read_table, read_variants


def variant(i, sig="Pathogenic", name=None, gene="GENE1", assembly=C.ASSEMBLY, pos=10, review=C.REVIEW_STATUS):
    return {
        "VariationID": i, "Name": name, "GeneSymbol": gene, "ClinicalSignificance": sig,
        "ReviewStatus": review, "Assembly": assembly, "Chromosome": "1",
        "ChromosomeAccession": "NC_1.1", "PositionVCF": pos, "ReferenceAlleleVCF": "A",
        "AlternateAlleleVCF": "G", "Start": pos, "Stop": pos, "ReferenceAllele": "A",
        "AlternateAllele": "G", "PhenotypeIDS": None, "PhenotypeList": None,
    }


RULES = [
    (variant(1, "Likely pathogenic", "NM_000410.4(HFE):c.848A>C", "X;Y"), (1, "HFE")),
    (variant(2, "Benign/Likely benign", None, "ABC1;DEF2"), (0, "ABC1")),
    (variant(3, "Benign", None, "covers 12 genes, none of which curated"), (0, "")),
    (variant(4, "Uncertain significance"), None),
    (variant(5, assembly="GRCh37"), None),
    (variant(6, pos=-1), None),
    (variant(7, review="no assertion"), None),
    (variant(8, " BENIGN ", "x(A):c.1", ";B2"), (0, "")),
    (variant(9, "pathogenic", "no gene", "ok-1 rest"), (1, "ok-1")),
]


def rows_frame(spark):
    from effectframe.schemas import VARIANT_SCHEMA

    data = [tuple(v[c] for c in C.VARIANT_COLUMNS) for v, _ in RULES]
    return spark.createDataFrame(data, VARIANT_SCHEMA)


def test_rule_rows(spark):
    got = {r["VariationID"]: (r["_y"], r["GeneSymbol"]) for r in curate.curate_variants(rows_frame(spark)).collect()}
    assert got == {v["VariationID"]: want for v, want in RULES if want}


def test_read_variants_gzip(spark, tmp_path):
    path = tmp_path / "v.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write("\t".join(["Extra", *C.VARIANT_COLUMNS]) + "\n")
        for v, _ in RULES:
            cells = ["NA" if v[c] is None else str(v[c]) for c in C.VARIANT_COLUMNS]
            f.write("\t".join(["e", *cells]) + "\n")
    df = read_variants(spark, str(path), partitions=3)
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == sorted(
        map(tuple, rows_frame(spark).collect()), key=lambda r: r[0]
    )


def test_read_table_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("a", "1")], "x string, y string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.csv").write_text("x,y\na,1\n")
    (tmp_path / "t.txt").write_text("x\ty\na\t1\n")
    df.write.orc(str(tmp_path / "t.orc"))
    (tmp_path / "t.json").write_text('{"x": "a", "y": "1"}\n')
    for name in ("t.parquet", "t.csv", "t.txt", "t.orc", "t.json"):
        assert [tuple(r) for r in read_table(str(tmp_path / name), spark).collect()] == [("a", "1")]
    assert read_table(df) is df
    with pytest.raises(ValueError):
        read_table("t.feather", spark)
    with pytest.raises(ValueError):
        read_table("t.xyz", spark)


def test_contracts(spark):
    df = spark.range(1)
    with pytest.raises(SchemaError):
        curate.curate_variants(df)
    with pytest.raises(SchemaError):
        require_types(df, {"id": "string"})
    assert require_types(df, {"id": "bigint"}) is df
    with pytest.raises(ValueError):
        curate.filter_values(df, "id", [])
    with pytest.raises(ValueError):
        curate.require_rows(df.filter("id > 5"), "empty")


def skewed(spark, n=4000):
    """A third of the rows in one gene, a tenth without a gene name."""
    gene = F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("G"), F.col("id") % 97)
    )
    return spark.range(n).select(
        F.col("id").alias("VariationID"), gene.alias("GeneSymbol"), (F.col("id") % 4 == 0).cast("int").alias("_y")
    )


def test_split_is_disjoint_complete_and_sized(spark):
    df = skewed(spark)
    split = splits.split_by_group(df).cache()
    assert split.count() == df.filter("GeneSymbol is not null").count()
    per_gene = split.groupBy("GeneSymbol").agg(F.countDistinct("split").alias("n"))
    assert per_gene.filter("n <> 1").isEmpty()
    groups = splits.majority_label(df, "GeneSymbol")
    assigned = splits.assign_groups(groups, "GeneSymbol").toPandas()
    for _, part in assigned.groupby("group_label"):
        k = round(0.1 * len(part))
        assert (part["split"] == "test").sum() == k and (part["split"] == "val").sum() == k


def test_half_goes_to_even(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "GeneSymbol string, _y int")
    got = {r[0]: r[1] for r in splits.majority_label(df, "GeneSymbol").collect()}
    assert got == {"a": 0, "b": 1}


def test_ranks_match_a_plain_sort(spark):
    df = skewed(spark).fillna("", ["GeneSymbol"])
    ranked = ranks.range_rank(df, ["GeneSymbol", "VariationID"], "r").toPandas()
    want = ranked.sort_values(["GeneSymbol", "VariationID"])["r"].tolist()
    assert want == list(range(1, len(want) + 1))
    hashed = ranks.hash_rank(df, F.col("VariationID").cast("string"), ["VariationID"], "r", ["GeneSymbol"])
    for _, part in hashed.toPandas().groupby("GeneSymbol"):
        assert sorted(part["r"]) == list(range(1, len(part) + 1))


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id"), F.lit("g").alias("g"))
    got = ranks.running_sums(df, ["k", "id"], {"s": "id"}, ["g"]).toPandas().sort_values(["k", "id"])
    assert (got["s"].to_numpy() == got["id"].cumsum().to_numpy()).all()


def test_balanced_sample(spark):
    df = spark.range(3000).select("id", (F.col("id") < 30).cast("int").alias("_y"))
    drawn = splits.balanced_sample(df, "id").toPandas()
    assert len(drawn) == 3000
    assert 1350 < drawn["_y"].sum() < 1650
    assert ((drawn["id"] < 30) == (drawn["_y"] == 1)).all()
    single = splits.balanced_sample(df.filter("_y = 0"), "id").toPandas()
    assert len(single) == 2970 and single["_y"].sum() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "_y int")
    got = {r["_y"]: (r["loss_weight"], r["sample_weight"]) for r in splits.class_weights(df).collect()}
    assert got == {1: (2.0, 1.0), 0: (4 / 6, 1 / 3)}
