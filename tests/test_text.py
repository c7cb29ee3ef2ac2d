import hashlib

from pyspark.sql import functions as F

from effectframe.functions import text


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_and_nonempty_treat_nan_differently(spark):
    rows = [None, "", " \t", " nan ", "NaN", " a "]
    assert values(spark, rows, text.clean_str) == ["", "", "", "", "", "a"]
    assert values(spark, rows, text.is_nonempty) == [False, False, False, True, True, True]


def test_protein_names(spark):
    rows = ["ENSP00000268712.2", "XP_1.2", None]
    assert values(spark, rows, text.strip_protein_version) == ["ENSP00000268712", "XP_1.2", None]
    rows = ["ENSP1.2:p.Arg2132=", "p.A1B|x", "c.1A>G", None]
    assert values(spark, rows, text.protein_change) == ["p.Arg2132=", "p.A1B", None, None]
    rows = ["ENST1:c.1A>G", "c.2", "a:b:c", None]
    assert values(spark, rows, text.strip_reference_prefix) == ["c.1A>G", "c.2", "b:c", None]


def test_join_terms(spark):
    df = spark.createDataFrame(
        [(["a", "", None, "b"],), ([None, ""],), ([],), (None,)], "v array<string>"
    )
    got = [r[0] for r in df.select(text.join_terms(F.col("v"))).collect()]
    assert got == ["a,b", None, None, None]


def test_sanitize(spark):
    assert values(spark, ["acgtn", "AXß-", ""], text.sanitize_dna) == ["ACGTN", "ANNN", ""]
    assert values(spark, ["M-KB*", None, "acz"], text.sanitize_protein) == ["MKXX", "", "ACX"]


def test_term_ids(spark):
    rows = ["http://x/GO_0000001", "GO:0000002", "GO:12", None]
    assert values(spark, rows, text.normalize_term_id) == ["GO:0000001", "GO:0000002", None, None]


def test_pretty_terms(spark):
    rows = ["a_b,A_b,c", "missense_variant", " , ,", None, "nan", "x, X ,y_z,"]
    want = ["a b, c", "missense variant", "", "", "", "x, y z"]
    assert values(spark, rows, text.pretty_terms) == want


def test_sha_prefix(spark):
    want = [hashlib.sha256(s.encode()).hexdigest()[:10] for s in ("abc", "")]
    assert values(spark, ["abc", None], text.sha_prefix) == want


def test_chat_text(spark):
    rows = ["<think>a\nb</think> Benign", "</THINK>x", "```json\n1```", "```only", None]
    assert values(spark, rows, text.sanitize_model_text) == ["Benign", "x", "", "```only", ""]
