import math
import random

import pytest
from pyspark.sql import functions as F

from effectframe.operators import metrics, scoring

Y = [1, 0, 1, 1, 0, 0]
P = [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]


def frame(spark, y=Y, p=P, group="all"):
    return spark.createDataFrame([(group, a, b) for a, b in zip(y, p)], "g string, y int, p double")


def brute_auc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(p, y) for b, j in zip(p, y) if i == 1 and j == 0]
    return sum(pairs) / len(pairs)


def brute_ap(y, p):
    total, out, last = sum(y), 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        hits = [a for a, b in zip(y, p) if b >= cut]
        recall = sum(hits) / total
        out += (recall - last) * sum(hits) / len(hits)
        last = recall
    return out


def test_fixture(spark):
    row = metrics.curve_areas(frame(spark), "y", "p").first()
    assert math.isclose(row["roc_auc"], 7 / 9) and round(row["avg_precision"], 6) == 0.755556
    at = metrics.threshold_metrics(frame(spark), "y", "p").first()
    assert (at["tp"], at["fp"], at["fn"], at["tn"]) == (2, 1, 1, 2)
    best = metrics.best_threshold(frame(spark), "y", "p").first()
    assert math.isclose(best["threshold"], 0.105) and best["value"] == 0.75


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    data = {}
    for g, n in (("big", 600), ("small", 40)):
        y = [rng.randint(0, 1) for _ in range(n)]
        # A third of all scores sit on one value.
        p = [0.5 if i % 3 == 0 else round(rng.random() * (0.6 + 0.4 * a), 2) for i, a in enumerate(y)]
        data[g] = (y, p)
    df = frame(spark, *data["big"], "big").unionByName(frame(spark, *data["small"], "small"))
    got = {r["g"]: r for r in metrics.curve_areas(df, "y", "p", ["g"]).collect()}
    for g, (y, p) in data.items():
        assert math.isclose(got[g]["roc_auc"], brute_auc(y, p), abs_tol=1e-12)
        assert math.isclose(got[g]["avg_precision"], brute_ap(y, p), abs_tol=1e-12)


def test_every_threshold_against_brute_force(spark):
    rng = random.Random(9)
    p = [i * 0.005 for i in range(201)] + [rng.random() for _ in range(99)]
    y = [rng.randint(0, 1) for _ in p]
    curve = metrics.threshold_curve(frame(spark, y, p), "y", "p").collect()
    assert len(curve) == 201
    for r in curve:
        cut = r["i"] * 0.005
        assert r["tp"] == sum(a for a, b in zip(y, p) if b >= cut)
        assert r["fp"] == sum(1 - a for a, b in zip(y, p) if b >= cut)
        assert r["tp"] + r["fn"] == sum(y) and r["fp"] + r["tn"] == len(y) - sum(y)


def test_youden_and_bad_criterion(spark):
    row = metrics.best_threshold(frame(spark), "y", "p", "youden").first()
    assert math.isclose(row["value"], 2 / 3)
    with pytest.raises(ValueError):
        metrics.best_threshold(frame(spark), "y", "p", "acc")


def test_one_class(spark):
    row = metrics.curve_areas(frame(spark, [1, 1], [0.2, 0.3]), "y", "p").first()
    assert math.isnan(row["roc_auc"]) and row["avg_precision"] == 1.0
    row = metrics.curve_areas(frame(spark, [0, 0], [0.2, 0.3]), "y", "p").first()
    assert math.isnan(row["roc_auc"]) and row["avg_precision"] == 0.0
    at = metrics.threshold_metrics(frame(spark, [0, 0], [0.2, 0.6]), "y", "p").first()
    assert (at["precision"], at["recall"], at["f1"], at["balanced_accuracy"]) == (0, 0, 0, 0.5)


def test_published_confusion_matrix(spark):
    conf = spark.createDataFrame([(24635, 664, 1012, 6157)], "tn long, fp long, fn long, tp long")
    r = metrics.with_rates(conf).first()
    assert [round(r[c], 3) for c in ("accuracy", "precision", "recall", "f1")] == [0.948, 0.903, 0.859, 0.880]
    report = {x["label"]: x for x in metrics.class_report(conf).collect()}
    assert report["Pathogenic"]["support"] == 7169 and report["accuracy"]["support"] == 32468
    assert math.isclose(
        report["macro avg"]["recall"], (report["Benign"]["recall"] + report["Pathogenic"]["recall"]) / 2
    )


def test_published_deltas(spark):
    rows = [("cond+prompt", 0.8660, 0.8270), ("cond_only", 0.6876, 0.3796), ("cond+noise", 0.7876, 0.7269)]
    df = spark.createDataFrame(rows, "mode string, accuracy double, f1 double")
    got = {r["mode"]: (round(r["delta_accuracy"], 4), round(r["delta_f1"], 4)) for r in metrics.deltas(df, "cond+prompt", ["accuracy", "f1"]).collect()}
    assert got == {"cond_only": (-0.1784, -0.4474), "cond+noise": (-0.0784, -0.1001)}


def test_two_class_scores(spark):
    rows = [("a", 1, -1.0, -1.0), ("b", 1, -2000.0, -1.0), ("c", 0, float("nan"), float("-inf")), ("d", 0, None, -3.0)]
    df = spark.createDataFrame(rows, "key string, y int, lp_benign double, lp_pathogenic double")
    got = {r["key"]: (r["prob"], r["pred"]) for r in scoring.score_two_classes(df, "lp_benign", "lp_pathogenic").collect()}
    assert got["a"] == (0.5, 0) and got["b"] == (1.0, 1) and got["c"] == (0.5, 0) and got["d"] == (1.0, 1)
    best = scoring.score_two_classes(df, ["lp_benign", "lp_pathogenic"], "lp_pathogenic").first()
    assert best["prob"] == 0.5


def test_evaluation_agrees_with_its_parts(spark):
    df = frame(spark).withColumns({"split": F.lit("val"), "lp_benign": F.ln(1 - F.col("p")), "lp_pathogenic": F.ln("p")})
    predictions, report = scoring.evaluate_scores(df, group=["split"])
    assert {"_pred_pathogenic_prob", "_pred_label"} <= set(predictions.columns)
    row = report.first()
    assert math.isclose(row["roc_auc"], 7 / 9) and (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 1, 2)
