"""Scores and binary classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectframe.operators import metrics, scoring
from effectframe.queries import standins as S
from effectframe.queries.base import query, table

_COUNTS_SQL = """
counts AS (
  SELECT lang, CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM (SELECT lang, y, CAST(prob >= 0.5 AS INTEGER) AS p FROM scored) GROUP BY 1
)"""


def _decided(spark, folder):
    return S.scored(spark, folder).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


@query("confusion", f"WITH {S.SCORED_SQL}, {_COUNTS_SQL.lstrip()} SELECT * FROM counts")
def confusion(spark, folder):
    return metrics.confusion(_decided(spark, folder), "y", "pred", ["lang"])


@query(
    "threshold_metrics",
    f"""WITH {S.SCORED_SQL}, {_COUNTS_SQL.lstrip()}
    SELECT lang, tn, fp, fn, tp, tn + fp + fn + tp AS n,
      round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 9) AS accuracy,
      round(CASE WHEN tp + fn = 0 THEN tn / CAST(tn + fp AS DOUBLE)
        WHEN tn + fp = 0 THEN tp / CAST(tp + fn AS DOUBLE)
        ELSE (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 END, 9) AS balanced_accuracy,
      round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 9) AS precision,
      round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 9) AS recall,
      round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), 9) AS specificity,
      round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 9) AS f1
    FROM counts""",
)
def threshold_metrics(spark, folder):
    rates = metrics.threshold_metrics(S.scored(spark, folder), "y", "prob", 0.5, ["lang"])
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1"]
    return rates.withColumns({c: F.round(c, 9) for c in names})


@query(
    "class_report",
    f"""WITH {S.SCORED_SQL}, {_COUNTS_SQL.lstrip()},
    classes AS (
      SELECT lang, 'Benign' AS label, tn / nullif(CAST(tn + fn AS DOUBLE), 0) AS precision,
        tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS recall,
        2 * tn / nullif(CAST(2 * tn + fp + fn AS DOUBLE), 0) AS f1, tn + fp AS support FROM counts
      UNION ALL
      SELECT lang, 'Pathogenic', tp / nullif(CAST(tp + fp AS DOUBLE), 0), tp / nullif(CAST(tp + fn AS DOUBLE), 0),
        2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), tp + fn FROM counts
    ),
    filled AS (
      SELECT lang, label, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall,
        coalesce(f1, 0) AS f1, support FROM classes
    ),
    lines AS (
      SELECT * FROM filled
      UNION ALL
      SELECT lang, 'accuracy', (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE),
        (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE),
        tn + fp + fn + tp FROM counts
      UNION ALL
      SELECT lang, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM filled GROUP BY 1
      UNION ALL
      SELECT lang, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM filled GROUP BY 1
    )
    SELECT lang, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
      support FROM lines""",
)
def class_report(spark, folder):
    counts = metrics.confusion(_decided(spark, folder), "y", "pred", ["lang"])
    report = metrics.class_report(counts, ["lang"])
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "roc_auc",
    f"""WITH {S.SCORED_SQL}
    SELECT round(sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END)
      / count(*), 9) AS roc_auc
    FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0""",
)
def roc_auc(spark, folder):
    areas = metrics.curve_areas(S.scored(spark, folder), "y", "prob")
    return areas.select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "avg_precision",
    f"""WITH {S.SCORED_SQL},
    folded AS (
      SELECT lang, prob, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2
    ),
    curve AS (
      SELECT lang, pos, sum(pos) OVER w AS cpos, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY lang) AS total
      FROM folded WINDOW w AS (PARTITION BY lang ORDER BY prob DESC)
    )
    SELECT lang, round(sum(pos / CAST(total AS DOUBLE) * cpos / cn), 9) AS avg_precision FROM curve GROUP BY 1""",
)
def avg_precision(spark, folder):
    areas = metrics.curve_areas(S.scored(spark, folder), "y", "prob", ["lang"])
    return areas.select("lang", F.round("avg_precision", 9).alias("avg_precision"))


_GRID_SQL = """
grid AS (SELECT i, i * CAST(0.005 AS DOUBLE) AS threshold FROM unnest(range(201)) AS u(i)),
swept AS (
  SELECT lang, i, threshold,
    sum(CASE WHEN y = 1 AND prob >= threshold THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND prob >= threshold THEN 1 ELSE 0 END) AS fp,
    sum(y) AS pos, count(*) - sum(y) AS neg
  FROM scored, grid GROUP BY 1, 2, 3
)"""


@query(
    "threshold_curve",
    f"""WITH {S.SCORED_SQL}, {_GRID_SQL.lstrip()}
    SELECT lang, CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp,
      CAST(fp AS BIGINT) AS fp, CAST(pos - tp AS BIGINT) AS fn, CAST(neg - fp AS BIGINT) AS tn FROM swept""",
)
def threshold_curve(spark, folder):
    curve = metrics.threshold_curve(S.scored(spark, folder), "y", "prob", group=["lang"])
    return curve.withColumn("threshold", F.round("threshold", 6))


@query(
    "best_threshold",
    f"""WITH {S.SCORED_SQL}, {_GRID_SQL.lstrip()},
    valued AS (
      SELECT lang, i, threshold, coalesce(2 * tp / nullif(CAST(tp + fp + pos AS DOUBLE), 0), 0) AS f1,
        CASE WHEN pos = 0 THEN (neg - fp) / CAST(neg AS DOUBLE) WHEN neg = 0 THEN tp / CAST(pos AS DOUBLE)
          ELSE (tp / CAST(pos AS DOUBLE) + (neg - fp) / CAST(neg AS DOUBLE)) / 2 END AS youden
      FROM swept
    ),
    best AS (
      SELECT lang, 'f1' AS criterion, threshold, f1 AS value, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, i) AS r FROM valued
      UNION ALL
      SELECT lang, 'youden', threshold, youden, row_number() OVER (PARTITION BY lang ORDER BY youden DESC, i) FROM valued
    )
    SELECT lang, criterion, round(threshold, 6) AS threshold, round(value, 9) AS value FROM best WHERE r = 1""",
)
def best_threshold(spark, folder):
    return metrics.best_thresholds(S.scored(spark, folder), "y", "prob", group=["lang"]).select(
        "lang", "criterion", F.round("threshold", 6).alias("threshold"), F.round("value", 9).alias("value")
    )


_TWO_CLASS_SQL = f"""
logs AS (
  SELECT {S.LINE_ID_SQL} AS line, l_linestatus, CAST(l_returnflag = 'A' AS INTEGER) AS y,
    greatest(-l_quantity / 10, CASE WHEN l_tax = 0 THEN CAST(-1e9 AS DOUBLE) ELSE ln(l_tax) END) AS b,
    -l_extendedprice / 20000 AS p
  FROM lineitem
),
two AS (
  SELECT line, l_linestatus, y, CAST(p > b AS INTEGER) AS pred,
    least(greatest(exp(p - (greatest(b, p) + ln(exp(b - greatest(b, p)) + exp(p - greatest(b, p))))), 0), 1) AS prob
  FROM logs
)"""


def _log_scores(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        S.line_id().alias("line"),
        "l_linestatus",
        (F.col("l_returnflag") == "A").cast("int").alias("y"),
        (-F.col("l_quantity") / 10).alias("lp_benign"),
        F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.ln("l_tax")).alias("lp_benign_2"),
        (-F.col("l_extendedprice") / 20000).alias("lp_pathogenic"),
    )


@query("two_class_score", f"WITH {_TWO_CLASS_SQL} SELECT line, pred, round(prob, 6) AS prob FROM two")
def two_class_score(spark, folder):
    scored = scoring.score_two_classes(
        _log_scores(spark, folder), ["lp_benign", "lp_benign_2"], "lp_pathogenic"
    )
    return scored.select("line", "pred", F.round("prob", 6).alias("prob"))


@query(
    "evaluate_scores",
    f"""WITH {_TWO_CLASS_SQL},
    folded AS (SELECT l_linestatus, prob, sum(y) AS pos, sum(1 - y) AS neg FROM two GROUP BY 1, 2),
    curve AS (
      SELECT l_linestatus, pos, neg, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg
      FROM folded WINDOW w AS (PARTITION BY l_linestatus ORDER BY prob DESC)
    ),
    areas AS (
      SELECT l_linestatus, sum(neg * (cpos - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc,
        sum(pos * CAST(cpos AS DOUBLE) / (cpos + cneg)) / sum(pos) AS avg_precision
      FROM curve GROUP BY 1
    ),
    counts AS (
      SELECT l_linestatus, count(*) AS n, sum(y * pred) AS tp, sum(pred) AS pp, sum(y) AS yp,
        avg(CASE WHEN y = pred THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy FROM two GROUP BY 1
    )
    SELECT l_linestatus, n, round(accuracy, 9) AS accuracy,
      round(tp / CAST(pp AS DOUBLE), 9) AS precision, round(tp / CAST(yp AS DOUBLE), 9) AS recall,
      round(2 * tp / CAST(pp + yp AS DOUBLE), 9) AS f1, round(roc_auc, 6) AS roc_auc,
      round(avg_precision, 6) AS avg_precision
    FROM counts JOIN areas USING (l_linestatus)""",
)
def evaluate_scores(spark, folder):
    _, report = scoring.evaluate_scores(
        _log_scores(spark, folder), ["lp_benign", "lp_benign_2"], "lp_pathogenic", "y", ["l_linestatus"]
    )
    return report.select(
        "l_linestatus",
        "n",
        *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
        *[F.round(c, 6).alias(c) for c in ("roc_auc", "avg_precision")],
    )
