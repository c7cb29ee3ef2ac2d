"""Score tables: log-scores to probability, decision and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.functions import scores
from effectframe.operators.metrics import evaluate


def score_two_classes(
    df: DataFrame, benign: Sequence[str] | str, pathogenic: Sequence[str] | str
) -> DataFrame:
    """Adds ``prob`` and ``pred``; several columns per class are spellings of its word."""

    def best(columns: Sequence[str] | str):
        names = [columns] if isinstance(columns, str) else list(columns)
        return scores.best_log_score([F.col(c) for c in names])

    b, p = best(benign), best(pathogenic)
    return df.withColumns(
        {"prob": scores.pathogenic_probability(b, p), "pred": scores.predicted_label(b, p)}
    )


def evaluate_scores(
    df: DataFrame,
    benign: Sequence[str] | str = "lp_benign",
    pathogenic: Sequence[str] | str = "lp_pathogenic",
    label: str = "y",
    group: Sequence[str] = ("split",),
) -> tuple[DataFrame, DataFrame]:
    """(input rows with prediction columns, metrics per group). Runs a job."""
    scored = score_two_classes(df, benign, pathogenic)
    metrics = evaluate(scored, label, "prob", "pred", group)
    predictions = scored.withColumnsRenamed(
        {"prob": "_pred_pathogenic_prob", "pred": "_pred_label"}
    )
    return predictions, metrics
