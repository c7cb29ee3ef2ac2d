"""Two-class probability from log-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from effectframe.constants import WORST_LOG_SCORE


def finite_log_score(col: Column) -> Column:
    """Null, NaN and infinite log-scores count as the worst one."""
    c = col.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(WORST_LOG_SCORE)).otherwise(c)


def best_log_score(cols: Sequence[Column]) -> Column:
    """Best of several spellings of one label; the worst score when there is none."""
    scores = [finite_log_score(c) for c in cols]
    if not scores:
        return F.lit(WORST_LOG_SCORE)
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def pathogenic_probability(lp_benign: Column, lp_pathogenic: Column) -> Column:
    """Two-class soft-max of the log-scores.

    Written with their difference, which neither overflows nor loses digits when
    both scores are very low; the value stays within 0 and 1.
    """
    return 1.0 / (1.0 + F.exp(lp_benign - lp_pathogenic))


def predicted_label(lp_benign: Column, lp_pathogenic: Column) -> Column:
    """1 only when the pathogenic score is strictly higher: a tie is benign."""
    return (lp_pathogenic > lp_benign).cast("int")
