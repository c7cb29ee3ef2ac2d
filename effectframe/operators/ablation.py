"""Ablation modes over features and prompts, all as lazy columns of one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe import constants as C
from effectframe.functions import vectors
from effectframe.operators import prompts
from effectframe.operators.features import Blocks
from effectframe.operators.metrics import deltas, evaluate
from effectframe.operators.ranks import hash_rank

BASELINE = "cond+prompt"


def permute_vectors(
    df: DataFrame, key: str, vec: str = "x", seed: int = 13, group: Sequence[str] = ()
) -> DataFrame:
    """Every row takes the vector of another row: a seeded bijection inside ``group``.

    Only keys are ranked; vectors move once, by the key they are taken from.
    """
    group = list(group)
    keys = df.select(key, *group)

    def ranked(tag: str, name: str) -> DataFrame:
        salt = F.concat_ws(":", F.lit(f"{seed}:{tag}"), F.col(key).cast("string"))
        return hash_rank(keys, salt, [key], "__rank", group).withColumnRenamed(key, name)

    pairs = ranked("row", key).join(ranked("source", "__source"), [*group, "__rank"])
    source = df.select(F.col(key).alias("__source"), F.col(vec).alias("__vec"))
    moved = pairs.select(key, "__source").join(source, "__source").select(key, "__vec")
    return df.join(moved, key).withColumn(vec, F.col("__vec")).drop("__vec")


def mode_rows(
    df: DataFrame,
    blocks: Blocks,
    key: str = "variation_key",
    vec: str = "x",
    keep: Sequence[str] = ("_y",),
    noise_std: float | None = 1.5,
    noise_alpha: float = 0.0,
    noise: bool = True,
    permute: bool = True,
    noise_only: bool = True,
    scales: Sequence[float] = (0.0, 0.25, 0.5, 1.0),
    seed: int = 13,
    group: Sequence[str] = (),
) -> DataFrame:
    """``(key, keep..., mode, x, prompt)``: every row once per mode, from one scan.

    All modes are expressions of the row; only the permuted vector needs a join.
    """
    v, k = F.col(vec), F.col(key)
    shown = {c.lower() for c in prompts.prompt_columns(df)}
    fields = {m: f for m, f in C.PROMPT_FIELD_MODES.items() if shown & set(f)}
    contexts = {"__full": (), **{f"__{m}": f for m, f in fields.items()}}
    if permute:
        moved = permute_vectors(df.select(key, *group, vec), key, vec, seed, group)
        df = df.join(moved.select(key, F.col(vec).alias("__permuted")), key)
    df = prompts.with_contexts(df, contexts)
    full = F.col("__full")
    modes = [
        (BASELINE, v, full),
        ("cond_only", v, F.lit("")),
        ("prompt_only", vectors.zero_all(v), full),
    ]
    for name in blocks.present():
        modes.append((f"cond_zero_{name}", vectors.zero_ranges(v, [blocks.span(name)]), full))
    modes += [(m, v, F.col(f"__{m}")) for m in fields]
    if noise:
        modes.append(("cond+noise", vectors.add_noise(v, k, seed, noise_std, noise_alpha), full))
    if permute:
        modes.append(("cond+permute", F.col("__permuted"), full))
    if noise_only:
        std = 1.0 if noise_std is None else noise_std
        modes.append(("pure-noise", vectors.pure_noise(v, k, seed, std), full))
    modes += [(f"cond×scale={s:g}", vectors.scale(v, s), full) for s in scales]
    variants = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), x.alias("x"), prompts.prompt_text(c).alias("prompt"))
            for m, x, c in modes
        ]
    )
    return df.select(key, *keep, *group, F.inline(variants))


def run_ablation(
    rows: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    label: str = "_y",
    prob: str = "prob",
    pred: str = "pred",
) -> tuple[DataFrame, DataFrame]:
    """(metrics per mode, deltas against the baseline) of ``mode_rows``. Runs a job.

    ``scorer`` adds the ``prob`` and ``pred`` columns.
    """
    scored = scorer(rows).select("mode", label, prob, pred)
    results = evaluate(scored, label, prob, pred, ["mode"])
    return results, deltas(results, BASELINE, ["accuracy", "f1", "roc_auc", "avg_precision"])


def noise_report(df: DataFrame, key: str, vec: str, noisy: str) -> DataFrame:
    """Norm before and after and the signal-to-noise ratio of every row."""
    return df.select(
        key,
        vectors.l2_norm(F.col(vec)).alias("norm_before"),
        vectors.l2_norm(F.col(noisy)).alias("norm_after"),
        vectors.signal_to_noise(F.col(vec), F.col(noisy)).alias("snr"),
    )
