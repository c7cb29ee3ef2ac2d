"""Probe classifiers on feature blocks with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.functions import vectors
from effectframe.operators.features import Blocks, fit_zscore
from effectframe.operators.metrics import best_threshold, curve_areas, threshold_metrics
from effectframe.operators.network import Training, fit_network, with_probability
from effectframe.operators.splits import balanced_sample, with_class_weight
from effectframe.session import cut_lineage

MODES = ("dna", "go", "dna+go", "prot", "dna+prot", "go+prot", "dna+go+prot")


def available_modes(blocks: Blocks) -> list[str]:
    return [m for m in MODES if set(m.split("+")) <= set(blocks.present())]


def mode_vector(blocks: Blocks, mode: str, vec: str = "x"):
    """The blocks of a mode, in the order of the full vector."""
    if mode not in available_modes(blocks):
        raise ValueError(f"mode {mode!r} needs a block which is absent")
    parts = []
    for name in mode.split("+"):
        start, end = blocks.span(name)
        parts.append(vectors.slice_block(F.col(vec), start, end - start))
    return vectors.concat_blocks(parts)


def probe_rows(
    df: DataFrame, blocks: Blocks, vec: str = "x", gene: str = "GeneSymbol", label: str = "_y",
    limit: int | None = None, key: str = "variation_key",
) -> DataFrame:
    """``(key, dna, gene, label)`` for graph probes, the first ``limit`` by key if given."""
    rows = df.select(
        key,
        vectors.slice_block(F.col(vec), 0, blocks.dna).alias("dna"),
        F.nullif(F.trim(F.col(gene)), F.lit("")).alias("gene"),
        F.col(label).alias(label),
    )
    return rows if limit is None else rows.orderBy(key).limit(limit)


def standardized(train: DataFrame, other: Sequence[DataFrame], vec: str = "features"):
    """``train`` and ``other`` z-scored with the statistics of ``train``."""
    scaler = fit_zscore(train, vec)
    scaled = [d.withColumn(vec, scaler.apply(F.col(vec))) for d in (train, *other)]
    return [d.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>"))) for d in scaled]


def logistic_scores(
    train: DataFrame, other: Sequence[DataFrame], label: str = "_y", reg: float = 1e-4, weighted: bool = False
) -> list[DataFrame]:
    """``other`` frames with ``prob`` from a logistic probe on ``features``. Runs jobs."""
    fit, *rest = standardized(train, other)
    if weighted:
        fit = with_class_weight(fit, label)
    estimator = LogisticRegression(
        featuresCol="__v", labelCol=label, regParam=reg, elasticNetParam=0.0,
        standardization=False, maxIter=100, tol=1e-4, probabilityCol="__p",
        rawPredictionCol="__raw", predictionCol="__pred",
    )
    if weighted:
        estimator = estimator.setWeightCol("weight")
    model = estimator.fit(fit)
    return [_with_probability(model.transform(d)) for d in rest]


def perceptron_scores(
    train: DataFrame, other: Sequence[DataFrame], dim: int, key: str, label: str = "_y",
    hidden: Sequence[int] = (512, 256), max_iter: int = 100, seed: int = 0,
    validation: DataFrame | None = None, metric: str = "roc_auc", slice_iter: int = 10, patience: int = 3,
) -> list[DataFrame]:
    """``other`` frames with ``prob`` from a network on a balanced resample. Runs jobs.

    With ``validation`` training goes on in slices of ``slice_iter`` iterations and stops
    when ``metric`` (``roc_auc`` or ``avg_precision``) has not grown for ``patience``
    slices; the weights of the best slice are used.
    """
    if metric not in ("roc_auc", "avg_precision"):
        raise ValueError("metric must be 'roc_auc' or 'avg_precision'")
    held = [] if validation is None else [validation]
    fit, *rest = standardized(train, [*held, *other])
    balanced = balanced_sample(fit.select(key, label, "__v"), key, label, seed)
    trainer = MultilayerPerceptronClassifier(
        featuresCol="__v", labelCol=label, layers=[dim, *hidden, 2],
        maxIter=max_iter, seed=seed, probabilityCol="__p", rawPredictionCol="__raw",
        predictionCol="__pred",
    )
    if validation is None:
        model = trainer.fit(balanced)
        return [_with_probability(model.transform(d)) for d in rest]
    # Every slice reads both again.
    balanced, watched = cut_lineage(balanced), cut_lineage(rest.pop(0))
    best, model, since = None, None, 0
    for _ in range(-(-max_iter // slice_iter)):
        now = trainer.setMaxIter(slice_iter).fit(balanced)
        value = curve_areas(_with_probability(now.transform(watched)), label, "prob").first()[metric]
        if best is None or value > best:
            best, model, since = value, now, 0
        else:
            since += 1
        if since >= patience:
            break
        trainer = trainer.setInitialWeights(now.weights)
    return [_with_probability(model.transform(d)) for d in rest]


def network_scores(
    train: DataFrame, other: Sequence[DataFrame], dim: int, key: str, label: str = "_y",
    hidden: Sequence[int] = (512, 256), how: Training = Training(),
    validation: DataFrame | None = None, metric: str = "roc_auc",
) -> list[DataFrame]:
    """``other`` frames with ``prob`` from a class-weighted network with dropout. Runs jobs (see ``fit_network``)."""
    if metric not in ("roc_auc", "avg_precision"):
        raise ValueError("metric must be 'roc_auc' or 'avg_precision'")
    scaler = fit_zscore(train, "features")
    scaled = lambda d: d.withColumn("features", scaler.apply(F.col("features")))
    watched = None if validation is None else scaled(validation)
    network, _ = fit_network(scaled(train), watched, dim, key, "features", label, hidden, how, metric)
    return [with_probability(scaled(d), network, "features") for d in other]


def _with_probability(scored: DataFrame) -> DataFrame:
    prob = F.element_at(vector_to_array("__p"), 2)
    return scored.withColumn("prob", prob).drop("__v", "__p", "__raw", "__pred")


def probe_report(scored: DataFrame, label: str = "_y", criterion: str = "youden") -> DataFrame:
    """Rows (mode, split, at): metrics at 0.5 and at the best validation threshold. Runs jobs.

    ``scored`` has ``mode``, ``split`` (val, test), the label and ``prob``.
    """
    val = scored.filter(F.col("split") == "val")
    best = best_threshold(val, label, "prob", criterion, group=["mode"])
    cuts = best.select("mode", F.lit("best").alias("at"), "threshold").unionByName(
        best.select("mode", F.lit("0.5").alias("at"), F.lit(0.5).alias("threshold"))
    )
    # Two thresholds per mode: every scored row is decided twice.
    decided = scored.join(F.broadcast(cuts), "mode")
    keys = ["mode", "split", "at", "threshold"]
    rates = threshold_metrics(decided, label, "prob", F.col("threshold"), keys)
    return rates.join(curve_areas(scored, label, "prob", ["mode", "split"]), ["mode", "split"])


def score_mode(
    features: DataFrame, blocks: Blocks, mode: str, model: str = "logistic", label: str = "_y",
    key: str = "variation_key", seed: int = 0, hidden: Sequence[int] = (512, 256), max_iter: int = 100,
    training: dict | None = None,
) -> DataFrame:
    """``(mode, split, label, prob)`` of validation and test, fitted on train. Runs jobs.

    ``training`` holds settings of the network besides epochs (``max_iter``) and seed.
    """
    base = features.select(
        key, "split", F.col(label).cast("int").alias(label), mode_vector(blocks, mode).alias("features")
    )
    train, rest = base.filter(F.col("split") == "train"), base.filter(F.col("split") != "train")
    if model == "logistic":
        (scored,) = logistic_scores(train, [rest], label, weighted=True)
    elif model == "perceptron":
        dim = sum(getattr(blocks, b) for b in mode.split("+"))
        held = rest.filter(F.col("split") == "val")
        (scored,) = perceptron_scores(train, [rest], dim, key, label, hidden, max_iter, seed, validation=held)
    elif model == "network":
        dim = sum(getattr(blocks, b) for b in mode.split("+"))
        held = rest.filter(F.col("split") == "val")
        how = Training(epochs=max_iter, seed=seed, **(training or {}))
        (scored,) = network_scores(train, [rest], dim, key, label, hidden, how, held)
    else:
        raise ValueError("model must be 'logistic', 'perceptron' or 'network'")
    return scored.select(F.lit(mode).alias("mode"), "split", label, "prob")


def run_probe_modes(
    features: DataFrame, blocks: Blocks, modes: Sequence[str] | None = None, label: str = "_y",
    criterion: str = "youden", **options,
) -> DataFrame:
    """One fit per feature mode (all available ones by default), one joint report. Runs jobs."""
    scored = None
    for mode in modes or available_modes(blocks):
        rows = score_mode(features, blocks, mode, label=label, **options)
        scored = rows if scored is None else scored.unionByName(rows)
    return probe_report(scored, label, criterion)
