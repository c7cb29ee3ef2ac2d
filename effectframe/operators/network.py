"""A weighted two-class network, trained in steps over row blocks.

Rows are dealt once over blocks by the hash of their key and packed; a step's blocks lie in
one folder, so a step reads nothing else. Tasks compute the gradient of each block, sums
meet in two levels in block order, and one optimiser state goes from step to step. It holds
the layers only, whatever the data. Dropout hashes (seed, epoch, layer, unit, key): neither
the layout nor a lost executor changes a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.operators.metrics import curve_areas
from effectframe.session import cut_lineage, ensure_checkpoint_dir

BLOCK_ROWS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    """Rate, decay and dropout; rows of a step; when the rate halves and when training ends, in epochs without gain."""

    lr: float = 1e-3
    weight_decay: float = 1e-4
    dropout: float = 0.2
    batch_rows: int = 65_536
    epochs: int = 20
    halve_after: int = 2
    patience: int = 5
    clip: float = 1.0
    seed: int = 0


@dataclass
class Network:
    """Weights and biases by layer; rectified between layers, one logit at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def start(sizes: Sequence[int], seed: int) -> Network:
        draw = np.random.default_rng(seed)
        pairs = zip(sizes, [*sizes[1:], 1], strict=True)
        return Network([(draw.uniform(-1, 1, (a, b)) / np.sqrt(a), draw.uniform(-1, 1, b) / np.sqrt(a)) for a, b in pairs])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def filled(self, flat: np.ndarray) -> Network:
        layers, at = [], 0
        for layer in self.layers:
            made = []
            for p in layer:
                made.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            layers.append(tuple(made))
        return Network(layers)

    def logits(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers[-1]
        return (x @ w + b)[:, 0]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, masks: Sequence[np.ndarray]) -> tuple[float, np.ndarray]:
        """Summed weighted cross-entropy and its gradient; ``masks`` scale the hidden units of each row."""
        inputs, hidden = [x], []
        for (w, b), mask in zip(self.layers[:-1], masks, strict=True):
            hidden.append(inputs[-1] @ w + b)
            inputs.append(np.maximum(hidden[-1], 0) * mask)
        w, b = self.layers[-1]
        z = (inputs[-1] @ w + b)[:, 0]
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        back = (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None]
        found: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            found = [(inputs[k].T @ back).ravel(), back.sum(axis=0), *found]
            if k:
                back = back @ self.layers[k][0].T * masks[k - 1] * (hidden[k - 1] > 0)
        return loss, np.concatenate(found)


def dropout_mask(keys: np.ndarray, units: int, share: float, draw: int) -> np.ndarray:
    """0 for a ``share`` of the cells, the others scaled up, by hash of key, unit and draw."""
    at = keys.view(np.uint64)[:, None] ^ (np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at ^= np.uint64(draw * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        at = (at ^ (at >> np.uint64(32))) * _STEP
    return ((at >> np.uint64(11)) / 2.0**53 >= share) / (1 - share)


@dataclass
class _Adam:
    """One step of Adam with decay of the weights beside it."""

    size: int
    lr: float
    decay: float
    clip: float
    steps: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self):
        self.first, self.second = np.zeros(self.size), np.zeros(self.size)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient = gradient * min(1.0, self.clip / (np.linalg.norm(gradient) + 1e-6))
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        return at * (1 - self.lr * self.decay) - self.lr * mean / (np.sqrt(spread) + 1e-8)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vectors), -1)


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    made = [rows["key"].to_numpy().tobytes(), _matrix(rows["x"]).tobytes(), rows["y"].to_numpy().astype(np.int8).tobytes()]
    return pa.table({"step": rows["step"][:1], "block": rows["block"][:1], **{c: pa.array([m], pa.binary()) for c, m in zip(("key", "x", "y"), made, strict=True)}})


def _blocks(train: DataFrame, key: str, vec: str, label: str, how: Training) -> tuple[str, int, tuple[int, int]]:
    """(folder of packed blocks by step, steps, rows of both classes). Runs jobs."""
    rows = train.select(F.xxhash64(F.lit(how.seed), F.col(key).cast("string")).alias("key"), F.col(vec).cast("array<float>").alias("x"), (F.col(label) > 0).cast("int").alias("y"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    steps = max(1, -(-n // how.batch_rows))
    blocks = max(1, -(-n // BLOCK_ROWS))
    blocks = -(-blocks // steps) * steps
    block = F.pmod(F.col("key"), F.lit(blocks)).cast("int")
    placed = rows.select((block % steps).alias("step"), block.alias("block"), "key", "x", "y")
    packed = placed.groupBy("step", "block").applyInArrow(_pack, "step int, block int, key binary, x binary, y binary")
    folder = f"{ensure_checkpoint_dir(train.sparkSession)}/network-{uuid.uuid4().hex}"
    packed.write.partitionBy("step").parquet(folder)
    return folder, steps, (n - positive, positive)


def _gradients(shared, weights: tuple[float, float], dim: int, dropout: float, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        units = [len(b) for _, b in network.layers[:-1]]
        for batch in batches:
            for row in batch.to_pylist():
                x, y = np.frombuffer(row["x"], np.float32).reshape(-1, dim).astype(np.float64), np.frombuffer(row["y"], np.int8)
                keys = np.frombuffer(row["key"], np.int64)
                masks = [dropout_mask(keys, u, dropout, epoch * len(units) + k) if dropout else np.ones((1, u)) for k, u in enumerate(units)]
                loss, gradient = network.loss_and_gradient(x, y, np.where(y == 1, weights[1], weights[0]), masks)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["block", "n", "loss", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("block")
    total = sum(np.frombuffer(s, np.float64) for s in rows["sums"].to_pylist())
    columns = [pa.array(v, k) for v, k in (([rows["block"][0].as_py()], pa.int32()), ([sum(rows["n"].to_pylist())], pa.int64()), ([sum(rows["loss"].to_pylist())], pa.float64()), ([total.tobytes()], pa.binary()))]
    return pa.table(dict(zip(("block", "n", "loss", "sums"), columns, strict=True)))


def with_probability(df: DataFrame, network: Network, vec: str, out: str = "prob") -> DataFrame:
    """``df`` with the network's probability; null for a null vector. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    names = df.columns
    at = names.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = np.full(batch.num_rows, np.nan)
            real = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
            if len(real):
                prob[real] = 1 / (1 + np.exp(-np.clip(shared.value.logits(_matrix(batch.column(at).take(pa.array(real))).astype(np.float64)), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prob, mask=np.isnan(prob))], [*names, out])

    schema = df.withColumn(out, F.lit(None).cast("double")).schema
    return df.mapInArrow(run, schema)


def fit_network(
    train: DataFrame, watched: DataFrame | None, dim: int, key: str, vec: str = "features", label: str = "_y",
    hidden: Sequence[int] = (512, 256), how: Training = Training(), metric: str = "roc_auc",
) -> tuple[Network, list[dict]]:
    """(network of the best epoch, one record per epoch). Runs jobs.

    A class weighs rows / (2 * its rows). After every epoch ``metric`` of ``watched`` is taken; the rate
    halves after ``halve_after`` epochs in a row without gain and training ends after ``patience``.
    Without ``watched`` all epochs run and the last one stays. Rows without vector or label are
    left out; without any row the network stays as it started.
    """
    spark = train.sparkSession
    folder, steps, counts = _blocks(train, key, vec, label, how)
    weights = tuple(sum(counts) / (2.0 * max(1, c)) for c in counts)
    network = Network.start([dim, *hidden], how.seed)
    state = _Adam(len(network.flat()), how.lr, how.weight_decay, how.clip)
    held = None if watched is None else cut_lineage(watched.select(vec, label))
    best, kept, waiting, plateau, history = -np.inf, network, 0, 0, []
    for epoch in range(how.epochs if sum(counts) else 0):
        loss = 0.0
        for step in np.random.default_rng([how.seed, epoch]).permutation(steps).tolist():
            shared = spark.sparkContext.broadcast(network)
            found = spark.read.parquet(folder).filter(F.col("step") == step).select("block", "key", "x", "y")
            sums = found.mapInArrow(_gradients(shared, weights, dim, how.dropout, epoch), "block int, n long, loss double, sums binary")
            blocks = -(-(-(-sum(counts) // BLOCK_ROWS)) // steps)
            groups = isqrt(max(0, blocks - 1)) + 1
            met = sums.groupBy(F.pmod((F.col("block") / steps).cast("int"), F.lit(groups))).applyInArrow(_added, "block int, n long, loss double, sums binary")
            # One row per group of blocks, of the size of the network.
            parts = sorted(met.collect(), key=lambda r: r["block"])
            shared.unpersist()
            if not parts:
                continue
            n = sum(r["n"] for r in parts)
            gradient = sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in parts)
            network = network.filled(state.step(network.flat(), gradient / n))
            loss += sum(r["loss"] for r in parts)
        record = {"epoch": epoch, "loss": loss / sum(counts), "lr": state.lr}
        history.append(record)
        if held is None:
            kept = network
            continue
        value = curve_areas(with_probability(held, network, vec), label, "prob").first()[metric]
        record[metric] = value
        if value > best + 1e-5:
            best, kept, waiting, plateau = value, network, 0, 0
        else:
            waiting, plateau = waiting + 1, plateau + 1
            if plateau > how.halve_after:
                state.lr, plateau = state.lr / 2, 0
            if waiting >= how.patience:
                break
    return kept, history
