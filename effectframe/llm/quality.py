"""Ordinal quality classifier: a cumulative-link regression on hashed text.

Graded ratings are predicted with one weight per hashed feature, shared by all grades,
and ordered thresholds: ``P(grade <= k) = sigmoid(threshold_k - score)``. The expected
grade and the tail ``P(grade >= k)`` follow from the score. Features are the words
that occur in a text, the shapes of its words (letter case, digits, marks), shapes that
are frequent in it, and whether words repeat at once.

The model is fitted on a bounded sample of rated documents; scoring reads whole texts
and has no shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe.llm.give_back import at_end

#: Rated documents the model is fitted on at most, hashed features, least documents per feature, penalty.
SAMPLE = 20_000
BITS = 18
LEAST_DOCS = 5
PENALTY = 1.0
KEEP_AT = 0.5
_MEMO = 200_000
_OFTEN = 0.1
_BACK = 500


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each, marks as themselves, of the whole word."""
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    return "".join(k for k, _ in groupby(map(kind, word)))


class _Words(dict):
    """(slot of the word, its shape) per word."""

    def __missing__(self, word: str) -> tuple[int, str]:
        made = _slot("word", word.lower()), _shape(word)
        if len(self) >= _MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


_KNOWN = _Words()


def _forget() -> None:
    _KNOWN.clear()


def text_slots(text: str | None) -> set[int]:
    """Slots of the features a text has; none for an empty one."""
    words = (text or "").split()
    if not words:
        return set()
    slots: set[int] = set()
    shapes: Counter[str] = Counter()
    for word, count in Counter(words).items():
        slot, shape = _KNOWN[word]
        slots.add(slot)
        shapes[shape] += count
    for shape, count in shapes.items():
        slots.add(_slot("shape", shape))
        if count >= _OFTEN * len(words):
            slots.add(_slot("often", shape))
    if sum(map(eq, words, words[1:])) >= _OFTEN * len(words):
        slots.add(_slot("again", ""))
    return slots


@dataclass(frozen=True)
class OrdinalModel:
    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _loss(at: np.ndarray, rows: np.ndarray, slots: np.ndarray, n: int, width: int, grade: np.ndarray, penalty: float):
    """Penalised negative log-likelihood and gradient; thresholds are a first one and log gaps."""
    weights, gaps = at[:width], np.exp(at[width + 1 :])
    thresholds = np.cumsum(np.r_[at[width], gaps])
    score = np.bincount(rows, weights[slots], n)
    edges = np.r_[-np.inf, thresholds, np.inf]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    upper, lower = sig(edges[grade + 1] - score), sig(edges[grade] - score)
    lower[grade == 0] = 0.0
    upper[grade == len(thresholds)] = 1.0
    p = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
    d_score = d_upper - d_lower  # of the loss
    d_edges = np.bincount(grade, -d_upper, len(thresholds) + 1)[: len(thresholds)]
    d_edges += np.bincount(grade, d_lower, len(thresholds) + 1)[1:]
    later = np.cumsum(d_edges[::-1])[::-1]
    gradient = np.r_[np.bincount(slots, d_score[rows], width) + penalty * weights, later[0], later[1:] * gaps]
    return -np.log(p).sum() + penalty / 2 * (weights @ weights), gradient


def _minimise(function, start: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    at, (value, slope) = start, function(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-3:
            break
        direction, used = -slope, []
        for move, turn, scale in reversed(moves):
            a = scale * (move @ direction)
            direction = direction - a * turn
            used.append(a)
        if moves:
            move, turn, scale = moves[-1]
            direction = direction / (scale * (turn @ turn))
        else:
            direction = direction / max(1.0, np.abs(slope).sum())
        for (move, turn, scale), a in zip(moves, reversed(used), strict=True):
            direction = direction + (a - scale * (turn @ direction)) * move
        step, down = 1.0, slope @ direction
        while True:
            now = at + step * direction
            new, bend = function(now)
            if new <= value + 1e-4 * step * down or step < 1e-8:
                break
            step /= 2
        move, turn = now - at, bend - slope
        if move @ turn > 1e-12:
            moves = [*moves[1 - memory :], (move, turn, 1.0 / (move @ turn))]
        done = value - new < 1e-7 * max(1.0, abs(value))
        at, value, slope = now, new, bend
        if done:
            break
    return at


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, levels: int, least_docs: int = LEAST_DOCS, penalty: float = PENALTY) -> OrdinalModel:
    """The model for grades 0 to ``levels - 1``. Without any row all grades are equally likely."""
    n = len(grades)
    counts = np.bincount(np.concatenate(features), minlength=1 << BITS) if n else np.zeros(1 << BITS, np.int64)
    known = np.flatnonzero(counts >= least_docs)
    place = np.full(1 << BITS, -1)
    place[known] = np.arange(len(known))
    rows = np.repeat(np.arange(n), [len(f) for f in features]) if n else np.zeros(0, np.int64)
    slots = place[np.concatenate(features)] if n else np.zeros(0, np.int64)
    rows, slots = rows[slots >= 0], slots[slots >= 0]
    share = np.cumsum(np.bincount(grades, minlength=levels) + 0.5)[:-1] / (n + 0.5 * levels)
    first = np.log(share / (1 - share))
    start = np.r_[np.zeros(len(known)), first[0], np.log(np.maximum(np.diff(first), 1e-3))]
    if n:
        start = _minimise(lambda at: _loss(at, rows, slots, n, len(known), grades, penalty), start)
    thresholds = np.cumsum(np.r_[start[len(known)], np.exp(start[len(known) + 1 :])])
    return OrdinalModel(known, start[: len(known)], thresholds)


def rating(quality: Column, toxic: Column) -> Column:
    """Grade of a label: 0 toxic, 1 poor, 2 good; null without both marks."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def fit(docs: DataFrame, ratings: DataFrame, levels: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on the ``sample`` rated documents of least id hash.

    ``ratings`` holds ``id_col`` and ``grade``; null ids and grades are left out, of several
    grades of a document the least counts. Runs a job; the sample's features (at most
    ``sample`` rows) come to the driver.
    """
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col("grade").isNotNull())
    rated = rated.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min("grade").cast("int").alias("grade"))
    # At most ``sample`` rows of two numbers: bounded, so broadcast.
    chosen = rated.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.array(sorted(text_slots(t.as_py())), np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(slots, pa.binary())], ["id", "grade", "slots"])

    found = rows.select("__id", "text", "grade").mapInArrow(at_end(run, _forget), "id long, grade int, slots binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["slots"])))
    features = [np.frombuffer(bytes(r["slots"]), np.int32) for r in found]
    return fit_ordinal(features, np.array([r["grade"] for r in found], np.int64), levels)


_SCORES: dict[int, dict[int, float]] = {}


def _weights(shared) -> dict[int, float]:
    """Slot to weight in this worker process."""
    if shared.id not in _SCORES:
        _SCORES.clear()
        model = shared.model.value
        _SCORES[shared.id] = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    return _SCORES[shared.id]


@dataclass(frozen=True)
class _Shared:
    id: str
    model: object


def score_batch(texts: pa.Array, shared: _Shared) -> np.ndarray:
    weights = _weights(shared)
    get = weights.get
    return np.array([sum(get(s, 0.0) for s in sorted(text_slots(t.as_py()))) for t in texts], np.float64)


def graded(docs: DataFrame, model: OrdinalModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``score``, ``expected_grade``, ``p_above_lowest`` and ``p_top`` (tails of the second and the top grade).

    A null or empty text has score 0 and so the grades' base rates. Names take ``prefix``.
    Rows stay as they are, repeated ones too. No shuffle.
    """
    spark = docs.sparkSession
    names = [f"{prefix}{n}" for n in ("score", "expected_grade", "p_above_lowest", "p_top")]
    clash = sorted(set(names) & set(docs.columns))
    if clash:
        raise ValueError(f"columns exist: {', '.join(clash)}")
    cast = spark.sparkContext.broadcast(model)
    digest = zlib.crc32(model.weights.tobytes() + model.slots.tobytes() + model.thresholds.tobytes())
    shared = _Shared(f"{digest}-{len(model.weights)}", cast)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts go back in small batches: what Spark reads at a time stays small beside long texts.
        for batch in (whole.slice(i, _BACK) for whole in batches for i in range(0, whole.num_rows, _BACK)):
            score = score_batch(batch.column(at), shared)
            tails = cast.value.tails(score)
            made = [score, tails.sum(axis=1), tails[:, 0], tails[:, -1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m) for m in made]], [f"c{i}" for i in range(batch.num_columns + 4)])

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    width = len(docs.columns)
    schema += "".join(f", c{width + i} double" for i in range(4))
    return plain.mapInArrow(at_end(run, _forget), schema).toDF(*docs.columns, *names)


def good_documents(docs: DataFrame, model: OrdinalModel, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """``docs`` whose tail probability of the top grade is at least ``keep_at``."""
    marked = graded(docs, model, text_col, "__")
    return marked.filter(F.col("__p_top") >= keep_at).select(*docs.columns)
