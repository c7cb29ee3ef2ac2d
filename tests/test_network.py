"""The weighted network against finite differences and plain training."""

import numpy as np
import pytest

from effectframe.operators import network as N
from effectframe.operators.probes import network_scores


def rows(n=600, dim=4, seed=1):
    """One class in ten, inside a ring: no plane separates the classes."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    y = (np.linalg.norm(x[:, :2], axis=1) < 0.5).astype(int)
    return [(f"k{i}", x[i].tolist(), int(y[i])) for i in range(n)]


SCHEMA = "key string, features array<double>, _y int"


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(0)
    network = N.Network.start([3, 5, 4], 7)
    x, y, weight = draw.normal(size=(8, 3)), draw.integers(0, 2, 8), draw.uniform(0.5, 3, 8)
    masks = [N.dropout_mask(np.arange(8), u, 0.3, k) for k, u in enumerate((5, 4))]
    loss, got = network.loss_and_gradient(x, y, weight, masks)
    flat = network.flat()
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (network.filled(flat + s).loss_and_gradient(x, y, weight, masks)[0] for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    # The weighted loss, written out.
    p = 1 / (1 + np.exp(-network.logits(x)))
    plain = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
    assert network.loss_and_gradient(x, y, weight, [np.ones((1, 5)), np.ones((1, 4))])[0] == pytest.approx(plain)


def test_dropout_follows_keys():
    keys = np.arange(-500, 500)
    mask = N.dropout_mask(keys, 20, 0.25, 3)
    assert set(np.unique(mask)) == {0.0, 1 / 0.75} and (mask == 0).mean() == pytest.approx(0.25, abs=0.02)
    assert (N.dropout_mask(keys[::-1].copy(), 20, 0.25, 3) == mask[::-1]).all()
    assert (N.dropout_mask(keys, 20, 0.25, 4) != mask).any()


def plain_fit(data, hidden, how):
    """The same steps on one array."""
    keys, x, y = data
    network = N.Network.start([x.shape[1], *hidden], how.seed)
    state = N._Adam(len(network.flat()), how.lr, how.weight_decay, how.clip)
    counts = [int((y == c).sum()) for c in (0, 1)]
    weight = np.where(y == 1, len(y) / (2 * counts[1]), len(y) / (2 * counts[0]))
    losses = []
    for epoch in range(how.epochs):
        masks = [N.dropout_mask(keys, u, how.dropout, epoch * len(hidden) + k) for k, u in enumerate(hidden)]
        loss, gradient = network.loss_and_gradient(x, y, weight, masks)
        network = network.filled(state.step(network.flat(), gradient / len(y)))
        losses.append(loss / len(y))
    return network, losses


def test_blocks_equal_one_array(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    how = N.Training(epochs=3, batch_rows=10_000, lr=0.01, seed=4)
    network, history = N.fit_network(df, None, 4, "key", hidden=(8, 4), how=how)
    from pyspark.sql import functions as F

    keyed = df.select(F.xxhash64(F.lit(4), "key").alias("k"), "features", "_y").orderBy("k").collect()
    arrays = np.array([r["k"] for r in keyed]), np.array([r["features"] for r in keyed], np.float32).astype(float), np.array([r["_y"] for r in keyed])
    want, losses = plain_fit(arrays, (8, 4), how)
    assert np.allclose(network.flat(), want.flat(), atol=1e-9)
    assert [h["loss"] for h in history] == pytest.approx(losses)
    again, _ = N.fit_network(df.repartition(7), None, 4, "key", hidden=(8, 4), how=how)
    assert (again.flat() == network.flat()).all()


def test_learns_stops_and_keeps_the_best(spark):
    train, val = spark.createDataFrame(rows(1500), SCHEMA), spark.createDataFrame(rows(500, seed=9), SCHEMA)
    how = N.Training(epochs=25, batch_rows=800, lr=0.02, dropout=0.1, patience=3, halve_after=1)
    network, history = N.fit_network(train, val, 4, "key", hidden=(16, 8), how=how)
    values = [h["roc_auc"] for h in history]
    assert max(values) > 0.85 and history[-1]["lr"] <= history[0]["lr"]
    best = int(np.argmax(values))
    assert len(history) == 25 or len(history) - 1 - best >= 3
    from effectframe.operators.metrics import curve_areas

    scored = N.with_probability(val, network, "features")
    assert curve_areas(scored, "_y", "prob").first()["roc_auc"] == pytest.approx(max(values), abs=1e-4)


def test_nulls_and_empty(spark):
    some = spark.createDataFrame([*rows(40), ("n", None, 1), ("m", [0.0] * 4, None)], SCHEMA)
    network, history = N.fit_network(some, None, 4, "key", hidden=(3,), how=N.Training(epochs=1))
    assert len(history) == 1
    assert [r["prob"] is None for r in N.with_probability(some, network, "features").orderBy("key").collect() if r["key"] == "n"] == [True]
    started, none = N.fit_network(some.filter("false"), None, 4, "key", hidden=(3,), how=N.Training(epochs=2))
    assert none == [] and len(started.layers) == 2
    with pytest.raises(ValueError):
        network_scores(some, [some], 4, "key", metric="accuracy")
