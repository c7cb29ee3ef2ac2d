import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from effectframe.functions import vectors


def frame(spark, *vs):
    names = [chr(97 + i) for i in range(len(vs))]
    schema = "k string, " + ", ".join(f"{n} array<float>" for n in names)
    return spark.createDataFrame([("key", *[list(map(float, v)) for v in vs])], schema)


def one(df, column):
    return np.array(df.select(column).first()[0], dtype="float64")


def test_effect_vector_is_unit_or_zero(spark):
    df = frame(spark, [1, 2, 3], [1, 0, 7])
    got = one(df, vectors.effect_vector(F.col("a"), F.col("b")))
    want = np.array([0, -2, 4]) / np.sqrt(20)
    assert np.allclose(got, want, atol=1e-6)
    assert not one(df, vectors.effect_vector(F.col("a"), F.col("a"))).any()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=12))
def test_norm_and_spread_match_numpy(spark, xs):
    df = frame(spark, xs)
    v = np.array(xs, dtype="float32").astype("float64")
    row = df.select(vectors.l2_norm(F.col("a")), vectors.population_std(F.col("a"))).first()
    assert np.isclose(row[0], np.linalg.norm(v)) and np.isclose(row[1], v.std(), atol=1e-9)


def test_ablation_identities(spark):
    df = frame(spark, [1, -2, 3, 4])
    v = F.col("a")
    assert one(df, vectors.scale(v, 1.0)).tolist() == [1, -2, 3, 4]
    assert one(df, vectors.scale(v, 0.0)).any() == one(df, vectors.zero_all(v)).any()
    assert one(df, vectors.zero_ranges(v, [(1, 3), (-4, 1), (3, 3)])).tolist() == [0, 0, 0, 4]
    assert one(df, vectors.zero_ranges(v, [(2, 99)])).tolist() == [1, -2, 0, 0]
    assert one(df, vectors.slice_block(v, 1, 2)).tolist() == [-2, 3]


def test_noise_is_seeded_and_gaussian(spark):
    df = spark.range(2000).select(F.col("id"), vectors.zeros(20).alias("v"))
    noisy = vectors.add_noise(F.col("v"), F.col("id"), 13, std=1.5)
    a = np.array([r[0] for r in df.select(noisy).collect()])
    b = np.array([r[0] for r in df.repartition(3).orderBy("id").select(noisy).collect()])
    assert np.array_equal(a, b)
    assert abs(a.mean()) < 0.03 and abs(a.std() - 1.5) < 0.03
    other = np.array([r[0] for r in df.select(vectors.pure_noise(F.col("v"), F.col("id"), 14)).collect()])
    assert abs(np.corrcoef(a.ravel(), other.ravel())[0, 1]) < 0.02


def test_noise_alpha_follows_spread(spark):
    df = frame(spark, [0, 10] * 200)
    got = one(df, vectors.add_noise(F.col("a"), F.col("k"), 1, alpha=0.5)) - np.array([0, 10] * 200)
    assert abs(got.std() - 2.5) < 0.4
    snr = df.select(vectors.signal_to_noise(F.col("a"), vectors.add_noise(F.col("a"), F.col("k"), 1, alpha=0.5))).first()[0]
    assert np.isclose(snr, 5.0 / got.std(), rtol=1e-3)


def test_health(spark):
    df = frame(spark, [1, float("nan"), float("inf"), -2])
    row = df.select(vectors.finite_share(F.col("a")), vectors.finite_min(F.col("a"))).first()
    assert row[0] == 0.5 and row[1] == -2
