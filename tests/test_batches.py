"""Even batches, pieces of long texts and counts on the way, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from effectframe.operators import audit, batches, sequences


def texts(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "seq string")
    return sequences.distinct_sequences(df, ["seq"])


def plain_pieces(seq, limit, overlap):
    if len(seq) <= limit:
        return [seq]
    cut = [seq[i : i + limit] for i in range(0, len(seq), limit - overlap)]
    return [p for p in cut if len(p) > overlap]


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 3), (7, 6), (1, 0)])
def test_pieces_cover_every_token_once(spark, limit, overlap):
    rng = random.Random(limit)
    rows = ["".join(rng.choices("ACGT\né", k=n)) for n in (0, 1, 6, 7, 8, 10, 11, 17, 24, 100)] + [None]
    got = batches.pieces(texts(spark, rows), limit, overlap).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["seq_id"], []).append((r["piece"], r["seq"], r["weight"]))
    for seq in rows[:-1]:
        found = sorted(by_id[hashlib.sha256(seq.encode()).hexdigest()])
        assert [p for _, p, _ in found] == plain_pieces(seq, limit, overlap)
        k = overlap + 1
        tokens = [p[i : i + k] for _, p, _ in found for i in range(max(len(p) - k + 1, 1))]
        assert tokens == [seq[i : i + k] for i in range(max(len(seq) - k + 1, 1))]
        assert sum(w for *_, w in found) == len(tokens)


def test_batches_cost_the_same(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choices("ACGT", k=rng.choice((0, 1, 5, 30, 90, 2000)))) for _ in range(900)]
    parts = batches.pieces(texts(spark, rows), 100, 5)
    dealt = batches.batched(parts, 1500, 100).collect()
    assert len(dealt) == parts.count()
    cost, longest = {}, {}
    for r in dealt:
        n = max(len(r["seq"]), 1)
        cost[r["batch"]] = cost.get(r["batch"], 0) + n
        longest.setdefault(r["batch"], []).append(n)
    assert sorted(cost) == list(range(len(cost))) and len(cost) > 20
    assert max(cost.values()) <= 1.2 * min(cost.values())
    for b in range(len(cost) - 1):
        assert max(longest[b]) <= min(longest[b + 1])


def test_one_very_long_text_is_spread(spark):
    dealt = batches.batched(batches.pieces(texts(spark, ["ACGT" * 50_000]), 100, 3), 2000, 100)
    assert dealt.select("batch").distinct().count() > 90


def test_empty_table_and_bad_settings(spark):
    none = texts(spark, ["x"]).filter("false")
    assert batches.batched(batches.pieces(none, 10), 120, 10).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        batches.pieces(none, 10, 10)
    with pytest.raises(ValueError, match="budget"):
        batches.batched(none, 119, 10)


def test_pooled_pieces_equal_the_whole(spark):
    """A plain model on pieces gives what the built-in encoder gives on whole texts."""
    k, dim = 4, 8

    def model(series):
        out = []
        for text in series:
            hits = [0.0] * dim
            tokens = [text[i : i + k] for i in range(max(len(text) - k + 1, 1))]
            for t in tokens:
                hits[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1 / len(tokens)
            out.append(hits)
        return out

    rng = random.Random(5)
    docs = texts(spark, ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 3, 4, 29, 30, 31, 200, 1999)])
    whole = {r["seq_id"]: r["vec"] for r in sequences.kmer_encoder(k, dim)(docs).collect()}
    pooled = batches.budget_encoder(model, 30, 400, k - 1)(docs).collect()
    assert {r["seq_id"] for r in pooled} == set(whole) and len(pooled) == len(whole)
    for r in pooled:
        assert r["vec"] == pytest.approx(whole[r["seq_id"]], abs=1e-6)
    short = batches.budget_encoder(lambda s: [[1.0]] * (len(s) - 1), 30, 400)
    with pytest.raises(Exception, match="vectors for"):
        short(docs).collect()


def test_ledger_counts_without_another_scan(spark, tmp_path):
    df = spark.range(1000).select(
        "id", F.element_at(F.array(*map(F.lit, ("train", "val", "test", "extra", None))), (F.col("id") % 5 + 1).cast("int")).alias("split")
    )
    ledger = audit.StageLedger(spark)
    first = ledger.watch(df, "all")
    ledger.watch(first.filter("id < 100"), "some", F.col("id") % 2 == 0).write.parquet(str(tmp_path / "out"))
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "other"))
    got = {(r["split"], r["stage"]): r["n"] for r in ledger.table().collect()}
    assert got == {
        **{(s, "all"): 200 for s in ("train", "val", "test")}, ("other", "all"): 400,
        **{(s, "some"): 10 for s in ("train", "val", "test")}, ("other", "some"): 20,
    }
    plan = ledger.table()._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
