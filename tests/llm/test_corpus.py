"""Mixing, rating, sketches, shards, archives and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from effectframe.llm import hash_tree, mixing, quality, queries, sketches, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in queries.REGISTRY.items() if q.sql])
def test_queries_agree_with_sql(spark, name):
    query = queries.REGISTRY[name]
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(query.sql)
    columns = [c[0] for c in want.description]
    got = query.run(spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def level_targets(sizes, weights, share, most):
    """Targets by handing out what full sources leave, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = {}
    budget = share * sum(sizes.values())
    while True:
        rest = budget - sum(full.values())
        free = [s for s in sizes if s not in full]
        targets = full | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if targets[s] > most * sizes[s]]
        if not over:
            return targets
        full |= {s: most * sizes[s] for s in over}


def test_mixture(odd_docs, odd_rows, no_docs):
    got = mixing.copies(odd_docs).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for _, t, s in odd_rows:
        sizes[s] += len((t or "").encode().split())
    targets = level_targets(sizes, (5, 2, 1), 1.0, 3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    key = lambda r: str((r.id, r.source, r.size))
    assert sorted(got, key=key) == sorted(mixing.copies(odd_docs.repartition(3)).collect(), key=key)
    assert mixing.copies(no_docs).collect() == []
    by_id = Counter(r.doc_id for r in mixing.mixed(odd_docs).collect())
    assert all(by_id[r.id] == r.copies for r in got if r.id is not None)


def test_pareto_sample_prefers_what_has_higher_odds(spark):
    rows = [(i, "w " * (20 if i % 2 else 2000), s) for s in "ab" for i in range(400)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).collect()
    mean = lambda size: np.mean([r.copies for r in got if r.size == size and r.source == "a"])
    assert mean(2000) > mean(20)


def test_ordinal_fit_is_a_minimum_and_separates():
    draw = np.random.default_rng(3)
    features, grades = [], []
    for i in range(600):
        grade = i % 3
        slots = {1000 + int(x) for x in draw.integers(0, 300, 30)}
        slots |= {[7, 11, 13][grade]} if draw.random() < 0.95 else set()
        features.append(np.array(sorted(slots), np.int32))
        grades.append(grade)
    grades = np.array(grades)
    model = quality.fit_ordinal(features[:450], grades[:450], 3)
    weights = np.zeros(1 << quality.BITS)
    weights[model.slots] = model.weights
    tails = model.tails(np.array([weights[f].sum() for f in features]))
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(axis=1)[450:] == grades[450:]).mean() > 0.9
    rows = np.repeat(np.arange(3), [2, 1, 2])
    slots = np.array([0, 1, 1, 0, 2])
    loss = lambda at: quality._loss(at, rows, slots, 3, 3, np.array([0, 1, 2]), 0.7)
    at = draw.normal(size=5)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        slope = (loss(at + step)[0] - loss(at - step)[0]) / 2e-6
        assert loss(at)[1][k] == pytest.approx(slope, abs=1e-4)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("grade", quality.rating(F.col("quality"), F.col("toxic")))
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    model = quality.fit(docs, train)
    rows = quality.graded(docs, model).join(held, "doc_id").select("grade", "p_top").collect()
    assert np.mean([r.p_top >= 0.5 for r in rows if r.grade == 2]) > 0.9
    assert np.mean([r.p_top < 0.5 for r in rows if r.grade == 1]) > 0.6


def test_quality_odd_cases(spark, odd_docs, no_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(odd_docs, none)
    assert quality.graded(odd_docs, model).count() == len(odd_rows)
    assert quality.good_documents(no_docs, model).collect() == []
    one = spark.createDataFrame([(1, 2), (1, 1), (None, 0), (4, None)], "doc_id long, grade int")
    kept = quality.good_documents(odd_docs, quality.fit(odd_docs, one))
    assert kept.columns == odd_docs.columns


def test_edited_fingerprints(odd_docs, odd_rows, no_docs, spark):
    named = [(i, t or "") for i, t, _ in odd_rows if i is not None]
    frame = odd_docs.filter("doc_id is not null")
    got = {r.id: r for r in sketches.edited_fingerprints(frame).collect()}
    named.sort(reverse=True)

    def grams(text):
        words = text.strip(sketches.BLANKS)
        words = [w for w in "".join(" " if c in sketches.BLANKS else c for c in words).split(" ") if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = defaultdict(set)
    for (i, text), (_, after) in zip(named, named[1:] + named[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            exact = len(grams(text) | grams(other)) <= sketches.K
            assert near == pytest.approx(like(grams(text), grams(other)), abs=1e-9 if exact else 0.2)
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sketches.edited_fingerprints(odd_docs).count() == len(odd_rows)
    assert sketches.edited_fingerprints(no_docs).collect() == []
    lone = sketches.edited_fingerprints(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).collect()
    assert lone[0].near_next == 1.0


def test_neighbours_across_cells(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CELL_BYTES", 300)
    rows = [(i * i - 50, f"text {i} " * (i % 9)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    every, following = sketches.with_next_text(frame)
    got = {r.id: r.next for r in every.withColumn("next", following(F.col("text"))).filter("carried = 0").collect()}
    rows.sort(reverse=True)
    assert got == {i: after for (i, _), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True)}


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words[:3000])), (2, " ".join(words[1000:]))]
    frame = spark.createDataFrame(rows, "k int, text string").withColumn("s", sketches.bottom_k(F.col("text"), 256))
    a, b = (r.s for r in frame.orderBy("k").collect())
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = pair.select(
        sketches.resemblance(F.col("a"), F.col("b"), 256).alias("like"),
        sketches.containment(F.col("a"), F.col("b"), 256).alias("inside"),
        sketches.distinct_shingles(F.col("a"), 256).alias("n"),
        sketches.merged(F.col("a"), F.col("b"), 256).alias("both"),
    ).first()
    assert r.like == pytest.approx(0.5, abs=0.12) and r.inside == pytest.approx(2 / 3, abs=0.15) and r.n == pytest.approx(3000, rel=0.2)
    merged = sketches.merge_parts(frame.withColumn("all", F.lit(1)), ["all"], "s", 256).first().s
    assert merged == r.both == sorted(set(a) | set(b))[:256]


def test_hash_tree(odd_docs, odd_rows, no_docs, spark):
    tree, grown = hash_tree.regular_tree(8), hash_tree.regular_tree(9)
    got = hash_tree.shard_documents(odd_docs, tree, grown).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(i) for i, _, _ in odd_rows)
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows}
    slots = defaultdict(list)
    for r in got:
        if r.id is not None:
            assert (r["size"], r.text_crc32) == sizes[r.id]
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.shard_documents(no_docs, tree, grown).collect() == []
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    weights = [hash_tree.Shard(0, "r", "a", 1.0), hash_tree.Shard(1, "r", "b", 2.0), hash_tree.Shard(2, "q", "a", 3.0)]
    more = [*weights[:2], hash_tree.Shard(2, "q", "a", 6.0)]
    placed = ids.select(hash_tree.tree_shard(F.col("doc_id"), weights).alias("a"), hash_tree.tree_shard(F.col("doc_id"), more).alias("b")).collect()
    count = Counter(r.a for r in placed)
    assert [count[i] / 20_000 for i in range(3)] == pytest.approx([1 / 6, 1 / 3, 1 / 2], abs=0.02)
    assert all(r.a == r.b or r.b == 2 for r in placed)


def pages(spark):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://a/ b\n", long), (3, None, long), (9, "u", "short"), (1, "u", "short"), (7, "http://é", None), (8, "", ""), (None, "n", long), (None, "n", "q" * 150), (None, "n", "q" * 150), (3, "again", long), (11, "z", "\r\n\r\n" * 60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    rows, frame = pages(spark)
    folder = f"{tmp_path}/archive"
    manifest = warc.write_archive(frame, folder, shard_bytes=1500).collect()
    assert sum(r.records for r in manifest) == len(rows) and len(manifest) > 3
    for r in manifest:
        data = (tmp_path / "archive" / r["name"]).read_bytes()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
    got = warc.read_archive(spark, folder, payloads=True).collect()
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == data]
        first = min(same) if same and len(data) >= 100 else None
        refers = first if first is not None and i != first else None
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    again = warc.write_archive(frame.repartition(2), f"{tmp_path}/again", shard_bytes=1500).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, manifest))
    warc.write_archive(frame.limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").collect() == []


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    _, frame = pages(spark)
    folder = f"{tmp_path}/archive"
    warc.write_archive(frame, folder)
    (tmp_path / "archive" / "part-00000000-00099.warc.gz").write_bytes(b"half a fi")
    (tmp_path / "archive" / "_temporary" / "lost-00000000-00000").write_bytes(b"half")
    assert warc.read_archive(spark, folder).count() == 11


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert 0 < seen["near_copies"] < seen["quality"] < 200
    assert seen["repeats"] == seen["near_copies"] and seen["encode"] == seen["mix"] > 0
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: tuple(r)
    assert sorted(whole.collect(), key=key) == sorted(docs.collect(), key=key)


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for stage, function in corpus_pipeline.STAGES:
            function(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_cells_grow_with_ids_and_weigh_about_alike(spark):
    from effectframe.llm.cells import with_cells

    ids = [*range(1000), *(10**15 + 3 * i for i in range(1000)), -(2**62), 2**62, None, None]
    frame = spark.createDataFrame([(i, "x" * 9) for i in ids], "i long, t string").repartition(4)
    rows = with_cells(frame, "i", F.lit(10), 500, "c", F.col("t")).collect()
    assert len(rows) == len(ids)
    named = sorted((r.i, r.c) for r in rows if r.i is not None)
    assert all(a[1] <= b[1] for a, b in zip(named, named[1:], strict=False)) and all(r.c < 0 for r in rows if r.i is None)
    close = spark.range(5000).withColumnRenamed("id", "i").withColumn("t", F.lit("x"))
    sizes = Counter(r.c for r in with_cells(close, "i", F.lit(10), 500, "c", F.col("t")).collect())
    assert len(sizes) == 100 and max(sizes.values()) <= 60
    assert with_cells(frame.limit(0), "i", F.lit(1), 5, "c", F.col("t")).collect() == []


def test_cells_of_clustered_ids_weigh_about_alike(spark):
    from effectframe.llm.cells import with_cells

    far = [*range(5000), 10**15]
    sources = [source << 40 | n for source in range(8) for n in range(700)]
    wide = [*range(-(2**62), 100 - 2**62), *range(3000), 2**62]
    for ids in (far, sources, wide):
        frame = spark.createDataFrame([(i,) for i in ids], "i long").repartition(4)
        rows = sorted((r.i, r.c) for r in with_cells(frame, "i", F.lit(10), 500, "c", F.col("i")).collect())
        assert [i for i, _ in rows] == sorted(ids)
        assert [c for _, c in rows] == [k // 50 for k in range(len(ids))]
