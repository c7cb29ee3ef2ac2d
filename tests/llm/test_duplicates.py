"""Near copies, repeated passages and similar vectors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from effectframe.llm import components, grid_join, induced_sort, simhash, suffix_dedup
from tests.llm.conftest import make_texts


def least_reachable(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(160, 90), (7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_reachable({n for e in edges for n in e if n not in (None, 7, 3)}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("size", "most"), [(1000, 2), (30, 7)])
def test_rounds_of_components_lie_in_partitions_by_their_edges(spark, monkeypatch, size, most):
    held, cut = [], components.cut_lineage
    monkeypatch.setattr(components, "EDGES", size)
    monkeypatch.setattr(components, "cut_lineage", lambda df: held.append(cut(df)) or held[-1])
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 301)]
        found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
        got = {r.node: r.component for r in found.collect()}
        assert got == {i: 0 if i < 200 else 200 for i in [*range(101), *range(200, 301)]}
        assert len(held) > 2 and all(df.rdd.getNumPartitions() <= most for df in held[1:])
        assert found.rdd.getNumPartitions() <= 2 * most
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in lower).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_near_duplicates(odd_docs, odd_rows):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = {i: brute_fingerprint(t) for i, t, _ in odd_rows}
    assert all(r.fp % 2**64 == want[r.id] for r in got if r.id is not None)
    ids = [i for i in want if i is not None]
    edges = [(a, b) for a in ids for b in ids if a < b and bin(want[a] ^ want[b]).count("1") <= 4]
    parts = least_reachable(ids, edges)
    assert {r.id: r.component for r in got if r.id is not None} == parts


def test_one_of_similar_documents_stays(spark, odd_docs, odd_rows, no_docs):
    texts = {i: t for i, t, _ in odd_rows if i is not None}
    grams = {i: simhash.shingles(t) for i, t in texts.items()}
    prints = {i: simhash.word_set_fingerprint(t) for i, t in texts.items()}

    def alike(a, b):
        union = len(grams[a] | grams[b])
        return len(grams[a] & grams[b]) >= 0.8 * union

    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r.doc_id for r in kept.collect() if r.doc_id is not None}
    near = [(a, b) for a in texts for b in texts if a < b and bin(prints[a] ^ prints[b]).count("1") <= 7 and alike(a, b)]
    assert near and not any(a in ids and b in ids for a, b in near)
    groups = {r.id: r.component for r in simhash.similar_documents(odd_docs).collect()}
    assert set(groups) == set(texts) and ids == {i for i, c in groups.items() if i == c}
    parts = least_reachable(list(texts), near)
    assert all(parts[i] == parts[c] and c <= i for i, c in groups.items())
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert simhash.keep_one(no_docs).collect() == []
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "j i h g f e d c b a"), (3, "A b\tc d e f g h i j")]
    few = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in few) == [1, 2]


@pytest.mark.parametrize("block", [3, 4096])
def test_links_within_bits_are_complete(spark, block):
    draw = random.Random(block)
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = set()
    for c in centres:
        for _ in range(15):
            p = c
            for b in draw.sample(range(64), draw.randint(0, 4)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.link_edges(frame, 4, block).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 and a != b for a, b in edges)
    every = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    assert least_reachable(range(len(prints)), edges) == least_reachable(range(len(prints)), every)


def brute_repeats(rows, length):
    rows = [(2**63 if i is None else i, (t or "").encode()) for i, t, _ in rows]
    least = {}
    for i, data in rows:
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, data in rows:
        mark = [False] * len(data)
        for s in range(len(data) - length + 1):
            if least[data[s : s + length]] < i:
                mark[s : s + length] = [True] * length
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        out.append((None if i == 2**63 else i, len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [25, 50])
def test_repeated_spans(odd_docs, odd_rows, length):
    got = suffix_dedup.repeated_spans(odd_docs, length)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(odd_rows, length)


def test_repeats_across_steps_and_cells(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 1 << 9)
    monkeypatch.setattr(suffix_dedup, "_FLUSH", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "CELL_BYTES", 1 << 11)
    texts = make_texts(11, 80)
    rows = [(i * 1000 - 5, t, "s") for i, t in enumerate(texts)]
    rows += [(7, " ".join(texts[:20]), "s"), (10**12, " ".join(texts[10:40]), "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = suffix_dedup.repeated_spans(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 50)


def test_texts_without_repeats_keep_columns(odd_docs, no_docs, odd_rows):
    cut = suffix_dedup.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    spans = {r.id: r.n_removed for r in suffix_dedup.repeated_spans(odd_docs).collect() if r.id is not None}
    given = {i: t for i, t, _ in odd_rows}
    for r in cut.collect():
        if r.doc_id is not None and not spans[r.doc_id]:
            assert r.text == given[r.doc_id]
        assert r.id == "clash"
    assert suffix_dedup.without_repeats(no_docs).collect() == []
    assert suffix_dedup.repeated_spans(no_docs).collect() == []
    assert simhash.near_duplicates(no_docs).collect() == []


def test_suffix_arrays():
    draw = random.Random(1)
    for _ in range(500):
        k = draw.choice([1, 2, 3, 5, 9])
        text = [draw.randint(1, k) for _ in range(draw.randint(0, 60))] + [0]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert induced_sort.suffix_array(np.array(text, np.int32), k + 1).tolist() == want


def _is_suffix_array(text, order):
    """Neighbours ascend: by symbol, then by the rank of what follows."""
    n = len(text)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.arange(n)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    less = (text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1]))
    return sorted(order.tolist()) == list(range(n)) and bool(less.all())


def test_long_suffix_arrays_recurse(monkeypatch):
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, int(rng.integers(2, 9))).tolist()) for _ in range(30_000)]
    ranks = np.minimum(rng.zipf(1.2, 250_000) - 1, len(words) - 1)
    prose = np.frombuffer(b" ".join(words[i] for i in ranks.tolist()), np.uint8)[:1_000_000].astype(np.int32)
    assert len(prose) == 1_000_000
    depths = []
    inner = induced_sort.suffix_array

    def counted(text, symbols):
        depths.append(symbols)
        return inner(text, symbols)

    monkeypatch.setattr(induced_sort, "suffix_array", counted)
    text = np.append(prose, 0).astype(np.int32)
    assert _is_suffix_array(text, induced_sort.suffix_array(text, 256))
    assert len(depths) >= 4 and max(depths) > 4096  # names beyond any small alphabet, and still a recursion
    for body in (np.tile([1, 2], 100_000), np.tile([2, 1, 1], 60_000), np.ones(200_000), rng.integers(1, 100_000, 200_000)):
        text = np.append(body, 0).astype(np.int32)
        assert _is_suffix_array(text, inner(text, int(text.max()) + 1))


def test_common_prefixes():
    draw = random.Random(4)
    data = np.array(draw.choices([1, 2], k=400), np.uint8)
    words = suffix_dedup._words(data)
    before = np.array([draw.randrange(-1, 370) for _ in range(370)])
    got = induced_sort.permuted_common_prefixes(words, before, 30)
    text = data.tolist()
    for i, b in enumerate(before.tolist()):
        n = 0
        while b >= 0 and n < 30 and text[i + n] == text[b + n]:
            n += 1
        assert got[i] == n


def brute_vectors(rows, threshold):
    def unit(v):
        if v is None or not v or any(x is None for x in v):
            return None
        a = np.array(v, np.float64)
        return a / np.sqrt(a @ a) if np.isfinite(a).all() and a.any() else None

    units = [None if i is None or lab is None else unit(v) for i, v, lab in rows]
    links, edges = [0] * len(rows), []
    for x in range(len(rows)):
        for y in range(x):
            same = units[x] is not None and units[y] is not None and rows[x][2] == rows[y][2] and len(units[x]) == len(units[y])
            if same and units[x] @ units[y] >= threshold:
                links[x] += 1
                links[y] += 1
                edges.append((rows[x][0], rows[y][0]))
    least = least_reachable([r[0] for r in rows if r[0] is not None], edges)
    return sorted(((r[0], n, least.get(r[0]), r[0] is None or least[r[0]] == r[0]) for r, n in zip(rows, links, strict=True)), key=str)


def test_similar_vectors(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 8)
    monkeypatch.setattr(grid_join, "LEAF", 3)
    draw = np.random.default_rng(7)
    rows = []
    for c in range(30):
        centre = draw.normal(size=12)
        for k in range(draw.integers(1, 12)):
            noise = draw.normal(size=12) * draw.choice([0.0, 0.1, 0.25, 0.5])
            rows.append((len(rows) * 3, [float(x) for x in np.float32(centre + noise)], int(c % 3)))
    rows += [(2000 + i, [1.0] * 12, 1) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 12, 1), (3003, [1.0] * 11 + [None], 1), (3004, [nan] + [1.0] * 11, 1)]
    rows += [(3005, [inf] + [1.0] * 11, 1), (3006, [1.0] * 12, None), (3007, [1.0] * 5, 1), (3008, [2.0] * 5, 1), (None, [1.0] * 12, 1), (3009, [-0.0] * 12, 1), (3010, [3.0e38] * 12, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    got = sorted((tuple(r) for r in grid_join.similar_vectors(frame).collect()), key=str)
    assert got == brute_vectors([r for r in rows], 0.93)
    assert grid_join.similar_vectors(frame.limit(0)).collect() == []
    assert sorted(r.kept for r in grid_join.similar_vectors(frame.filter("vec_id in (3000, 3001)")).collect()) == [True, True]


def copies_of_a_base(seed, n):
    """Copies of a text with a few words changed, the base in the middle of the ids."""
    draw = random.Random(seed)
    words = [f"{draw.choice('abcdef')}{draw.randrange(3000)}" for _ in range(250)]
    texts = []
    for _ in range(n):
        mine = list(words)
        for at in draw.sample(range(250), 4):
            mine[at] = f"new{draw.randrange(10**6)}"
        texts.append(" ".join(mine))
    texts[n // 2] = " ".join(words)
    return texts


@pytest.mark.parametrize("group", [7, 256])
def test_groups_of_near_copies_are_those_of_all_links(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group, raising=False)
    monkeypatch.setattr(simhash, "SHARED", 2, raising=False)
    texts = dict(enumerate(copies_of_a_base(1, 61) + copies_of_a_base(2, 30) + make_texts(3, 20)))
    grams = {i: simhash.shingles(t) for i, t in texts.items()}
    alike = [(a, b) for a in texts for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    parts = least_reachable(list(texts), alike)
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.id: r.component for r in simhash.similar_documents(frame).collect()}
    assert got == parts and len({*parts.values()}) < len(texts) - 80


@pytest.mark.parametrize("kind", ["words", "append", "cut"])
def test_near_copies_of_every_kind_are_found(spark, kind):
    draw = random.Random(kind)
    prose = lambda n: [f"w{int(draw.paretovariate(0.4)) % 5000}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(120):
        words = prose(draw.randint(60, 300))
        n = len(words)
        if kind == "words":
            other = list(words)
            for at in draw.sample(range(n), max(1, n // 60)):
                other[at] = "changed"
        else:
            other = words + prose(n // 5) if kind == "append" else words[: n - n // 6]
        a, b = simhash.shingles(" ".join(words)), simhash.shingles(" ".join(other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(2 * i)
    assert len(pairs) > 50
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in pairs) >= 0.99 * len(pairs)


def test_texts_which_share_an_id_are_kept(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "j i h g f e d c b a"), (1, "A B c d e f g h i j"), (1, None), (2, "k l m n o p q"), (3, "K l m n o p q")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(1, ""), (1, rows[0][1]), (1, rows[1][1]), (2, rows[4][1])]


def test_only_pieces_with_shared_surroundings_are_sorted():
    draw = random.Random(8)
    made = lambda n: bytes(draw.choices(b"abcdefgh", k=n))
    gram = b"0123456789012345"
    # One anchor in many surroundings, and one window of 50 bytes at each place around it.
    alone = [made(34) + gram + made(34) for _ in range(300)]
    pairs = []
    for before in range(35):
        window = made(before) + gram + made(34 - before)
        for _ in range(2):
            pairs.append(made(34 - before) + window + made(before))
    kept = suffix_dedup.comparable([*alone, *pairs], [34] * (len(alone) + len(pairs)))
    assert kept[len(alone) :].all() and kept.sum() < len(pairs) + 30
    assert not suffix_dedup.comparable([made(50)], [3]).any()


def test_anchors_of_equal_windows_have_one_place():
    # A gram twice in every window, met on both sides of byte 65536 of a text.
    window = b"x" * 50
    text = bytes(random.Random(4).choices(b"abcd", k=65500)) + window * 2 + b"end"
    places = set()
    for buffer, _, start, _, size, offset in suffix_dedup.cut_pieces([text, window]):
        for s, z, o in zip(start.tolist(), size.tolist(), offset.tolist(), strict=True):
            places |= {o - k for k in range(z - 49) if buffer[s + k : s + k + 50] == window}
    assert len(places) == 1
