"""Prefix trie, perplexity rules and phrases against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectframe.llm import perplexity, phrases, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(seed=3):
    draw = random.Random(seed)
    turns = [(r, f"{w} {draw.randint(0, 2)}") for r in ("user", "assistant", None) for w in ("hello", "go on", "")] + [("user", None)]
    rows = []
    for c in [*range(0, 70), 2_000_000_000_007, 400]:
        path = [turns[0]] * draw.randint(0, 3) if draw.random() < 0.5 else []
        path += [draw.choice(turns) for _ in range(draw.choice([1, 2, 5, 30]))]
        if 40 <= c < 60:
            path = [turns[1]] * 12  # One group of equal conversations.
        rows += [(c, None if t == 0 and c % 3 else t, r, x, 7, "clash") for t, (r, x) in enumerate(path)]
    rows.append((None, 0, "user", "of no conversation", 7, "clash"))
    draw.shuffle(rows)
    return rows


CONVS = "conv_id long, turn long, role string, text string, shard int, key string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves = sum(below[k][0] for k in children[node]) if children[node] else 1
        below[node] = leaves, sum(below[k][1] for k in children[node]) + (len(members[node]) - 1) * words
    found = set()
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.add((min(cs), len(node), parent, len(cs), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return found


@pytest.mark.parametrize("shard_turns", [200_000, 20])
def test_trie_equals_plain(spark, shard_turns):
    rows = conversations()
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, CONVS).repartition(4), shard_turns).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(rows)


def test_trie_odd_tables(spark):
    empty = spark.createDataFrame([], CONVS)
    assert prefix_trie.rebuilt_trie(empty).count() == 0
    # The first h turns of 17 are those of conversation 0, which is not there.
    one = prefix_trie.rebuilt_trie(spark.createDataFrame([(17, 0, "user", "hi", 0, "")], CONVS)).collect()
    h = zlib.crc32(b"17") % 4
    assert len(one) == (2 if h == 0 else 1) and one[0]["n_leaves"] == 1


def test_node_texts(spark):
    rows = [(1, 0, "user", "a b", 0, ""), (1, 1, "bot", None, 0, ""), (2, 0, "user", "a b", 0, "")]
    talks = spark.createDataFrame(rows, CONVS)
    nodes = prefix_trie.node_texts(prefix_trie.prefix_trie(prefix_trie.turn_sequences(talks)), talks)
    assert sorted((r["depth"], r["role"], r["text"]) for r in nodes.collect()) == [(0, None, None), (1, "user", "a b"), (2, "bot", "")]


def test_long_conversations_cross_blocks(spark):
    """Rows that part only after several blocks of columns, one of them a beginning of the other."""
    base = [(t, "user", f"turn {t}") for t in range(100)]
    rows = [(20 * c, t, r, x if (t, c) != (77, 3) else "other", 0, "") for c, n in ((1, 100), (2, 60), (3, 100), (4, 100)) for t, r, x in base[:n]]
    for shard_turns in (10_000, 30):
        got = {tuple(r) for r in prefix_trie.rebuilt_trie(spark.createDataFrame(rows, CONVS), shard_turns).collect()}
        assert got == plain_trie(rows)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_plain(odd_rows):
    texts = [t for _, t, _ in odd_rows] + ["a\n\n a\na\r\na\n", "## a <b>\n| x |", "é ü\n" * 7, "one two\x00three", "x"] + ["k l m k l m k l"]
    got = perplexity.rule_counts([(t or "").encode() for t in texts])
    rows = list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert rows == [plain_counts(t) for t in texts]
    assert all(len(v) == 0 for v in perplexity.rule_counts([]).values())


def folded(text):
    words = b" ".join((text or "").encode().split()).decode()
    return "".join("0" if c in "123456789" else "\x7f" if c == "\0" else c.lower() if "A" <= c <= "Z" else c for c in words)


def plain_model(texts):
    """Probability of a character after four others, from the formulas."""
    orders = [None] * 6
    orders[5] = Counter(p[i : i + 5] for t in texts if folded(t) for p in [f"\n\n\n\n{folded(t)}\n"] for i in range(len(p) - 4))
    for n in range(4, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    discounts = [None] * 6
    for n in range(1, 6):
        times = Counter(orders[n].values())
        t1, t2, t3, t4 = (times[k] for k in (1, 2, 3, 4))
        discounts[n] = (0.5, 1.0, 1.5)
        if min(t1, t2, t3, t4) > 0:
            y = t1 / (t1 + 2 * t2)
            raw = 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3
            if all(0 < d <= k for k, d in enumerate(raw, 1)):
                discounts[n] = raw
    heads = [defaultdict(list) for _ in range(6)]
    for n in range(1, 6):
        for g, a in orders[n].items():
            heads[n][g[:-1]].append(a)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(orders[1]) + 1)
        counts = heads[n].get(gram[:-1])
        if counts is None:
            return p(gram[1:])
        off = lambda a: discounts[n][min(a, 3) - 1]
        a = orders[n][gram]
        return ((a - off(a) if a else 0) + sum(map(off, counts)) * p(gram[1:])) / sum(counts)

    return p


def plain_cost(p, text):
    whole = f"\n\n\n\n{folded(text)}\n"
    return sum(-math.log(p(whole[i - 4 : i + 1])) for i in range(4, len(whole))) / (len(whole) - 4)


@pytest.mark.parametrize("shared_bytes", [1 << 30, 0])
def test_perplexity_equals_plain(spark, odd_rows, odd_docs, shared_bytes):
    model = perplexity.fit(odd_docs)
    p = plain_model([t for _, t, _ in odd_rows])
    got = perplexity.scores(odd_docs, model, shared_bytes=shared_bytes, block_bytes=2000).collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, _, _ in odd_rows)
    want = defaultdict(list)
    for i, t, _ in odd_rows:
        want[i].append((math.exp(plain_cost(p, t)) if folded(t) else None, *plain_counts(t)))
    for r in got:
        assert r["lang"] == "und"
        values = [w for w in want[r["id"]] if w[1:] == tuple(r[c] for c in perplexity._COUNTS)]
        assert any(r["perplexity"] == pytest.approx(w[0], rel=1e-5) if w[0] else r["perplexity"] is None for w in values)
    # Texts the model has not counted go down to lower orders, and to characters never seen.
    others = ["zz qq xyz", "abc Ω abc", "eß é 9 \t 1"]
    new = spark.createDataFrame([(i, "und", t) for i, t in enumerate(others)], "doc_id long, lang string, text string")
    for r in perplexity.scores(new, model, shared_bytes=shared_bytes, block_bytes=2000).collect():
        assert r["perplexity"] == pytest.approx(math.exp(plain_cost(p, others[r["id"]])), rel=1e-5)


def test_model_sums_to_one(spark, odd_rows):
    p = plain_model([t for _, t, _ in odd_rows])
    signs = {c for _, t, _ in odd_rows for c in folded(t)} | {"\n"}
    for head in ("\n\n\n\n", "abcd", "ß xy", "....", "a b "):
        assert sum(p(head + c) for c in signs) + p(head + "Ω") == pytest.approx(1)


def test_bands_and_verdicts(spark):
    rows = [(i, "en", False, 1000 + i % 21) for i in range(200)] + [(900, "en", False, 2000), (901, "en", False, 100), (902, "en", True, 1010)]
    rows += [(903, "fr", False, 5), (904, "en", False, None), (905, "de", True, 7)]
    scored = spark.createDataFrame(rows, "id long, lang string, base_failed boolean, level long")
    limits = perplexity.bands(scored, width=2.0, floor=5)
    levels = sorted(level for _, lang, failed, level in rows if lang == "en" and not failed and level)
    q1, q3 = (levels[math.ceil(len(levels) * q / 4) - 1] for q in (1, 3))
    reach = 2 * (q3 - q1)
    assert {r["lang"]: (r["low"], r["high"]) for r in limits.collect()} == {"en": (q1 - reach, q3 + reach), "fr": (-5.0, 15.0)}
    kept = {r["id"]: r["kept"] for r in perplexity.verdicts(scored, limits).collect()}
    assert len(kept) == len(rows)
    assert [i for i, k in sorted(kept.items()) if not k] == [900, 901, 902, 905]


def test_verdicts_of_odd_tables(spark, odd_docs, odd_rows, no_docs):
    got = perplexity.quality_verdicts(odd_docs)
    assert got.count() == len(odd_rows)
    again = perplexity.quality_verdicts(odd_docs.repartition(3), shared_bytes=0)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, again.collect()))
    assert perplexity.quality_verdicts(no_docs).count() == 0


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and counts[p[i:j]] <= a}
        scored = []
        for p, a in frequent.items():
            if p not in dropped:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def phrase_rows():
    draw = random.Random(11)
    words = ["the", "The", "of", "a", "ü", "new", "york", "city", "x-y", "z"]
    rows = []
    for i in range(120):
        text = " ".join(draw.choices(words, [5, 2, 4, 3, 1, 1, 1, 1, 1, 1], k=draw.randint(0, 60)))
        if i % 3 == 0:
            text += " big Apple pie,\tnew york city hall steps! new york city hall steps"
        if i % 4 == 0:
            text = text.replace(" of ", ". of\n").replace("z", "\r")
        rows.append((draw.choice(["en", "en", "de", None, ""]), text))
    return [*rows, ("en", None), ("fr", ""), (None, " \t"), ("en", rows[0][1]), ("en", "of the " * 3000)]


@pytest.mark.parametrize(("least", "top", "budget"), [(20, 2000, 100_000), (5, 7, 3), (2, 2000, 10)])
def test_phrases_equal_plain(spark, least, top, budget):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, 1, "clash") for g, t in rows], "text string, lang string, f int, path string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top, budget).collect())
    assert got == plain_phrases(rows, least, top)


def test_phrases_of_odd_tables(spark, odd_docs, odd_rows, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    rows = [(None, t) for _, t, _ in odd_rows]
    assert sorted(tuple(r) for r in phrases.collocations(odd_docs, 10).collect()) == plain_phrases(rows, 10, 2000)
    everything = phrases.collocations(odd_docs, 10, None)
    assert everything.filter(F.col("rank").isNotNull()).count() == 0 and everything.count() >= 1


def test_deep_prefixes_are_divided(spark):
    """A prefix with more leaves than a group may hold is replaced by longer ones."""
    leaves = spark.createDataFrame([("en", [1, 2, 3, 4, k], 1) for k in range(50)] + [("en", [1, 2], 3), ("en", [9, 9], 1)], "lang string, path array<long>, f long")
    grouped = phrases._grouped(leaves, 10)
    assert {r["cut"] for r in grouped.filter("size(path) = 5").collect()} == {5}
    assert grouped.groupBy("group").count().agg(F.max("count")).first()[0] <= 20
    got = {tuple(r["path"]): r["f"] for r in phrases.phrase_counts(leaves, 4, 10).collect()}
    assert got == {(1, 2): 53, (1, 2, 3): 50, (1, 2, 3, 4): 50}


def test_packed_counts(spark, monkeypatch):
    """What occurs often is marked, whatever the parts and however little a task holds."""
    import numpy as np

    from effectframe.llm import hash_counts as H

    draw = np.random.default_rng(1)
    keys = draw.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    hashes = H.mixed([keys[0], keys[1]])
    assert len(np.unique(hashes)) == 5000 and int(hashes.max()) < 1 << H.HASH_BITS
    some, counts = H.summed(hashes[draw.integers(0, 5000, 9000)], np.ones(9000, np.int64))
    again = H.unpack(H.pack(some, counts), len(some))
    assert (again[0] == some).all() and (again[1] == counts).all()
    assert [H.parts_for(n) for n in (0, 1, H.PER_PART, H.PER_PART + 1, 1 << 60)] == [1, 1, 1, 2, H.MOST_PARTS]
    draws = draw.integers(0, 5000, 60_000) ** 2 // 5000
    times = np.bincount(draws, minlength=5000)
    monkeypatch.setattr(H, "HOLD", 3000)
    for parts in (1, 16):
        sent = [b for k in range(3) for b in H.sent(iter(np.array_split(hashes[draws[k::3]], 20)), parts)]
        rows = [tuple(r.values()) for b in sent for r in b.to_pylist()]
        assert sum(n for _, n, _ in rows) >= len(np.unique(draws)) and len(sent) > 3
        table = H.often(spark.createDataFrame(rows, H.PACKED), 12)
        marks = H.marked(table, hashes >> np.uint64(H.HASH_BITS - H.TABLE_BITS))
        assert marks[times >= 12].all() and marks.sum() <= (times >= 12).sum() + 10


def test_grams_of_small_and_large_alphabets():
    draw = random.Random(6)
    for signs in (["a"], ["a", "b", " ", "é", "中"], [chr(c) for c in range(0x4E00, 0x4E00 + 5000)]):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 300))) for _ in range(60)]
        points, begins, ends = perplexity._folded([t.encode() for t in texts])
        grams, counts = perplexity._grams(points, perplexity._predicted(begins, ends) - 4)
        want = Counter()
        for text in texts:
            words = " ".join(text.split())
            padded = f"\n\n\n\n{words}\n" if words else ""
            want.update(padded[i : i + 5] for i in range(len(padded) - 4))
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want


def test_lookup_finds_what_is_there():
    draw = np.random.default_rng(2)
    keys = np.unique(np.append(draw.integers(0, 1 << 64, 5000, np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]))
    # Neighbours of keys share their head.
    keys = np.unique(np.append(keys, keys[:50] + np.uint64(1)))
    costs = np.arange(len(keys), dtype=np.int32)
    for n in (0, 1, 2, len(keys)):
        asked = np.append(keys, keys + np.uint64(2))
        found, hit = perplexity._lookup(perplexity._opened(keys[:n], costs[:n]), asked)
        assert hit.tolist() == np.isin(asked, keys[:n]).tolist()
        assert (keys[found[hit]] == asked[hit]).all()


def test_small_partitions_count_together(spark):
    texts = spark.createDataFrame([("en", f"some words {i}") for i in range(100)], "lang string, text string").repartition(97)
    assert perplexity._gathered(texts).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_model_tables_have_partitions_by_their_size(spark, odd_docs):
    want = sorted(perplexity.fit(odd_docs).rows.collect())
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        rows = perplexity.fit(odd_docs).rows
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted(rows.collect()) == want
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
