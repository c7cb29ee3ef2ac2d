"""Token counts and BPE against the tokenizer libraries."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from effectframe.llm import prefix_bpe, token_counts, vocab

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    lines = open(RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_strings(n):
    draw = random.Random(3)
    signs = [chr(c) for c in (32, 32, 10, 9, 0xA0, 0x3000, 39, 115, 65, 97, 0xE9, 0x558, 0x4E2D, 0x1F600, 48, 0x661, 0x2C, 0x85, 0x1C)]
    made = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(n)]
    return [*made, "", "a" * 3000, "ab<|endoftext|>c", " " * 500 + "a", "é" * 700, "<|endoftext|><|endoftext|>", "!?" * 400, None]


def as_docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_counts_are_the_library_s(spark, odd_docs, odd_rows):
    lib = tokenizers.Tokenizer.from_file(JSON)
    texts = odd_strings(300) + [t for _, t, _ in odd_rows]
    rows = token_counts.token_counts(as_docs(spark, texts), JSON, limit=20).collect()
    for row in rows:
        text = texts[row.id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 20)
    assert token_counts.token_counts(odd_docs, JSON).count() == len(odd_rows)


def test_proven_tokens_are_single():
    merges, vocabulary, _ = vocab.read_merges(JSON)
    proven = token_counts.proven_tokens(merges, vocabulary)
    lib = tokenizers.Tokenizer.from_file(JSON)
    for token in random.Random(1).sample(sorted(proven), 300):
        pieces = lib.pre_tokenizer.pre_tokenize_str(token)
        assert len(pieces) > 1 or len(lib.encode(token, add_special_tokens=False).ids) == 1


def test_encoding_is_the_library_s(spark, library, odd_rows):
    texts = odd_strings(300) + [t for _, t, _ in odd_rows]
    for row in prefix_bpe.encode_documents(as_docs(spark, texts), RANKS).collect():
        text = texts[row.id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = prefix_bpe.encoded_tokens(as_docs(spark, texts[:50]), RANKS).collect()
    assert all(r.token_ids == library.encode_ordinary(texts[r.doc_id] or "") for r in ids)


def test_appends_and_edits_keep_prefixes():
    encoder = prefix_bpe.PrefixEncoder(vocab.read_ranks(RANKS))
    draw = random.Random(2)
    data = b" ".join(bytes(draw.choices(b"etaoinshr", k=8)) for _ in range(30))
    half = encoder.prefixes(data[:100])
    whole = encoder.prefixes(data, half)
    assert whole == encoder.prefixes(data) and whole[:100] == half
    for _ in range(50):
        start = draw.randrange(len(data))
        stop = draw.randint(start, len(data))
        changed, last = encoder.edited(data, whole, start, stop, b"then")
        assert last == encoder.prefixes(changed)
        ids = encoder.tokens(changed, last)
        assert encoder.decode(ids) == changed
        assert [encoder._bytes[i] for i in ids] == encoder._merged(changed)


def test_long_pieces_merge_like_short_ones():
    ranks = vocab.read_ranks(RANKS)
    rank = lambda a, b: ranks.get(a + b)
    for piece in (b"a" * 99, b"the" * 40, b"abcabcab" * 9, bytes(range(256))):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert vocab.merge(piece, rank) == parts


def test_blocks_split_like_the_whole():
    text = " ".join(t or "" for t in odd_strings(400))
    text = "".join(c for c in text if ord(c) < 0x530)
    parts = list(vocab.blocks(text, 100))
    assert len(parts) > 5 and "".join(parts) == text
    assert [p for b in parts for p in vocab.split(b)] == vocab.split(text)


def test_empty_tables(no_docs):
    assert token_counts.token_counts(no_docs, JSON).collect() == []
    assert prefix_bpe.encode_documents(no_docs, RANKS).collect() == []


def test_distinct_pieces_are_encoded_once_and_forgotten(monkeypatch):
    ranks = vocab.read_ranks(RANKS)
    encoder = prefix_bpe.PrefixEncoder(ranks)
    encoded, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda piece: encoded.append(piece) or encode(piece))
    # More distinct pieces than are remembered, seen in turn.
    monkeypatch.setattr(prefix_bpe, "PIECES", 10)
    words = [f" xq{chr(97 + i)}zj" for i in range(26)]
    prefix_bpe.encode_texts(["".join(words) * 4] * 3, prefix_bpe._Pieces(encoder))
    assert sorted(set(encoded) - {b"\n"}) == [w.encode() for w in words] and len(encoded) == len(set(encoded))


def test_pieces_that_occur_again_outlive_those_that_do_not(monkeypatch):
    encoder = prefix_bpe.PrefixEncoder(vocab.read_ranks(RANKS))
    encoded, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda piece: encoded.append(piece) or encode(piece))
    monkeypatch.setattr(prefix_bpe, "PIECES", 10)
    pieces = prefix_bpe._Pieces(encoder)
    often = "".join(f" xq{chr(97 + i)}zj" for i in range(8))
    texts = [often + "".join(f" wq{chr(97 + k)}{chr(97 + i)}vj" for i in range(8)) for k in range(20)]
    found = [prefix_bpe.encode_texts([text], pieces) for text in texts]
    assert len(encoded) == len(set(encoded))
    # The older ones are bounded as well.
    assert len(pieces._ids) + len(pieces._older) <= 4 * 10 + 2
    assert found == [prefix_bpe.encode_texts([text], prefix_bpe._Pieces(encoder)) for text in texts]


def test_texts_split_at_once_like_each_alone():
    texts = [t for t in odd_strings(3000) if t is not None] + ["x'll", "'s", "\n'street", "a  'd", " ''re", "'r", "", "中 'm"]
    cut, bounds = vocab.split_all(texts)
    assert [[p.decode() for p in cut[i:j].to_pylist()] for i, j in bounds] == [vocab.split(t) for t in texts]


def test_pairs_stand_as_merging_leaves_them():
    encoder = prefix_bpe.PrefixEncoder(vocab.read_ranks(RANKS))
    draw = random.Random(11)
    for _ in range(3000):
        a, b = draw.sample(range(5000), 2)
        left, right = encoder._bytes[a], encoder._bytes[b]
        assert encoder._apart(a, b) == (encoder._merged(left + right) == [left, right])


def test_a_task_keeps_no_pieces(spark):
    docs = as_docs(spark, ["some words here"] * 3)

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(prefix_bpe._LOADED)]})

    prefix_bpe.encode_documents(docs, RANKS).collect()
    assert sum(r.n for r in docs.mapInArrow(kept, "n long").collect()) == 0


def test_encoding_takes_memory_of_a_chunk():
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["some", "words", "are", "short", "x"], k=1000)) for _ in range(800)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    pieces = prefix_bpe._Pieces(prefix_bpe.PrefixEncoder(vocab.read_ranks(RANKS)))
    before = pa.default_memory_pool()
    counted = pa.proxy_memory_pool(before)
    pa.set_memory_pool(counted)
    try:
        rows = [row for found in prefix_bpe.encode_batches(iter([batch]), pieces) for row in found.to_pylist()]
    finally:
        pa.set_memory_pool(before)
    assert counted.max_memory() < 24 << 20
    assert [r["id"] for r in rows] == list(range(len(texts)))
    assert [r["n_tokens"] for r in rows] == prefix_bpe.encode_texts(texts, pieces)[0]
