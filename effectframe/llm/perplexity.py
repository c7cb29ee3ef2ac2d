"""Quality rules: counts per text and perplexity under an n-gram model of its language.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters. Spark counts
the character n-grams of all texts, exactly and by the n-gram itself; lower orders count
left neighbours. Probabilities are DataFrame expressions, order by order. They are stored
as costs (-ln p in millionths, whole numbers, so sums do not depend on any order) in arrays
sorted by a 64-bit hash of the n-gram, cut into parts by the head of the hash.

A model whose arrays are small, by their measured size, goes to every task; a larger one is joined:
each block of texts asks for the hashes it needs and gets them as sorted arrays of its own. The
same function scores in both cases, so costs are equal.

Bands are per language: quartiles of the mean cost of its texts, widened by their distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.word_scan import CHUNK, byte_table, chunked, grouped_texts, scan
from effectframe.operators.joins import salted_join
from effectframe.session import cut_lineage

ORDER = 5
#: Millionths of a nat in a cost.
SCALE = 1_000_000
#: Bytes of model arrays that may go to every task, entries of a part, and bytes of texts in a block beyond that size.
SHARED_BYTES = 128 << 20
PART = 1 << 18
BLOCK_BYTES = 16 << 20
#: Bytes of text from which on a task counts n-grams by itself.
TASK_BYTES = 16 << 20
#: Rows of the model's tables in a partition.
TABLE_ROWS = 1 << 18
#: Rules: least words, and share of words in repeated windows at most, in percent.
LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: Bands reach ``WIDTH`` quartile distances beyond the quartiles; a distance is at least ``FLOOR`` of a thousandth of a nat.
WIDTH = 4
FLOOR = 25

_GAP = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOLS = byte_table(b"#*$%&|<>")
_LINE = byte_table(b"\n")
#: What the model reads: A-Z as a-z, digits as 0, the zero byte as DEL.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\x00", b"abcdefghijklmnopqrstuvwxyz000000000\x7f")
_EDGE = "\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, words joined by one blank, and where the characters to predict of each begin and end.

    Every text stands between ``ORDER - 1`` edge signs and one; the last is predicted too. A text without words has nothing to predict.
    """
    lead = _EDGE * (ORDER - 1)
    words = [b" ".join(t.split()).translate(_FOLD).decode("utf-8", "replace") for t in texts]
    whole = "".join([f"{lead}{w}{_EDGE}" for w in words])
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths + ORDER) - lengths - 1
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), begins, begins + np.where(lengths > 0, lengths + 1, 0)


def _seed(length: int, back: bool = False) -> np.uint64:
    return np.uint64((length + 1 + 16 * back) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)


def _hashes(points: np.ndarray, at: np.ndarray, length: int, back: bool = False) -> np.ndarray:
    """Hashes of the ``length`` code points from each place on."""
    found = np.full(len(at), _seed(length, back), np.uint64)
    for k in range(length):
        found ^= points[at + k]
        found *= _STEP
        found ^= found >> np.uint64(29)
    return found


def _predicted(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each begin up to its end."""
    lengths = ends - begins
    return np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _grams(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``ORDER`` characters from each place on, as strings, and how often each is there.

    A run is one number of the places of its characters in the alphabet; above 4,096 characters of the alphabet it is hashed.
    """
    present = np.zeros(int(points.max()) + 1 if len(points) else 1, bool)
    present[points] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * ORDER > 64:
        _, first, counts = np.unique(_hashes(points, at, ORDER), return_index=True, return_counts=True)
        return points[at[first][:, None] + np.arange(ORDER)].view(f"<U{ORDER}").ravel(), counts
    place = np.cumsum(present)[points].astype(np.uint64) - np.uint64(1)
    keys = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        keys <<= np.uint64(bits)
        keys |= place[at + k]
    # Sorting whole numbers without their places is an order of magnitude faster than ordering places.
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
    signs = (keys[first][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return np.ascontiguousarray(alphabet[signs.astype(np.int64)]).view(f"<U{ORDER}").ravel(), np.diff(np.append(first, len(keys)))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, a) of (lang, text): every run of ``ORDER`` characters, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, held in chunked(grouped_texts(batches)):
            points, begins, ends = _folded(held)
            grams, f = _grams(points, _predicted(begins, ends) - (ORDER - 1))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(f), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(f, pa.int64())], ["lang", "gram", "a"])

    return texts.mapInArrow(run, "lang string, gram string, a long").groupBy("lang", "gram").agg(F.sum("a").alias("a"))


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, length, d1, d2, d3, types): discounts of counts 1, 2 and from 3, from how many n-grams have counts 1 to 4.

    Where they are not between 0 and their count they are 0.5, 1 and 1.5.
    """
    times = [F.sum((F.col("a") == k).cast("long")).cast("double") for k in (1, 2, 3, 4)]
    found = grams.groupBy("lang", "length").agg(*[c.alias(f"n{k}") for k, c in enumerate(times, 1)], F.count("*").alias("types"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    full = F.least(*[F.col(f"n{k}") for k in (1, 2, 3, 4)]) > 0
    raw = [F.when(full, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")) for k in (1, 2, 3)]
    sound = (raw[0] > 0) & (raw[0] <= 1) & (raw[1] > 0) & (raw[1] <= 2) & (raw[2] > 0) & (raw[2] <= 3)
    ok = F.coalesce(full & sound, F.lit(False))
    return found.select("lang", "length", "types", *[F.when(ok, r).otherwise(d).alias(f"d{k}") for k, (r, d) in enumerate(zip(raw, (0.5, 1.0, 1.5), strict=True), 1)])


def _cost(p: Column) -> Column:
    return F.round(-F.log(p) * SCALE).cast("int")


def model_costs(counted: DataFrame) -> DataFrame:
    """(lang, length, back, gram, cost): costs of all n-grams up to ``ORDER`` and of backing off from their beginnings.

    The n-gram of length 0 stands for an unseen character. ``counted`` is (lang, gram, a), read
    several times. Every stage takes all orders at once, but for the sum over orders. Tables lie in partitions
    by their size, not by that of shuffles: a partition is a file here and some in each shuffle that reads it. Runs jobs.
    """
    most = max(counted.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // TABLE_ROWS))
    stored = lambda rows: cut_lineage(rows.coalesce(most))
    orders = counted
    grams = counted.withColumn("length", F.lit(ORDER))
    for n in range(ORDER - 1, 0, -1):
        orders = orders.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("a")).coalesce(most)
        grams = grams.unionByName(orders.withColumn("length", F.lit(n)))
    grams = stored(grams.withColumn("head", F.expr("substring(gram, 1, length - 1)")))
    times = [F.sum(c.cast("long")).alias(f"c{k}") for k, c in enumerate((F.col("a") == 1, F.col("a") == 2, F.col("a") >= 3), 1)]
    heads = grams.groupBy("lang", "length", "head").agg(F.sum("a").alias("total"), *times)
    # A language has one row per order here; its heads may be most of all heads.
    counts = grams.groupBy("lang", "length").agg(F.count("*").alias("n"))
    heads = salted_join(heads, _discounts(grams), ["lang", "length"], counts)
    gamma = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")
    heads = stored(heads.withColumn("gamma", F.when(F.col("length") == 1, gamma / (F.col("types") + 1)).otherwise(gamma)))
    off = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = grams.join(heads, ["lang", "length", "head"]).select("lang", "length", "gram", ((F.col("a") - off) / F.col("total")).alias("seen"), "gamma")
    seen = stored(seen.withColumn("tail", F.expr("substring(gram, 2, length - 1)")))
    levels = [seen.filter(F.col("length") == 1).select("lang", "length", "gram", (F.col("seen") + F.col("gamma")).alias("p"))]
    for n in range(2, ORDER + 1):
        tail = levels[-1].select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"))
        joined = seen.filter(F.col("length") == n).join(tail, ["lang", "tail"])
        levels.append(stored(joined.select("lang", "length", "gram", (F.col("seen") + F.col("gamma") * F.col("below")).alias("p"))))
    backing = heads.select("lang", (F.col("length") - 1).alias("length"), (F.col("length") > 1).alias("back"), F.col("head").alias("gram"), _cost(F.col("gamma")).alias("cost"))
    for level in levels:
        backing = backing.unionByName(level.select("lang", "length", F.lit(False).alias("back"), "gram", _cost(F.col("p")).alias("cost")))
    return backing.coalesce(most)


_ARRAYS = "lang string, part long, hashes binary, costs binary"


class Model:
    """Costs by hash: rows (lang, hash, cost) and the same as sorted arrays (lang, part, hashes, costs)."""

    def __init__(self, costs: DataFrame):
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length, back = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                keys = np.zeros(len(length), np.uint64)
                for n in range(ORDER + 1):
                    for kind in (False, True):
                        mine = np.flatnonzero((length == n) & (back == kind))
                        if len(mine):
                            points = np.frombuffer("".join(batch.column(3).take(pa.array(mine)).to_pylist()).encode("utf-32-le"), np.uint32)
                            keys[mine] = _hashes(points, np.arange(len(mine)) * n, n, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), batch.column(4)], ["lang", "hash", "cost"])

        def sorted_arrays(table: pa.Table) -> pa.Table:
            hashes, costs = table["hash"].to_numpy().view(np.uint64), table["cost"].to_numpy()
            order = np.argsort(hashes)
            made = [table["lang"][:1], table["part"][:1], [hashes[order].tobytes()], [costs[order].tobytes()]]
            return pa.table(dict(zip(["lang", "part", "hashes", "costs"], made, strict=True)), schema=pa.schema([("lang", pa.string()), ("part", pa.int64()), ("hashes", pa.binary()), ("costs", pa.binary())]))

        self.rows = cut_lineage(costs.mapInArrow(hashed, "lang string, hash long, cost int"))
        self.entries = self.rows.count()
        bits = max(0, (self.entries // PART).bit_length())
        part = (F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0)).cast("long").alias("part")
        self.arrays = self.rows.select("lang", part, "hash", "cost").groupBy("lang", "part").applyInArrow(sorted_arrays, _ARRAYS)

    def bytes(self) -> int:
        return self.entries * 12


def _opened(keys: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes and their costs with, for each head of a hash, where those with it begin."""
    bits = len(keys).bit_length() + 1
    heads = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount(heads, minlength=1 << bits), out=begins[1:])
    return keys, costs, begins


def _lookup(arrays: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs, and which hashes are there. Hashes are spread evenly, so few share a head."""
    keys, costs, begins = arrays
    found, hit = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    if not len(keys):
        return found, hit
    head = (hashes >> np.uint64(64 - (len(begins) - 1).bit_length() + 1)).astype(np.int64)
    at, behind = begins[head], begins[head + 1]
    open_ = np.flatnonzero(at < behind)
    at, behind = at[open_], behind[open_]
    while len(open_):
        there = keys[at]
        wanted = hashes[open_]
        same = there == wanted
        found[open_[same]] = costs[at[same]]
        hit[open_[same]] = True
        at = at + 1
        more = np.flatnonzero((there < wanted) & (at < behind))
        open_, at, behind = open_[more], at[more], behind[more]
    return found, hit


def _text_costs(texts: list[bytes], arrays: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Summed cost of each text and how many characters were predicted."""
    points, begins, ends = _folded(texts)
    at = _predicted(begins, ends)
    costs, hit = _lookup(arrays, _hashes(points, at - (ORDER - 1), ORDER))
    missed = np.flatnonzero(~hit)
    for n in range(ORDER - 1, -1, -1):
        if not len(missed):
            break
        if n:
            costs[missed] += _lookup(arrays, _hashes(points, at[missed] - n, n, True))[0]
        cost, hit = _lookup(arrays, _hashes(points, at[missed] - n + 1, n))
        costs[missed] += cost
        missed = missed[~hit]
    upto = np.append(0, np.cumsum(costs))
    last = np.cumsum(ends - begins)
    return upto[last] - upto[last - (ends - begins)], ends - begins


def _needed(texts: list[bytes]) -> np.ndarray:
    """All hashes that scoring the texts may look up."""
    points, begins, ends = _folded(texts)
    at = _predicted(begins, ends)
    found = [_hashes(points, at - n + 1, n) for n in range(1, ORDER + 1)] + [_hashes(points, at - n, n, True) for n in range(1, ORDER)]
    return np.unique(np.concatenate([np.array([_seed(0)]), *found]))


def _maybe_twice(columns: list[np.ndarray]) -> np.ndarray:
    """Places of all rows that another one equals, and of a few others: rows are told apart by hashes first, which sort fast."""
    hashes = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        hashes ^= column.astype(np.uint64)
        hashes *= _STEP
        hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    heads = np.zeros(1 << 20, bool)
    heads[ordered[1:][ordered[1:] == ordered[:-1]] >> np.uint64(44)] = True
    return np.flatnonzero(heads[hashes >> np.uint64(44)])


def rule_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of every text, as whole-array steps over all of them."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    n = len(texts)

    def inside(mask: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mask))
        return upto[ends] - upto[begins]

    word_byte = ~_GAP[data]
    words, lines = scan(data, _GAP), scan(data, _LINE)
    doc = np.searchsorted(begins, words.starts, "right") - 1
    filled = np.append(0, np.cumsum(word_byte))
    real = np.flatnonzero(filled[lines.ends] > filled[lines.starts])
    line_doc = np.searchsorted(begins, lines.starts[real], "right") - 1
    distinct = np.unique(line_doc.astype(np.int64) << 32 | lines.ids[real]) >> 32
    ids = words.ids
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    at = at[_maybe_twice([ids[at], ids[at + 1], ids[at + 2], doc[at]])]
    columns = [ids[at + 2], ids[at + 1], ids[at]]
    if len(words.names) < 1 << 21:
        columns = [columns[2].astype(np.int64) << 42 | columns[1].astype(np.int64) << 21 | columns[0]]
    columns.append(doc[at])
    order = np.lexsort(columns)
    new = np.ones(len(order) + 1, bool)
    for column in columns:
        ordered = column[order]
        new[1:-1] = (new[1:-1] if column is not columns[0] else False) | (ordered[1:] != ordered[:-1])
    again = at[order[~(new[:-1] & new[1:])]]
    covered = np.zeros(len(ids) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": inside(word_byte & ((data & 0xC0) != 0x80)),
        "n_symbols": inside(_SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": np.bincount(doc, weights=covered[: len(ids)], minlength=n).astype(np.int64) if len(ids) else np.zeros(n, np.int64),
    }


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = "id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, n_predicted long"


def _measure(ids: list, langs: list, texts: list[bytes], arrays) -> pa.RecordBatch:
    counts = rule_counts(texts)
    cost, predicted = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    for lang, mine in by_lang.items():
        cost[mine], predicted[mine] = _text_costs([texts[i] for i in mine], arrays(lang))
    columns = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *[pa.array(counts[c], pa.int64()) for c in _COUNTS], pa.array(cost), pa.array(predicted)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MEASURED.split(", ")])


def _measured(rows: Iterator[tuple], arrays) -> Iterator[pa.RecordBatch]:
    """Batches of about ``CHUNK`` bytes of text from (id, lang, text)."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 1
        if size >= CHUNK:
            yield _measure(*map(list, zip(*held, strict=True)), arrays)
            held, size = [], 0
    if held:
        yield _measure(*map(list, zip(*held, strict=True)), arrays)


def _rows(batch) -> Iterator[tuple]:
    ids, langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
    for i, lang in enumerate(langs):
        yield ids[i], lang, texts[i].as_py() or b""


_NONE = _opened(np.zeros(0, np.uint64), np.zeros(0, np.int32))
_OPEN: dict[int, dict] = {}


def _whole(shared) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays by language from the shared parts; a worker keeps those of one model."""
    if shared.id not in _OPEN:
        _OPEN.clear()
        parts: dict[str, list] = {}
        for lang, _, hashes, costs in shared.parts.value:
            parts.setdefault(lang, []).append((np.frombuffer(hashes, np.uint64), np.frombuffer(costs, np.int32)))
        _OPEN[shared.id] = {lang: _opened(*(np.concatenate(c) for c in zip(*found, strict=True))) for lang, found in parts.items()}
    return _OPEN[shared.id]


class _Shared:
    def __init__(self, parts, number: int):
        self.parts, self.id = parts, number


def _scored_here(rows: DataFrame, model: Model) -> DataFrame:
    """With the whole model in every task; its size has been checked."""
    parts = sorted((r.lang, r.part, bytes(r.hashes), bytes(r.costs)) for r in model.arrays.collect())
    cast = rows.sparkSession.sparkContext.broadcast(parts)
    shared = _Shared(cast, id(cast))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(shared)
        yield from _measured((r for b in batches for r in _rows(b)), lambda lang: whole.get(lang, _NONE))

    return rows.mapInArrow(run, _MEASURED)


def _scored_by_join(rows: DataFrame, model: Model, block_bytes: int) -> DataFrame:
    """Blocks of texts ask for the hashes they need; each meets its own part of the model. Runs a job."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0))).first()[0]
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    # Ids and texts spread copies of one text as well as rows without an id.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = ((f"{block}\t{lang}", text) for b in batches for block, (_, lang, text) in zip(b.column(3).to_pylist(), _rows(b), strict=True))
        for group, texts in chunked(keyed):
            block, lang = group.split("\t", 1)
            needed = _needed(texts)
            columns = [pa.array(np.full(len(needed), int(block))), pa.array([lang] * len(needed), pa.string()), pa.array(needed.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "hash"])

    asked = dealt.repartition(blocks, "block").mapInArrow(ask, "block long, lang string, hash long").distinct()
    answers = asked.join(model.rows, ["lang", "hash"]).select("block", "lang", "hash", "cost")

    def answer(texts: pa.Table, costs: pa.Table) -> pa.Table:
        order = np.argsort(costs["hash"].to_numpy().view(np.uint64))
        langs = np.array(costs["lang"].to_pylist(), object)[order]
        hashes, values = costs["hash"].to_numpy().view(np.uint64)[order], costs["cost"].to_numpy()[order]
        whole = {lang: _opened(hashes[langs == lang], values[langs == lang]) for lang in set(langs)}
        found = list(_measured((r for b in texts.to_batches() for r in _rows(b)), lambda lang: whole.get(lang, _NONE)))
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in _MEASURED.split(", "))])
        return pa.Table.from_batches(found, schema)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, _MEASURED)


def _tasks(texts: DataFrame) -> int:
    """Tasks that count the n-grams of the texts; runs a job."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def _gathered(texts: DataFrame, tasks: int | None = None) -> DataFrame:
    """``texts`` in fewer partitions where these are small, as each sends the n-grams it has once. No shuffle; runs a job without ``tasks``."""
    return texts.coalesce(tasks or _tasks(texts))


def _typed(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all texts, one per language (null: und). Counts have no cap and grow with the texts. Runs jobs."""
    texts = _typed(docs.withColumn("__none", F.lit(None).cast("long")), "__none", lang_col, text_col).select("lang", "text")
    tasks = _tasks(texts)
    return Model(model_costs(cut_lineage(gram_counts(_gathered(texts, tasks)).coalesce(tasks))))


def scores(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    shared_bytes: int = SHARED_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, lang, counts of the rules, base_failed, perplexity) per row, and ``level``, the mean cost in thousandths.

    Perplexity is per character, of the words in lower case joined by one blank; null without words or
    without a model of the language. Null ids, repeated rows and null languages (und) stay; a null
    text is empty. Runs jobs.
    """
    rows = _typed(docs, id_col, lang_col, text_col)
    small = model.bytes() <= shared_bytes
    found = _scored_here(rows, model) if small else _scored_by_join(rows, model, block_bytes)
    judged = (F.col("n_predicted") > 0) & (F.col("cost") > 0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    level = F.when(judged, F.expr(f"cost div (n_predicted * {SCALE // 1000}L)"))
    perplexity = F.when(judged, F.exp(F.col("cost") / (F.col("n_predicted") * SCALE)))
    return found.select("id", "lang", *_COUNTS, failed.alias("base_failed"), perplexity.alias("perplexity"), level.alias("level"))


def bands(scored: DataFrame, width: float = WIDTH, floor: int = FLOOR) -> DataFrame:
    """(lang, low, high) of ``level`` from the rows that pass the rules.

    Quartiles are exact, from counts per level (a language has some thousand levels at most).
    """
    levels = scored.filter(~F.col("base_failed") & F.col("level").isNotNull()).groupBy("lang", "level").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("level"))
    all_of = F.sum("n").over(W.partitionBy("lang"))
    placed = levels.select("lang", "level", upto.alias("upto"), all_of.alias("all"))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("level")))
    found = placed.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(floor)) * F.lit(width)
    return found.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def verdicts(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with ``low``, ``high`` and ``kept``: rules passed and the level within the band of the language.

    What has no level or no band is kept when it passes the rules.
    """
    counts = scored.groupBy("lang").agg(F.count("*").alias("n"))
    joined = salted_join(scored, limits, ["lang"], counts)
    outside = F.coalesce((F.col("level") < F.col("low")) | (F.col("level") > F.col("high")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~outside)


def quality_verdicts(
    docs: DataFrame,
    width: float = WIDTH,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    shared_bytes: int = SHARED_BYTES,
) -> DataFrame:
    """Model, scores, bands and verdicts of one table: one row per row (see ``scores`` and ``verdicts``). Runs jobs.

    An empty table gives no rows; columns besides the three are not read.
    """
    scored = cut_lineage(scores(docs, fit(docs, lang_col, text_col), id_col, lang_col, text_col, shared_bytes))
    return verdicts(scored, bands(scored, width))
