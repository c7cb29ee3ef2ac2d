"""Bottom-k sketches of word shingles, in column expressions only.

A sketch is the ``k`` least distinct hashes of a text's shingles, ascending. Sketches of
parts merge by keeping the ``k`` least of their union. Two sketches estimate how alike
two shingle sets are, how far one holds the other, and how large each is; below ``k``
distinct shingles the values are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from effectframe.llm.cells import with_cells

K = 128
WORDS = 5
#: Fixed value: what separates words, as a list of characters and as a pattern.
BLANKS = " \t\n\x0b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"
CELL_BYTES = 4 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has lambdas of its own."""
    return F.transform(F.array(value), use)[0]


def _hashes(text: Column, words: int) -> Column:
    """Hash of every shingle; a shorter text is one shingle, a text without words has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    parts = F.transform(F.split(trimmed, _GAP), lambda w: F.xxhash64(w))

    def shingles(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - F.lit(words - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, words)))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(_let(parts, shingles))


def bottom_k(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sketch of a text, an ascending array of at most ``k`` longs; null texts are empty."""
    return F.slice(F.sort_array(F.array_distinct(_hashes(F.coalesce(text, F.lit("")), words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among all of both: of the union's sketch, those in both. 1 if both are empty."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union).cast("double"))

    return _let(merged(a, b, k), share)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the place of the k-th least hash."""
    place = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of ``a`` which ``b`` has, at most 1; null if ``a`` has none."""
    like, n_a, n_b = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), like * (n_a + n_b) / ((1 + like) * n_a)))


def as_text(sketch: Column) -> Column:
    """16 hex digits per hash; empty for a text without words."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_parts(parts: DataFrame, keys: Sequence[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from those of its parts; every map task sends ``k`` hashes per key at most."""
    hashes = parts.select(*keys, F.explode_outer(sketch_col).alias("__h")).distinct()
    ranked = hashes.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last())))
    least = ranked.filter(F.col("__n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Callable[[Column], Column]]:
    """(id, text) with a way to look at the following row, descending by id; after the last comes the first.

    Ids are dealt into contiguous cells. The first row of a cell is copied to the end
    of the cell before it, so a window inside cells sees every neighbour, and each text
    moves once. Rows without an id come last. Copies have ``carried = 1`` and are to be
    dropped after the look.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    celled = with_cells(rows, "id", F.octet_length("text") + F.lit(64), CELL_BYTES, "cell", F.col("text"))
    order = F.struct(F.coalesce("id", F.lit(-(2**63))), F.xxhash64("text"))
    heads = celled.groupBy("cell").agg(F.max_by(F.struct("id", "text"), order).alias("head"))
    cells = celled.select("cell").distinct()
    up = W.orderBy("cell")
    least = W.partitionBy()
    target = F.coalesce(F.lead("cell").over(up), F.min("cell").over(least))
    moved = heads.join(cells.select("cell", target.alias("__to")), "cell")
    tails = moved.select(F.col("head.id").alias("id"), F.col("head.text").alias("text"), F.col("__to").alias("cell"), F.lit(1).alias("carried"))
    every = celled.withColumn("carried", F.lit(0)).unionByName(tails)
    window = W.partitionBy("cell").orderBy("carried", F.col("id").desc_nulls_last(), F.xxhash64("text").desc())
    return every, lambda column: F.lead(column).over(window)


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch, that of its edited text, and how alike they and the next document's are.

    The edited text has its last half (rounded down, in code points) replaced by as many
    first ones of the next document, descending by id, or by all it has. A null text is
    empty; a sole document follows itself; rows with equal ids follow each other in
    the order of a hash; an empty table gives no rows. Returns id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the
    estimated n_shingles. Runs a small job for the cells.
    """
    every, following = with_next_text(docs, id_col, text_col)
    half = F.expr("n_chars div 2")
    seen = every.withColumns({"n_chars": F.length("text").cast("long"), "next_text": following(F.col("text"))})
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.left(F.coalesce("next_text", F.lit("")), half.cast("int")))
    own = seen.select(
        "id", "cell", "carried", "text", "n_chars", bottom_k(F.col("text"), k, words).alias("own"), edited.alias("edited")
    )
    last = own.select(
        "*",
        following(F.col("own")).alias("next_own"),
    ).filter(F.col("carried") == 0)
    return last.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", bottom_k(F.col("edited"), k, words).alias("changed"), "next_own"
    ).select(
        "id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
