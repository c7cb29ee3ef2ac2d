"""Token counts by the whole-token shortcut.

Once per vocabulary, on the driver, every vocabulary string is merged by itself; those
which come out as one token are proven to count 1 wherever they are a whole
pre-token. Texts are split, proven pre-tokens are counted by a look-up, and only the
others are merged, each distinct one once per worker as long as the memo holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.llm.vocab import blocks, merge, read_merges, split

MEMO = 500_000


def proven_tokens(merges: dict[tuple[bytes, bytes], int], vocabulary: list[bytes]) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token; those which are no whole text are left out."""
    rank = lambda a, b: merges.get((a, b))
    proven = set()
    for token in vocabulary:
        if merge(token, rank) == [token]:
            try:
                proven.add(token.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return frozenset(proven)


class _Counts(dict):
    """Tokens per pre-token: proven ones from the start, others merged when first asked for."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self._rank = lambda a, b: merges.get((a, b))
        self._proven = proven

    def __missing__(self, piece: str) -> int:
        count = len(merge(piece.encode("utf-8", "replace"), self._rank))
        if len(piece) <= 64:
            if len(self) >= MEMO + len(self._proven):
                self.clear()
                self.update(dict.fromkeys(self._proven, 1))
            self[piece] = count
        return count


_LOADED: dict[str, tuple] = {}


def _loaded(shared, path: str):
    """Counter and special-string pattern of this worker process; made once per vocabulary."""
    if path not in _LOADED:
        merges, proven, special = shared.value
        pattern = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        _LOADED[path] = _Counts(merges, proven), pattern
    return _LOADED[path]


def _count(text: str, counts: _Counts, special) -> int:
    total = 0
    if special is not None:
        found = special.findall(text)
        if found:
            return len(found) + sum(_count(part, counts, None) for part in special.split(text))
    for block in blocks(text):
        total += sum(map(counts.__getitem__, split(block)))
    return total


def count_batch(texts: pa.Array, shared, path: str) -> tuple[list[int], list[int]]:
    """(bytes, tokens) of each text."""
    counts, special = _loaded(shared, path)
    n_bytes, n_tokens = [], []
    for value in texts:
        text = value.as_py() or ""
        n_bytes.append(len(text.encode("utf-8", "replace")))
        n_tokens.append(_count(text, counts, special))
    return n_bytes, n_tokens


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the tokenizers library counts without added tokens.

    ``path`` names a byte-level BPE tokenizer in JSON. Special strings inside a text count
    as their one token. Null texts are empty and count 0; null ids and repeated rows
    stay as they are; an empty table gives no rows. No shuffle.
    """
    merges, vocabulary, special = read_merges(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges, proven_tokens(merges, vocabulary), special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_tokens = count_batch(batch.column(1), shared, path)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
