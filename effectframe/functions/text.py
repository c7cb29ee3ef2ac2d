"""String expressions over Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from effectframe import constants as C

_BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim blanks, tabs and line ends, not only spaces."""
    return F.btrim(col, F.lit(_BLANKS))


def clean_str(col: Column) -> Column:
    """Stripped text; null, blank and ``nan`` count as empty."""
    s = strip(col.cast("string"))
    return F.when(s.isNull() | (F.lower(s) == "nan"), F.lit("")).otherwise(s)


def is_nonempty(col: Column) -> Column:
    """True where some text is left after stripping (``nan`` is text here)."""
    return F.coalesce(strip(col.cast("string")), F.lit("")) != ""


def first_nonempty(cols: Sequence[Column]) -> Column:
    if not cols:
        return F.lit("")
    return F.coalesce(*[F.nullif(clean_str(c), F.lit("")) for c in cols], F.lit(""))


def missing_to_null(col: Column) -> Column:
    return F.when(~col.isin(C.MISSING_TEXTS), col)


def strip_protein_version(col: Column) -> Column:
    base = F.regexp_extract(col, C.PROTEIN_ID_PATTERN, 1)
    return F.when(base != "", base).otherwise(col)


def protein_change(col: Column) -> Column:
    """The ``p.`` part of a notation, null when there is none."""
    return F.nullif(F.regexp_extract(col, C.PROTEIN_CHANGE_PATTERN, 1), F.lit(""))


def strip_reference_prefix(col: Column) -> Column:
    """Text after the first colon; unchanged without one."""
    cut = F.locate(":", col)
    return F.when(cut > 0, F.substr(col, cut + 1)).otherwise(col)


def join_terms(col: Column) -> Column:
    """Comma-joined non-empty list members; null when none is left."""
    kept = F.filter(col, lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(kept, ","), F.lit(""))


def sanitize_dna(col: Column) -> Column:
    """Upper case with every letter outside A, C, G, T, N turned into N.

    Foreign letters go first, so that the length cannot change in upper-casing.
    """
    letters = C.DNA_LETTERS + C.DNA_LETTERS.lower()
    return F.upper(F.regexp_replace(col, f"[^{letters}]", "N"))


def sanitize_protein(col: Column) -> Column:
    """Gap-free upper case, letters outside the 20 amino acids as X; null is empty."""
    letters = C.AMINO_ACID_LETTERS + C.AMINO_ACID_LETTERS.lower()
    ungapped = F.replace(col, F.lit("-"), F.lit(""))
    return F.coalesce(F.upper(F.regexp_replace(ungapped, f"[^{letters}]", "X")), F.lit(""))


def normalize_term_id(col: Column) -> Column:
    """First ontology id in the text, written with a colon; null when there is none."""
    found = F.regexp_extract(col, C.TERM_ID_PATTERN, 1)
    return F.when(found != "", F.translate(found, "_", ":"))


def variation_key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def pretty_terms(col: Column) -> Column:
    """``a_b,A_b, c`` becomes ``a b, c``: first spelling kept, case ignored."""
    nice = F.translate(clean_str(col), "_", " ")
    # The list work is for rows with a list only.
    return F.when(F.contains(nice, F.lit(",")), _distinct_terms(nice)).otherwise(nice)


def _distinct_terms(listed: Column) -> Column:
    parts = F.filter(F.transform(F.split(listed, ","), strip), lambda p: p != "")
    lower = F.transform(parts, F.lower)
    kept = F.filter(parts, lambda p, i: F.array_position(lower, F.lower(p)) == i + 1)
    return F.array_join(kept, ", ")


def sha_prefix(col: Column, digits: int = 10) -> Column:
    return F.substring(F.sha2(F.coalesce(col, F.lit("")), 256), 1, digits)


def strip_hidden_reasoning(col: Column) -> Column:
    text = F.coalesce(col, F.lit(""))
    without_blocks = F.regexp_replace(text, C.THINK_BLOCK_PATTERN, "")
    return strip(F.regexp_replace(without_blocks, C.THINK_TAG_PATTERN, ""))


def sanitize_model_text(col: Column) -> Column:
    """Visible answer of a chat model: no reasoning, no leading code fence."""
    s = strip_hidden_reasoning(col)
    parts = F.split(s, "```", 3)
    fenced = F.startswith(s, F.lit("```")) & (F.size(parts) == 3)
    return F.when(fenced, strip(F.element_at(parts, -1))).otherwise(s)
