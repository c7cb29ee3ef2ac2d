"""Prompt context, chat records and prompt statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectframe import constants as C
from effectframe.functions import text


def with_contexts(df: DataFrame, contexts: dict[str, Sequence[str]]) -> DataFrame:
    """Adds context columns: ``{new column: prompt columns (any case) left blank in it}``.

    Empty fields leave no line, the consequence always has one. The fields are
    cleaned in a projection of their own, once per row for all contexts.
    """
    sources = [
        c
        for c in ("gene_symbol", "GeneSymbol", "hgvsc", "hgvsp", "most_severe_consequence")
        if c in df.columns
    ]
    cleaned = df.withColumns({f"__p_{c}": text.clean_str(F.col(c)) for c in sources})
    most = F.translate(F.col("__p_most_severe_consequence"), "_", " ")
    terms = "consequence_terms" in df.columns
    cleaned = cleaned.withColumns(
        {
            "__p_most": most if "most_severe_consequence" in sources else F.lit(""),
            "__p_terms": text.pretty_terms(F.col("consequence_terms")) if terms else F.lit(""),
        }
    )

    def context(blank: Sequence[str]) -> Column:
        hidden = {b.lower() for b in blank}

        def line(head: str, *names: str) -> Column:
            shown = [F.col(f"__p_{n}") for n in names if n in sources and n.lower() not in hidden]
            lines = [F.when(v != "", F.concat(F.lit(head), v)) for v in shown]
            return F.coalesce(*lines) if lines else F.lit(None).cast("string")

        most = F.lit("") if "most_severe_consequence" in hidden else F.col("__p_most")
        extra = F.lit("") if "consequence_terms" in hidden else F.col("__p_terms")
        differs = (extra != "") & (F.lower(extra) != F.lower(most))
        return F.concat_ws(
            "\n",
            line("Gene: ", "gene_symbol", "GeneSymbol"),
            line("HGVS.c: ", "hgvsc"),
            line("HGVS.p: ", "hgvsp"),
            F.concat(F.lit("Most severe consequence: "), most),
            F.when(differs, F.concat(F.lit("Consequence terms: "), extra)),
        )

    kept = [c for c in df.columns if c not in contexts]
    return cleaned.select(*kept, *[context(b).alias(name) for name, b in contexts.items()])


def prompt_text(context: Column) -> Column:
    return F.concat(F.lit(C.PROMPT_HEAD), context, F.lit(C.PROMPT_TAIL))


def with_prompts(df: DataFrame, label: str = "_y", blank: Sequence[str] = ()) -> DataFrame:
    """Adds ``prompt`` and, with a label column, the ``target`` word."""
    out = with_contexts(df, {"__context": blank})
    out = out.withColumn("prompt", prompt_text(F.col("__context"))).drop("__context")
    if label in df.columns:
        word = F.when(F.col(label) == 1, C.LABEL_WORDS[1]).otherwise(C.LABEL_WORDS[0])
        out = out.withColumn("target", word)
    return out


def chat_messages(user: Column, target: Column | None = None) -> Column:
    """System and user message, and the answer when there is one."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = [message("system", F.lit(C.CHAT_SYSTEM)), message("user", user)]
    if target is not None:
        messages.append(message("assistant", target))
    return F.array(*messages)


def prompt_columns(df: DataFrame) -> list[str]:
    """Columns of ``df`` a prompt may show, the variant's name included."""
    return [c for c in C.PROMPT_SOURCE_COLUMNS + ["Name"] if c in df.columns]


def blank_prompts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in prompt_columns(df)})


def blank_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Blank the prompt columns named in ``fields``, whatever their case."""
    wanted = {f.lower() for f in fields}
    return df.withColumns({c: F.lit("") for c in prompt_columns(df) if c.lower() in wanted})


def joined_sources(df: DataFrame, columns: Sequence[str]) -> Column:
    """Prompt sources of a row joined with bars; missing values are empty."""
    return F.array_join(
        F.array(
            *[
                F.when(F.col(c).cast("string") == "nan", F.lit("")).otherwise(
                    F.coalesce(F.col(c).cast("string"), F.lit(""))
                )
                for c in columns
            ]
        ),
        " | ",
    )


def real_notation_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose joined sources hold a real protein or coding change."""
    joined = df.select(joined_sources(df, columns).alias("s"))
    return joined.agg(
        F.count_if(F.rlike("s", F.lit(C.REAL_HGVS_P_PATTERN))).alias("hgvsp_rows"),
        F.count_if(F.rlike("s", F.lit(C.REAL_HGVS_C_PATTERN))).alias("hgvsc_rows"),
    )


def source_diff(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """Rows whose joined sources change when ``fields`` are blanked: short digests of both versions.

    Both are expressions of one row, so nothing is joined or moved.
    """
    columns = prompt_columns(df)
    marked = df.withColumn("__before", joined_sources(df, columns))
    blank = blank_fields(marked, fields)
    both = blank.select(key, F.col("__before").alias("before"), joined_sources(blank, columns).alias("after"))
    return both.filter(F.col("before") != F.col("after")).select(
        key,
        text.sha_prefix(F.col("before")).alias("sha_before"),
        text.sha_prefix(F.col("after")).alias("sha_after"),
    )


def prompt_stats(df: DataFrame, prompt: str = "prompt", group: Sequence[str] = ()) -> DataFrame:
    """Counts, lengths and pattern hits; the median length is cut to an integer."""
    p = F.coalesce(F.col(prompt), F.lit(""))
    probed = df.select(
        *group,
        F.length(p).alias("len"),
        (text.strip(p) == "").alias("blank"),
        p.rlike(C.PROMPT_HGVS_C_PATTERN).alias("c"),
        p.rlike(C.PROMPT_HGVS_P_PATTERN).alias("p"),
        p.rlike(C.PROMPT_LABEL_PATTERN).alias("w"),
    )
    # One row per length first: the median then weighs lengths, not rows.
    folded = probed.groupBy(*group, "len").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(c) for c in ("blank", "c", "p", "w")],
    )
    return folded.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum("blank").alias("n_blank"),
        F.min("len").alias("len_min"),
        F.floor(F.percentile("len", F.lit(0.5), F.col("n"))).cast("long").alias("len_median"),
        F.max("len").alias("len_max"),
        F.sum("c").alias("hgvsc_hits"),
        F.sum("p").alias("hgvsp_hits"),
        F.sum("w").alias("label_hits"),
    )
