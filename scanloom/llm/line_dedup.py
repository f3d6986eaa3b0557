"""Line dedup: lines that occur in several documents stay only in the first of them.

Built-in expressions only. A line's key is the line stripped of ASCII white space with A-Z
lowered. Keys are 128-bit hashes from the start, so the text of a line is never shuffled.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; a key repeated inside its first document keeps all its lines there; rows that share a
doc_id count as one document a null doc_id counts as the
document after all others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import BLANKS, lower_ascii

MIN_CHARS = 10
MIN_DOCS = 2


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_ld_a"), F.xxhash64(F.lit("line"), key).alias("_ld_b")]


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the shared lines removed from ``text_col``; adds ``n_lines``, ``n_dropped``.

    Counting needs one shuffle of line hashes with partial aggregation, so a line that every
    document holds costs one row per task. The lines then meet the short list of shared keys in a
    plain equi-join, whose large partitions Spark can split. Documents receive the positions of
    their own dropped lines.
    """
    last = F.lit((1 << 63) - 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    rows = docs.withColumn("_ld_doc", F.coalesce(F.col(id_col), last)).withColumn("_ld_row", F.xxhash64(text))
    own = (
        rows.select("_ld_doc", "_ld_row", F.posexplode(lines).alias("_ld_at", "_ld_line"))
        .select("_ld_doc", "_ld_row", "_ld_at", _key(F.col("_ld_line")).alias("_ld_key"))
        .filter(F.length("_ld_key") >= min_chars)
        .select("_ld_doc", "_ld_row", "_ld_at", *_hashes(F.col("_ld_key")))
    )
    several = (
        F.min("_ld_doc") < F.max("_ld_doc") if min_docs == 2 else F.count_distinct("_ld_doc") >= min_docs
    )
    shared = (
        own.groupBy("_ld_a", "_ld_b")
        .agg(F.min("_ld_doc").alias("_ld_first"), several.alias("_ld_several"))
        .filter("_ld_several")
        .select("_ld_a", "_ld_b", "_ld_first")
    )
    # By sorting: the size check does not know that a text became many lines.
    dropped = (
        own.hint("merge").join(shared, ["_ld_a", "_ld_b"])
        .filter(F.col("_ld_doc") > F.col("_ld_first"))
        .groupBy("_ld_doc", "_ld_row")
        .agg(F.collect_list("_ld_at").alias("_ld_gone"))
    )
    # array_except works by hash set, so a text of many lines costs time in proportion to them.
    every = F.sequence(F.lit(0), F.size("_ld_lines") - 1)
    return (
        rows.join(dropped, ["_ld_doc", "_ld_row"], "left")
        .withColumn("_ld_lines", lines)
        .withColumn("_ld_kept", F.array_except(every, F.coalesce("_ld_gone", F.array().cast("array<int>"))))
        .select(
            *[c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")],
            F.array_join(F.transform("_ld_kept", lambda i: F.get("_ld_lines", i)), "\n").alias(text_col),
            F.size("_ld_lines").cast("long").alias("n_lines"),
            (F.size("_ld_lines") - F.size("_ld_kept")).cast("long").alias("n_dropped"),
        )
    )
