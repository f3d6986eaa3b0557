"""Chat formatting: conversations as one string each, with a loss mask that can be read back.

Built-in expressions only. Turns are collected per conversation, sorted, adjacent turns of one
role are merged, and every merged turn becomes ``<s>[role]text[+]text</s>``. The characters ``<``
and ``[`` open every control string of the template; inside texts and roles they, and the
escape character, are written as ``\\1``, ``\\2`` and ``\\0``, so no text can hold a control string
and unescaping gives the very same text.

Defined cases: a null text is empty; a null role is the empty role; a null turn comes first; turns
with equal numbers are ordered by role and text, and repeated rows stay; a conversation without
turns has no row; a null conv_id is a conversation of its own; other columns are not carried.
A conversation is one string by definition, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BEGIN, END = "<s>", "</s>"
ROLE_OPEN, ROLE_CLOSE, NEXT = "[", "]", "[+]"
TRAINED_ROLE = "assistant"
# Character and its escaped form, the escape character first.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``id_col`` and ``formatted``."""
    said = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    per_conv = turns.groupBy(id_col).agg(F.array_sort(F.collect_list(said)).alias("_turns"))
    # Written turn by turn against its predecessor: a turn of the same role continues the open
    # block, another closes it. Joining the pieces once keeps long conversations linear.
    at = F.sequence(F.lit(0), F.size("_turns") - 1)

    def piece(i: Column) -> Column:
        turn, before = F.get("_turns", i), F.get("_turns", i - 1)
        opening = F.concat(F.lit(BEGIN + ROLE_OPEN), escape(turn["role"]), F.lit(ROLE_CLOSE))
        lead = (
            F.when(i == 0, opening)
            .when(before["role"] == turn["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), opening))
        )
        return F.concat(lead, escape(turn["text"]))

    return per_conv.select(
        id_col, F.concat(F.array_join(F.transform(at, piece), ""), F.lit(END)).alias("formatted")
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns back, in order: ``array<struct<role, text>>``."""
    blocks = F.slice(F.split(formatted, END, -1), 1, F.size(F.split(formatted, END, -1)) - 1)

    def turns(block: Column) -> Column:
        inner = F.substring(block, len(BEGIN + ROLE_OPEN) + 1, 2147483647)
        close = F.instr(inner, ROLE_CLOSE)
        role = unescape(F.substring(inner, F.lit(1), close - 1))
        texts = F.split(F.substring(inner, close + 1, F.length(inner)), r"\[\+\]", -1)
        return F.transform(
            texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def read_back(formatted: DataFrame, id_col: str = "conv_id", column: str = "formatted") -> DataFrame:
    """Per conversation what its string says: its turns, and the text under the loss mask."""
    parsed = formatted.withColumn("turns", parse_formatted(F.col(column)))
    trained = F.filter("turns", lambda t: t["role"] == TRAINED_ROLE)
    return parsed.withColumn("loss_text", F.array_join(F.transform(trained, lambda t: t["text"]), ""))
