"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

LONG = " ".join(f"w{i % 977} lorem{i % 13}" for i in range(20_000)) + "\n" + "x" * 70_000

ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again.\nA second line of text.", "en", "s", 10),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \t\n \x0b ", "en", None, 5),
    (5, LONG, "en", "s", len(LONG)),
    (6, "The quick brown fox jumps over the lazy dog again.\nA second line of text.", "en", "s", 10),
    (6, "The quick brown fox jumps over the lazy dog again.\nA second line of text.", "en", "s", 10),
    (7, "Éàü ß ΑΣ İ <|endoftext|> \U0001f600 1234 !!", None, "s", None),
    (None, "The quick brown fox jumps over the lazy dog again.", "en", "s", 1),
    (None, None, None, None, None),
    (8, "one", "de", "t", 3),
    (8, "two words", "de", "t", 9),
    (9, "der die das und\n\nder die das und\r\n", "de", "t", 31),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, extra: bool = False):
    docs = spark.createDataFrame(ODD_ROWS, SCHEMA)
    if extra:
        names = ["ids", "start", "length", "rank", "bucket", "digest", "doc", "line", "key", "token", "family",
                 "n_lines", "kept", "score", "held_out", "stats", "units", "component_id", "part"]
        from pyspark.sql import functions as F

        docs = docs.select("*", *(F.lit("other").alias(n) for n in names))
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(seed: int = 1, groups: int = 12, size: int = 9, words: int = 60) -> list[tuple[int, str]]:
    """Texts in groups around an original, from light to heavy edits, with exact copies and short ones."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "kmtslr" for b in ("an", "en", "ion", "Um", "é")] + ["the", "of", "and"]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) + str(r.randint(0, 400)) for _ in range(words)]
        for k in range(size):
            own = list(base)
            for _ in range(k // 2):
                own[r.randrange(words)] = f"edit{r.randint(0, 10**6)}"
            texts.append(" ".join(own) if k % 4 else "\n".join(own))
    texts += ["", "  ", "a", "A", "a b", "a b c", "b c", "a b"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]
