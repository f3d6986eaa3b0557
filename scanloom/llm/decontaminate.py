"""Benchmark decontamination: a broadcast hash set of test n-grams, and a scan of the corpus.

A window is ten consecutive words of an item, or the whole item where it has fewer. The windows'
hashes are broadcast with the items' words; every task cuts its texts into words, rolls the hash of
ten words over them, looks it up, and compares the words of each candidate with the item's. Nothing
is shuffled, so a hot source or a common passage costs no more than its own rows.

What is broadcast is bounded: items go in blocks of at most ``words.ITEM_BYTES`` bytes of text (or
one longer item), whose sizes are counted first. With more than one block the corpus is scanned once
for each, the hits of all blocks together.

Defined cases: null and empty texts have no words and no hits; items without words have no windows;
an item id is written as a string, null as the empty string, and rows with one id are one item;
repeated or null document ids are rows of their own; very long texts are scanned in parts that share
nine words; empty tables give no rows or no hits; other columns are carried only where named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import ship, stage
from scanloom.llm.words import HashIndex, equal_words, in_blocks, text_bytes, window_hashes, word_blocks, word_hashes

WINDOW = 10


class WindowSet:
    """Distinct windows of a block of items, by length and hash, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        first: dict[bytes, int] = {}
        self.word, lengths, hashes, holders = [], [], [], []
        blocks, before = [], 0
        texts = pa.array([text for _, text in items], pa.large_string())
        # One block for each text, whatever its length.
        for (name, _), k in zip(items, range(len(items))):
            for block in word_blocks(texts.slice(k, 1), segment=1 << 40):
                n = len(block.starts)
                if not n:
                    continue
                low, size = block.low.tobytes(), min(window, n)
                found = [low[s:e] for s, e in zip(block.starts.tolist(), block.ends.tolist())]
                rolled = next(h for _, h in window_hashes(word_hashes(block.low, block.starts, block.ends), [size]))
                for i in range(n - size + 1):
                    key = b" ".join(found[i : i + size])
                    at = first.setdefault(key, len(first))
                    if at == len(holders):
                        holders.append(set())
                        self.word.append(before + i)
                        lengths.append(size)
                        hashes.append(rolled[i])
                    holders[at].add(number[name])
                blocks.append(block)
                before += n
        bases = np.cumsum([0] + [len(b.low) for b in blocks])
        self.low = np.concatenate([b.low for b in blocks]) if blocks else np.zeros(0, np.uint8)
        joined = lambda part: np.concatenate([getattr(b, part) + base for b, base in zip(blocks, bases)] or [bases[:0]])
        self.starts, self.ends = joined("starts"), joined("ends")
        self.word = np.array(self.word, np.int64)
        self.held = np.array([i for h in holders for i in sorted(h)], np.int64)
        self.held_from = np.cumsum([0] + [len(h) for h in holders])
        lengths, hashes = np.array(lengths, np.int64), np.array(hashes, np.uint64)
        self.of_length = {}
        for length in sorted(set(lengths.tolist())):
            at = np.flatnonzero(lengths == length)
            self.of_length[length] = (at, HashIndex(hashes[at]))

    def hits(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and window of every occurrence in a block, confirmed word by word."""
        places, sizes, windows = [], [], []
        hashes = word_hashes(block.low, block.starts, block.ends)
        for length, rolled in window_hashes(hashes, list(self.of_length)):
            entries, index = self.of_length[length]
            place, found = index.find(rolled)
            whole = block.doc[place] == block.doc[place + length - 1]
            place, window = place[whole], entries[found[whole]]
            # Neighbouring windows share words; each pair of words is compared once.
            steps = np.arange(length)
            pairs = (place[:, None] + steps) * len(self.starts) + (self.word[window][:, None] + steps)
            pair, back = np.unique(pairs.ravel(), return_inverse=True)
            mine, theirs = np.divmod(pair, max(1, len(self.starts)))
            same = equal_words(
                block.low, block.starts[mine], block.ends[mine], self.low, self.starts[theirs], self.ends[theirs]
            )
            sure = same[back].reshape(pairs.shape).all(axis=1)
            places.append(place[sure])
            sizes.append(np.full(int(sure.sum()), length))
            windows.append(window[sure])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x or [none]) for x in (places, sizes, windows))

    def items_of(self, doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) pairs of occurrences."""
        pairs = np.unique(np.stack([doc, window], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        doc, window = pairs[:, 0], pairs[:, 1]
        counts = self.held_from[window + 1] - self.held_from[window]
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        item = self.held[np.repeat(self.held_from[window], counts) + inner]
        both = np.unique(np.repeat(doc, counts) * max(1, len(self.names)) + item)
        return np.divmod(both, max(1, len(self.names)))


def _spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _scan_texts(texts: pa.Array, windows: WindowSet, window: int):
    """Per text: its words, the spans of words that are hit, and the items found."""
    words = np.zeros(len(texts), np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for block in word_blocks(texts, overlap=window - 1):
        if not len(block.starts):
            continue
        known = words.copy()
        words += np.bincount(block.doc[block.repeated :], minlength=len(texts))
        place, size, found = windows.hits(block)
        if not len(place):
            continue
        marks = np.zeros(len(block.starts) + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + size, -1)
        hit = np.cumsum(marks[:-1]) > 0
        for doc in np.unique(block.doc[place]).tolist():
            low, high = np.searchsorted(block.doc, [doc, doc + 1])
            before = int(known[doc]) - (block.repeated if low == 0 else 0)
            spans[doc] += [(a + before, b + before) for a, b in _spans_of(hit[low:high])]
        for doc, item in zip(*(x.tolist() for x in windows.items_of(block.doc[place], found))):
            items[doc].add(windows.names[item])
    return words, spans, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> list[str | None]:
    """The texts without the bytes from the first to the last word of each span."""
    out = texts.to_pylist()
    raw, offsets = text_bytes(texts)
    for k, cuts in enumerate(spans):
        if not cuts:
            continue
        body, starts, ends = raw[offsets[k] : offsets[k + 1]].tobytes(), [], []
        for block in word_blocks(texts.slice(k, 1)):
            base = block.offset - int(offsets[k])
            starts.append(block.starts + base)
            ends.append(block.ends + base)
        starts, ends, done, kept = np.concatenate(starts), np.concatenate(ends), 0, []
        for a, b in cuts:
            kept.append(body[done : starts[a]])
            done = int(ends[b - 1])
        out[k] = b"".join([*kept, body[done:]]).decode("utf-8")
    return out


def _scan(
    docs: DataFrame, items: DataFrame, carry: list[str], text_col: str, item_id_col: str, item_text_col: str,
    window: int, cut: bool,
) -> DataFrame:
    """The carried columns, then the scan's: ``_text`` (cut, where asked for), ``_words``, ``_spans``, ``_items``."""
    spark = docs.sparkSession
    ship(spark)
    named = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
    ).distinct()
    blocks = in_blocks(named, "text", ["item", "text"])
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(
        *(F.col(c).alias(n) for c, n in zip(carry, names)),
        F.col(text_col).alias("_text"),
        F.lit(0).cast("long").alias("_words"),
        F.array().cast("array<array<long>>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    schema, several, width = rows.schema, len(blocks) > 1, len(carry)
    for number, block in enumerate(blocks):
        final = number == len(blocks) - 1
        # Bounded by the block's size, which in_blocks has counted.
        windows = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in block.collect()], window))

        def run(batches, windows=windows, final=final):
            for batch in batches:
                texts = batch.column(width)
                words, spans, found = _scan_texts(texts, windows.value, window)
                past = batch.column(width + 2).to_pylist() if several else [[]] * len(texts)
                spans = [_joined([*map(tuple, a), *b]) for a, b in zip(past, spans)]
                past = batch.column(width + 3).to_pylist() if several else [[]] * len(texts)
                found = [sorted({*a, *b}) for a, b in zip(past, found)]
                if final:
                    texts = pa.array(_without(texts, spans) if cut else [None] * len(texts), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in range(width)),
                        texts,
                        pa.array(words, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )

        rows = rows.mapInArrow(run, schema)
        if not final:
            rows = stage(rows, "windows")
    return rows


def find_overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_hit`` (words inside occurrences of windows), ``items`` (sorted ids of
    the items with windows that occur) and ``spans`` (first word and word after the last of each run that is hit)."""
    rows = _scan(docs, items, [id_col], text_col, item_id_col, item_text_col, window, cut=False)
    sizes = F.transform("_spans", lambda s: s[1] - s[0])
    return rows.select(
        F.col("_c0").alias(id_col),
        F.col("_words").alias("n_words"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hit"),
        F.col("_items").alias("items"),
        F.transform("_spans", lambda s: F.struct(s[0].alias("first"), s[1].alias("after"))).alias("spans"),
    )


def remove_spans(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The documents with all their columns, the hit passages cut out of their texts; other texts as they are."""
    rows = _scan(docs, items, docs.columns, text_col, item_id_col, item_text_col, window, cut=True)
    return rows.select(
        *(F.col("_text" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(docs.columns))
    )


def remove_documents(
    docs: DataFrame, items: DataFrame, share: float = 0.0, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The documents, with all their columns, of whose words no more than ``share`` are hit."""
    rows = _scan(docs, items, docs.columns, text_col, item_id_col, item_text_col, window, cut=False)
    sizes = F.transform("_spans", lambda s: s[1] - s[0])
    hit = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    kept = rows.filter(hit <= F.col("_words") * F.lit(share))
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
