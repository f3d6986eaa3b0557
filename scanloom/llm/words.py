"""Words of whole texts as arrays: where they lie, 64-bit hashes, and lookups in a bounded set of words.

A word is a maximal run of ASCII letters and digits and of everything beyond ASCII; A-Z are lowered.
In UTF-8 that is a rule on single bytes, so a column of texts is cut into words as one byte array.
Hashes only find candidates: whoever uses them compares the bytes with ``equal_words``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Bytes that are handled at once; the arrays beside them take about forty bytes a byte.
SEGMENT_BYTES = 1 << 20
# Bytes of item texts that go to all executors at once.
ITEM_BYTES = 8 << 20

SEPARATOR = 32
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_U = np.uint64


def _byte_table() -> np.ndarray:
    table = np.full(256, SEPARATOR, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LOWERED = _byte_table()


@dataclass
class Block:
    """Words of a run of texts, or of a part of one long text."""

    low: np.ndarray  # lowered bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # number of each word's text in the column
    repeated: int  # leading words that the block before has too
    offset: int  # where ``low`` begins in the column's bytes


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offsets of its texts; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def find_words(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; no word goes over one of the ``bounds`` between texts."""
    inside = low != SEPARATOR
    joined = inside[1:] & inside[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    joined[inner - 1] = False
    edge = np.zeros(1, bool)
    return (
        np.flatnonzero(inside & ~np.concatenate([edge, joined])[: len(low)]),
        np.flatnonzero(inside & ~np.concatenate([joined, edge])[: len(low)]) + 1,
    )


def word_blocks(texts: pa.Array, overlap: int = 0, segment: int = SEGMENT_BYTES):
    """Blocks of whole texts of about ``segment`` bytes together. A longer text gives several, cut
    between words, each beginning with the last ``overlap`` words of the one before."""
    raw, offsets = text_bytes(texts)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + segment, "right")) - 1
        if last > first:
            begin = int(offsets[first])
            low = LOWERED[raw[begin : offsets[last]]]
            starts, ends = find_words(low, offsets[first : last + 1] - begin)
            doc = np.searchsorted(offsets[first + 1 : last + 1] - begin, starts, "right") + first
            yield Block(low, starts, ends, doc, 0, begin)
            first = last
            continue
        begin = done = int(offsets[first])
        stop, repeated = int(offsets[first + 1]), 0
        while done < stop:
            done = min(done + segment, stop)
            while done < stop and LOWERED[raw[done]] != SEPARATOR:
                ahead = np.flatnonzero(LOWERED[raw[done : min(done + segment, stop)]] == SEPARATOR)
                done = done + int(ahead[0]) if len(ahead) else min(done + segment, stop)
            low = LOWERED[raw[begin:done]]
            starts, ends = find_words(low, np.zeros(0, np.int64))
            yield Block(low, starts, ends, np.full(len(starts), first), repeated, begin)
            repeated = min(overlap, len(starts))
            begin = begin + int(starts[-repeated]) if repeated else done
        first += 1


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    base = 0x100000001B3
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        powers = np.ones(1 << bits, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(bits):
                powers[1 << k : 2 << k] = powers[: 1 << k] * _U(pow(factor, 1 << k, 1 << 64))
        out.append(powers)
    return out[0], out[1]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(max(20, int(len(low)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * powers[: len(low)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP
        h ^= h >> _U(31)
        h *= _MIX
        return h ^ (h >> _U(29))


def window_hashes(hashes: np.ndarray, lengths: list[int]):
    """(length, hash of the window of that many words at each place), for ascending ``lengths``."""
    total, factor, done = np.zeros(len(hashes), np.uint64), 1, 0
    for length in lengths:
        with np.errstate(over="ignore"):
            while done < min(length, len(hashes)):
                total[: len(hashes) - done] += hashes[done:] * _U(factor)
                factor = factor * int(_STEP) % (1 << 64)
                done += 1
        if length > len(hashes):
            return
        mixed = total[: len(hashes) - length + 1].copy()
        mixed ^= mixed >> _U(32)
        yield length, mixed


class HashIndex:
    """Entries by hash: a table of bytes turns most misses away, sorted hashes decide."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.bits = min(24, max(10, int(32 * len(hashes) + 1).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(hashes >> _U(64 - self.bits)).astype(np.int64)] = True
        runs = np.diff(np.flatnonzero(np.concatenate([[True], self.sorted[1:] != self.sorted[:-1], [True]])))
        self.most = int(runs.max()) if len(hashes) else 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and the entries of equal hash there."""
        at = np.flatnonzero(self.seen[(hashes >> _U(64 - self.bits)).astype(np.int64)])
        wanted = hashes[at]
        low = np.searchsorted(self.sorted, wanted)
        places, entries = [], []
        for k in range(self.most):
            here = np.minimum(low + k, len(self.sorted) - 1)
            same = (self.sorted[here] == wanted) & (low + k < len(self.sorted))
            places.append(at[same])
            entries.append(self.order[here[same]])
        none = np.zeros(0, np.int64)
        return np.concatenate(places or [none]), np.concatenate(entries or [none])


def equal_words(low, starts, ends, other, other_starts, other_ends) -> np.ndarray:
    """Which words of two lists are equal, byte by byte."""
    sizes = ends - starts
    same = sizes == other_ends - other_starts
    at = np.flatnonzero(same)
    if len(at):
        n = sizes[at]
        firsts = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(firsts, n)
        equal = low[np.repeat(starts[at], n) + inner] == other[np.repeat(other_starts[at], n) + inner]
        same[at] = np.logical_and.reduceat(equal, firsts)
    return same


def in_blocks(items: DataFrame, text_col: str, key_cols: list[str], limit: int = ITEM_BYTES) -> list[DataFrame]:
    """``items`` dealt into blocks by a hash of their key, none above ``limit`` bytes of text. A key that
    is larger by itself is a block of its own. Sizes are counted, and there are more blocks until they fit."""
    key = F.xxhash64(F.lit("block"), *key_cols)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16)
    sizes = items.groupBy(key.alias("_key")).agg(F.sum(size).alias("_size"))
    # Each of these has more than ``limit`` bytes, so there are fewer than the items' bytes by ``limit``.
    large = [r[0] for r in sizes.filter(F.col("_size") > limit).select("_key").collect()]
    small, number = sizes.filter(F.col("_size") <= limit), 1
    while True:
        blocks = small.groupBy(F.pmod("_key", F.lit(number)).alias("_block")).agg(F.sum("_size").alias("_size"))
        worst = blocks.agg(F.max("_size")).first()[0] or 0
        if worst <= limit:
            break
        number *= 2 if worst < 4 * limit else int(2 * worst // limit)
    if number == 1 and not large:
        return [items]
    rest = items.filter(~key.isin(large)) if large else items
    dealt = [rest.filter(F.pmod(key, F.lit(number)) == k) for k in range(number)]
    return dealt + [items.filter(key == k) for k in large]
