"""BPE encoding and decoding as streaming transducers, from a public tokenizer's JSON file.

**Encoder.** Text becomes pieces (added tokens, normalisation, pre-tokeniser pattern), a piece
becomes symbols, and the merges run over a window of symbols. A later symbol can change an earlier
token only through a chain of merges, each applied after the one before it and each sharing an
operand with it. ``sufficient_lookahead`` takes the longest such chain from the merge list; a token
that ends further back than that is stable and is emitted, so a word of any length needs a window
of fixed size. What short pieces encode to is kept in a memo of bounded size.

**Decoder.** ``IncrementalDecoder`` takes ids one by one and gives the text as soon as it is final:
with a byte-level decoder through an incremental UTF-8 machine, without one by joining tokens with
a space.

Defined cases: a null text is empty and has no ids; unknown symbols have no id and are left out, as
the tokenizer file says; ids outside the vocabulary decode to nothing; null and repeated ids of
documents are carried as they are; other columns are not carried; empty tables stay empty.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import remembers, ship

MEMO_PIECES = 500_000
MEMO_CHARS = 48
BLOCK_CHARS = 1 << 16
NO_RULE = 1 << 63


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else from 256 upwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = [], 256
    for byte in range(256):
        if byte in printable:
            table.append(chr(byte))
        else:
            table.append(chr(spare))
            spare += 1
    return table


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """How many symbols behind a token's end can still change it.

    ``merges`` in order of priority, ``length`` the symbols in each token. Whether a merge (a, b)
    happens shows to its left as ``a`` or ``ab``; only a later merge whose right operand is one of
    the two is affected, and so on leftwards. ``seen`` keeps the longest chain that ends in a token.
    """
    seen: dict[str, int] = {}
    longest = 1
    for left, right in merges:
        reach = length[left] + max(length[right], seen.get(right, 0))
        for token in (left, left + right):
            if reach > seen.get(token, 0):
                seen[token] = reach
        longest = max(longest, reach)
    return longest


class Encoder:
    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        cut = len(self.suffix)
        clean = lambda t: len(t) - cut if cut and t.endswith(self.suffix) else len(t)
        self.lookahead = sufficient_lookahead(pairs, {t: clean(t) for t in self.vocab})
        self.window = 2 * self.lookahead
        ids = self.vocab
        # Rank and product of a merge in one number, so that the smallest is the next merge.
        self.rules = {(ids[a], ids[b]): rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner = [ids.get(s) for s in symbols]
        self.final = [ids.get(s + self.suffix) for s in symbols]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._read_steps(spec)
        self.sizes = {i: clean(t) for t, i in ids.items()}
        self.memo = _Memo(self._encode_piece, memo_pieces)

    def _read_steps(self, spec: dict) -> None:
        steps = spec["normalizer"] or {"normalizers": []}
        self.normalisers = [s["type"] for s in steps.get("normalizers", [steps])]
        known = {"NFC", "Replace", "Lowercase"}
        split = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        if not set(self.normalisers) <= known or not split[0]["invert"]:
            raise ValueError("this tokenizer file uses steps that are not supported")
        # The library's \s is Unicode's White_Space.
        pattern = split[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(pattern)

    def normalise(self, text: str) -> str:
        """The file's steps, without the one that only rewrites white space: no piece holds any."""
        for step in self.normalisers:
            if step == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                # Character by character: a capital sigma becomes the plain small one everywhere.
                text = text.replace("Σ", "σ").lower()
        return text

    def _merge(self, symbols) -> list[int]:
        """All merges, best rank first and leftmost among equals."""
        rule = self.rules.get
        tokens = list(symbols)
        pending = [rule(pair, NO_RULE) for pair in zip(tokens, tokens[1:])]
        while pending:
            best = min(pending)
            if best == NO_RULE:
                break
            at = pending.index(best)
            product = best & 0xFFFFFFFF
            tokens[at : at + 2] = [product]
            del pending[at]
            if at:
                pending[at - 1] = rule((tokens[at - 1], product), NO_RULE)
            if at < len(pending):
                pending[at] = rule((product, tokens[at + 1]), NO_RULE)
        return tokens

    def stream(self, symbols):
        """Token ids of a stream of symbol ids, each emitted once no later symbol can change it."""
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) < self.window:
                continue
            done = 0
            for token in self._merge(held):
                size = self.sizes[token]
                if done + size > len(held) - self.lookahead:
                    break
                yield token
                done += size
            del held[:done]
        yield from self._merge(held)

    def _symbols(self, piece: str):
        raw = piece.encode("utf-8")
        known = chain(map(self.inner.__getitem__, raw[:-1]), (self.final[raw[-1]],))
        return (symbol for symbol in known if symbol is not None)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        if len(piece) * 4 < self.window:
            return tuple(self._merge(self._symbols(piece)))
        return tuple(self.stream(self._symbols(piece)))

    def _encode_block(self, block: str):
        if not any(name in block for name in self.added):
            pieces = self.pieces.findall(self.normalise(block))
            return chain.from_iterable(map(self.memo.get_ids, pieces))
        ids: list[int] = []
        at = 0
        for match in self.added_pattern.finditer(block):
            ids.extend(self._encode_block(block[at : match.start()]))
            ids.append(self.added[match.group()])
            at = match.end()
        return [*ids, *self._encode_block(block[at:])]

    def encode(self, text: str | None):
        """Ids of a text, as a lazy stream over blocks that end at a space. Neither a piece nor an
        added token holds a space, and normalisation does not reach across one."""
        text = text or ""
        at = 0
        while at < len(text):
            end = text.find(" ", at + BLOCK_CHARS)
            end = len(text) if end < 0 else end
            yield from self._encode_block(text[at:end])
            at = end


class _Memo(dict):
    """Ids of recent strings. Two generations of half the limit each: what is asked for again moves
    to the young one, what is not goes with the old one."""

    def __init__(self, make, limit: int):
        self.make, self.half, self.old = make, limit // 2, {}
        self.get_ids = self.__getitem__

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class IncrementalDecoder:
    """Ids in, final text out. ``push`` gives what an id makes final, ``finish`` what is left."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        if spec["decoder"] is not None and not self.byte_level:
            raise ValueError("this tokenizer file uses a decoder that is not supported")
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        self.spaced = _Spaced(self)
        self.begin()

    def begin(self) -> None:
        self.first = True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        if token in self.added:
            text = self.added[token]
        elif token in self.tokens:
            text = self.tokens[token]
        else:
            return ""
        if self.byte_level:
            # A token with a character outside the byte alphabet (an added one) is its own bytes.
            mapped = [self.bytes_of.get(c) for c in text]
            raw = text.encode("utf-8") if None in mapped else bytes(mapped)
            return self.machine.decode(raw)
        lead = "" if self.first else " "
        self.first = False
        return lead + text

    def finish(self) -> str:
        rest = self.machine.decode(b"", True) if self.byte_level else ""
        self.begin()
        return rest

    def decode(self, ids) -> str:
        self.begin()
        if not self.byte_level:
            return "".join(map(self.spaced.get_text, ids))[1:]
        text = "".join(map(self.push, ids))
        return text + self.finish()


class _Spaced(dict):
    """Each token as ``push`` gives it after the first one."""

    def __init__(self, machine: IncrementalDecoder):
        self.machine = machine
        self.get_text = self.__getitem__

    def __missing__(self, token: int) -> str:
        self.machine.first = False
        return self.setdefault(token, self.machine.push(token))


@remembers
@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> IncrementalDecoder:
    return IncrementalDecoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) for every row of ``docs``; no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        make = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ends, ids = [0], []
                for text in part.column(1).to_pylist():
                    ids.append(np.fromiter(make.encode(text), np.int32))
                    ends.append(ends[-1] + len(ids[-1]))
                flat = pa.array(np.concatenate(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids_col``; columns in ``keep`` (all by default)."""
    ship(tokens.sparkSession)
    keep = tokens.columns if keep is None else keep
    picked = tokens.select(*keep, F.col(ids_col).alias("_decode_ids"))

    def run(batches):
        machine = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(len(keep))
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = [machine.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                arrays = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{schema}, decoded string")
