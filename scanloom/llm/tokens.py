"""Ids of whole texts as the tokenizers library gives them, through a bounded memo of chunks.

Texts of a corpus repeat their words, so most of the library's work can be remembered. A text is
cut at single spaces and line ends, places where no token and no added token of the two supported
kinds of tokenizer continues; each new chunk is encoded by the library. Texts with runs of white
space, where a byte-level tokenizer would look across the cut, go to the library as a whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from scanloom.llm.bpe import byte_symbols
from scanloom.llm.common import remembers

# Tasks are Spark's; threads of the library's own would only take turns with them.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

MEMO_CHUNKS = 800_000
MEMO_CHARS = 64
BATCH_CHARS = 1 << 21

_RUN = re.compile(r"\s\s")
# A comma or full stop that does not follow a letter or digit, or follows the letter whose lower
# case ends in a mark.
_LOOSE = re.compile(r"[,.](?<![^\W_İ][,.])")
ID_TYPE = np.dtype("<u4")


class TextEncoder:
    """``encode_many`` gives, for each text, its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        # White space is either dropped (words) or part of the tokens (byte level).
        self.spaced = steps[0]["type"] == "ByteLevel"
        normalizer = spec["normalizer"] or {}
        kinds = {s["type"] for s in normalizer.get("normalizers", [normalizer]) if s}
        self.lower = "Lowercase" in kinds
        self.marks = [t["content"][0] for t in spec["added_tokens"]]
        self.normalizer = self.library.normalizer
        self.symbols = dict(enumerate(byte_symbols()))
        self.space = self.symbols[32]
        self.tokenize = self.library.model.tokenize
        self.memo = _Memo(self._library_ids, memo_chunks)

    def _library_ids(self, text: str) -> bytes:
        word = text[1:] if self.spaced and text[:1] == " " else text
        if word.isalpha():
            # One piece for either pre-tokeniser: the library's model alone does the same in less time.
            if word.isascii():
                piece = (word.lower() if self.lower else word) if word is text else self.space + word
                return array("I", [t.id for t in self.tokenize(piece)]).tobytes()
            same = self.normalizer.normalize_str(text) if self.normalizer else text
            if same.removeprefix(" ").isalpha():
                piece = same.encode("utf-8").decode("latin-1").translate(self.symbols)
                return array("I", [t.id for t in self.tokenize(piece)]).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """The text's chunks, each of which the library encodes as it does inside the text."""
        if "\0" in text or self.spaced and _RUN.search(text):
            return None
        if self.lower and text.isascii() and not any(mark in text for mark in self.marks):
            text = text.lower()
        if not _LOOSE.search(text):
            # Behind a letter or digit and before white space, a comma is a piece of its own.
            text = text.replace(", ", "\0,\0 ").replace(". ", "\0.\0 ").replace(".\n", "\0.\0\n")
        if not self.spaced:
            return text.replace(" ", "\0").replace("\n", "\0").split("\0")
        # A line end is a chunk of its own; a space belongs to the chunk that it leads.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        parts = self._chunks(text)
        return self._library_ids(text) if parts is None else b"".join(map(self.memo.ids, parts))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        # Nothing here is cyclic; the collector would walk the whole memo again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return [self.encode(text) for text in texts]
        finally:
            if collecting:
                gc.enable()


class _Memo(dict):
    """Ids of recent chunks. Two generations of half the limit each: what is asked for again moves
    to the young one, what is not goes with the old one."""

    def __init__(self, make, limit: int):
        self.make, self.half, self.old = make, limit // 2, {}
        self.ids = self.__getitem__

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def batches_of(texts: list[str | None], limit: int = BATCH_CHARS):
    """Runs of texts of about ``limit`` characters together: (first, texts)."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= limit:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


@remembers
@lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
