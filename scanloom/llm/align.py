"""Cross-tokenizer alignment: which tokens of two tokenizers lie on the same bytes of a text.

Both tokenizers' tokens end at ascending byte offsets. Merging the two lists of ends gives all links:
between two neighbouring ends lies one token of each side, and no two stretches have the same two
tokens. Where both sides end together a group closes.

* **Merge path.** The merge is cut into pieces of ``PIECE`` steps. A binary search along each diagonal
  finds how many ends of A and of B come before that step, so every piece knows its own tokens, the
  bytes before it and the token behind it, and is merged alone. Two equal ends never part.
* **Counts.** Pieces count their id pairs, Spark sums them; a B id has at most as many pairs as A has
  ids. The counts go back to the pieces in broadcasts of at most ``PAIRS_PER_PASS`` pairs, by ranges of
  B ids whose sizes are counted first; every pass adds its share of the sums.
* **Groups.** A text of one piece writes its groups at once. Pieces of longer texts write what closes
  inside them, and their open first and last groups apart; rows of a text, sorted by piece, are
  stitched in one pass that holds a single open group.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by byte,
have no tokens; strings of special tokens are plain text; ids of documents may be null or repeat, each
row is a text of its own; very long texts are many pieces; empty tables give no rows; other columns
are not carried.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm.bpe import byte_symbols
from scanloom.llm.common import release_memos, remembers, ship, stage
from scanloom.llm.tokens import ID_TYPE, MEMO_CHARS, TextEncoder, batches_of

PIECE = 1 << 15
PAIRS_PER_PASS = 4_000_000
# Links whose id pairs a task counts at once, and distinct pairs that it holds.
LINKS_AT_ONCE = 2_000_000
PAIRS_HELD = 1_000_000
MEMO_CHUNKS = 400_000

_SIZE = ID_TYPE.itemsize
# No token has this id: it stands for a chunk that its tokens do not give back.
_LOST = np.uint32(0xFFFFFFFF)
_LOST_BYTES = _LOST.tobytes()
# An id pair as one number: the B id times this, plus the A id.
_PAIR = 1 << 32
_SPACE = "▁"


class ByteTokens(TextEncoder):
    """Side A: a byte-level tokenizer, special tokens taken as plain text."""

    def __init__(self, path: str):
        super().__init__(path, MEMO_CHUNKS)
        self.library.encode_special_tokens = True
        back = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in back for c in token)
            self.tokens[i] = bytes(back[c] for c in token) if known else token.encode()

    def _library_ids(self, text: str) -> bytes:
        ids = super()._library_ids(text)
        return ids if b"".join(map(self.tokens.__getitem__, array("I", ids))) == text.encode() else _LOST_BYTES

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        return self.encode_many([" " + text if text else "" for text in texts])


class PieceTokens:
    """Side B: sentence pieces. Where no piece goes over the start of a run of spaces or over a line
    end, texts are cut there and recent chunks are remembered."""

    _CHUNK = re.compile(r"\n| *[^ \n]+| +")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in plain)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _checked(self, text: str, ids: list[int]) -> bytes:
        same = b"".join(map(self.tokens.__getitem__, ids)) == text.encode()
        return array("I", ids).tobytes() if same else _LOST_BYTES

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of chunks to the young memo. The model puts a space in front of what it encodes:
        the chunk's own, or one that goes again with the line end put between. A line end behind keeps
        spaces at the end."""
        known = self.old.keys() & new
        self.young.update((c, self.old[c]) for c in known)
        new -= known
        spaced = [c for c in new if c[0] == " "]
        bare = [c for c in new if c[0] != " "]
        for chunk, ids in zip(spaced, self.model.encode([c[1:] + "\n" for c in spaced], num_threads=1)):
            self.young[chunk] = self._checked(chunk, ids[:-1])
        for chunk, ids in zip(bare, self.model.encode(["\n" + c for c in bare], num_threads=1)):
            self.young[chunk] = self._checked(chunk, ids[2:])

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self._checked(" " + t, self.model.encode(t, num_threads=1)) if t else b"" for t in texts]
        # Nothing here is cyclic; the collector would walk the whole memo again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            if len(self.young) >= MEMO_CHUNKS // 2:
                self.old, self.young = self.young, {}
            parts = [self._CHUNK.findall(" " + t) if t else [] for t in texts]
            new = set().union(*parts) - self.young.keys()
            long = [c for c in new if len(c) > MEMO_CHARS]
            self._learn(new)
            out = [b"".join(map(self.young.__getitem__, chunks)) for chunks in parts]
            for chunk in long:
                del self.young[chunk]
            return out
        finally:
            if collecting:
                gc.enable()


@remembers
@lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a), PieceTokens(path_b)


@lru_cache(maxsize=1)
def _tables(path_a: str, path_b: str):
    """Byte lengths of the tokens of both sides, and every id as it is written before a comma, or
    before the sign that ends a group's side."""
    a, b = tokenizers_of(path_a, path_b)
    sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
    written = [b"%d%c" % (i, sign) for n, signs in zip(map(len, sizes), (b",|", b",;")) for sign in signs for i in range(n)]
    return sizes[0], sizes[1], written


def diagonal(a: np.ndarray, b: np.ndarray, step: int) -> tuple[int, int]:
    """How many of the ends ``a`` and ``b`` the merge has taken after ``step`` steps; A goes first at
    equal ends, and a step that would part two equal ends takes both."""
    low, high = max(0, step - len(b)), min(step, len(a))
    while low < high:
        middle = (low + high) // 2
        if a[middle] <= b[step - 1 - middle]:
            low = middle + 1
        else:
            high = middle
    i, j = low, step - low
    if 0 < i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


PIECE_SCHEMA = (
    "_part int, _row long, _piece int, _pieces int, _a binary, _b binary, "
    "_a_at long, _b_at long, _a_next long, _b_next long"
)


def cut_texts(
    docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of the merges of all texts: ids of both sides, bytes before them, ids behind them."""
    ship(docs.sparkSession)

    def run(batches):
        a_side, b_side = tokenizers_of(path_a, path_b)
        a_sizes, b_sizes, _ = _tables(path_a, path_b)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in batches_of(batch.column(1).to_pylist()):
                at, columns = [], [[] for _ in range(9)]
                for k, (a, b) in enumerate(zip(a_side.encode_spaced(texts), b_side.encode_spaced(texts))):
                    a_ids, b_ids = np.frombuffer(a, ID_TYPE), np.frombuffer(b, ID_TYPE)
                    steps = len(a_ids) + len(b_ids)
                    if (a_ids == _LOST).any() or (b_ids == _LOST).any():
                        a, b, steps = b"", b"", 0
                    cuts = [(0, 0), (len(a) // _SIZE, len(b) // _SIZE)]
                    if steps > piece:
                        a_ends, b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
                        cuts[1:1] = [diagonal(a_ends, b_ends, d) for d in range(piece, steps, piece)]
                    for number, ((i, j), (i2, j2)) in enumerate(zip(cuts, cuts[1:])):
                        row_of = (
                            row + k, number, len(cuts) - 1, a[i * _SIZE : i2 * _SIZE], b[j * _SIZE : j2 * _SIZE],
                            int(a_ends[i - 1]) if i else 0, int(b_ends[j - 1]) if j else 0,
                            int(a_ids[i2]) if i2 * _SIZE < len(a) else -1,
                            int(b_ids[j2]) if j2 * _SIZE < len(b) else -1,
                        )
                        at.append(first + k)
                        for column, value in zip(columns, row_of):
                            column.append(value)
                row += len(texts)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([part] * len(at), pa.int32()),
                        *(pa.array(c, kind) for c, kind in zip(columns, kinds)),
                    ],
                    names=["_id", *(c.split()[0] for c in PIECE_SCHEMA.split(", "))],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), text_col).mapInArrow(run, f"_id {kind}, {PIECE_SCHEMA}")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(ID_TYPE) if len(flat) else np.zeros(0, ID_TYPE), (offsets - offsets[0]) // _SIZE


class Merged:
    """The merges of a batch of pieces, one behind the other on one line of bytes."""

    def __init__(self, batch: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray):
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.rows = len(batch)
        self.a, self.a_from = _ids(batch.column("_a"))
        self.b, self.b_from = _ids(batch.column("_b"))
        a_row = np.repeat(np.arange(self.rows), np.diff(self.a_from))
        b_row = np.repeat(np.arange(self.rows), np.diff(self.b_from))
        a_end, b_end = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        a_done, b_done = (np.concatenate([[0], x])[at] for x, at in ((a_end, self.a_from), (b_end, self.b_from)))
        a_at, b_at = number("_a_at"), number("_b_at")
        start = np.minimum(a_at, b_at)
        a_last, b_last = a_at + np.diff(a_done), b_at + np.diff(b_done)
        length = np.maximum(a_last, b_last) - start + 1
        base = np.cumsum(length) - length - start
        a_end = a_end + (base + a_at - a_done[:-1])[a_row]
        b_end = b_end + (base + b_at - b_done[:-1])[b_row]
        # The first end of the other side at or behind each end; behind the piece's own, its next token.
        b_of, a_of = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
        self.a_tied = np.append(b_end, -1)[b_of] == a_end
        self.b_tied = np.append(a_end, -1)[a_of] == b_end
        inside = b_of < self.b_from[1:][a_row]
        self.b_linked = np.where(inside, np.append(self.b, 0)[b_of], number("_b_next")[a_row]).astype(np.int64)
        inside = a_of < self.a_from[1:][b_row]
        self.a_linked = np.where(inside, np.append(self.a, 0)[a_of], number("_a_next")[b_row]).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs of the links that close at ends of A, and at ends of B alone (-1 at common ends)."""
        at_b = np.where(self.b_tied, -1, self.b.astype(np.int64) * _PAIR + self.a_linked)
        return self.b_linked * _PAIR + self.a, at_b

    def sums(self, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """Sums per piece of values at the ends of A and of B."""
        out = np.zeros(self.rows, np.int64)
        for values, begins in ((at_a, self.a_from), (at_b, self.b_from)):
            out += np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[begins])
        return out

    def written(self, a: slice, b: slice, n_a: int, n_b: int) -> np.ndarray:
        """Closed groups of a stretch as places in the table of written ids."""
        a_tied, b_tied = self.a_tied[a], self.b_tied[b]
        a_group, b_group = (np.cumsum(t) - t for t in (a_tied, b_tied))
        a_before, b_before = (np.append(0, np.flatnonzero(t) + 1) for t in (a_tied, b_tied))
        out = np.empty(len(a_tied) + len(b_tied), np.int64)
        out[np.arange(len(a_tied)) + b_before[a_group]] = self.a[a] + a_tied * n_a
        out[np.arange(len(b_tied)) + a_before[b_group + 1]] = self.b[b] + b_tied * n_b + 2 * n_a
        return out


def pair_counts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a_id``, ``b_id``, ``links`` (how many links hold the pair) and ``best`` (no other pair of that B id has more)."""

    def run(batches):
        a_sizes, b_sizes, _ = _tables(path_a, path_b)
        release_memos()
        waiting, size, held, counts = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows():
            b, a = np.divmod(held, _PAIR)
            names = ["a_id", "b_id", "links"]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts)], names)

        def counted():
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            if not len(held):
                return keys, n
            both, back = np.unique(np.concatenate([held, keys]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            total[back[: len(held)]] += counts
            total[back[len(held) :]] += n
            return both, total

        for batch in batches:
            at_a, at_b = Merged(batch, a_sizes, b_sizes).keys()
            waiting += [at_a, at_b[at_b >= 0]]
            size += len(at_a) + len(waiting[-1])
            if size >= LINKS_AT_ONCE:
                held, counts = counted()
                waiting, size = [], 0
                if len(held) >= PAIRS_HELD:
                    yield rows()
                    held = counts = np.zeros(0, np.int64)
        if waiting:
            held, counts = counted()
        yield rows()

    found = pieces.mapInArrow(run, "a_id int, b_id int, links long")
    summed = found.groupBy("b_id", "a_id").agg(F.sum("links").alias("links"))
    most = F.max("links").over(Window.partitionBy("b_id"))
    return summed.select("a_id", "b_id", "links", (F.col("links") == most).alias("best"))


def _ranges(pairs: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of B ids with at most ``limit`` pairs each, or a single id; the list of ids is as long
    as B's vocabulary at most."""
    sizes = sorted(map(tuple, pairs.groupBy("b_id").count().collect()))
    out, total = [], 0
    for b, n in sizes:
        if not out or total + n > limit:
            out.append((b, b))
            total = 0
        out[-1] = (out[-1][0], b)
        total += n
    return out or [(0, 0)]


RESULT_SCHEMA = (
    "_part int, _row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)


def _judged(pieces: DataFrame, pairs: DataFrame, ids: tuple[int, int], first: bool, keep_groups: bool, paths) -> DataFrame:
    """Numbers per piece with the counts of one range of B ids; the first range's rows also have what
    does not hang on counts, and the groups of texts of one piece."""
    inside = pairs.filter(F.col("b_id").between(*ids)).orderBy("b_id", "a_id").toArrow()
    keys = inside.column("b_id").to_numpy().astype(np.int64) * _PAIR + inside.column("a_id").to_numpy()
    # Bounded by PAIRS_PER_PASS, or by the size of A's vocabulary.
    table = pieces.sparkSession.sparkContext.broadcast(
        (keys, inside.column("links").to_numpy(), inside.column("best").to_numpy(zero_copy_only=False))
    )

    def run(batches):
        a_sizes, b_sizes, written = _tables(*paths)
        release_memos()
        n_a = len(a_sizes)
        known, links, best = table.value
        links, best = np.append(links, 0), np.append(best, False)
        for batch in batches:
            merged = Merged(batch, a_sizes, b_sizes)
            found = []
            for side in merged.keys():
                at = np.searchsorted(known, side)
                at[np.append(known, -2)[at] != side] = len(known)
                found.append(at)
            values = [np.zeros(merged.rows, np.int64)] * 4
            texts = [None] * merged.rows
            if first:
                tied = merged.sums(merged.a_tied, np.zeros(len(merged.b)))
                n = np.diff(merged.a_from), np.diff(merged.b_from)
                values = [*n, tied, n[0] + n[1] - tied]
                whole = np.flatnonzero(batch.column("_pieces").to_numpy() == 1)
                if len(whole) == merged.rows:
                    # All groups are closed, and each text's are together.
                    signs = merged.written(slice(None), slice(None), n_a, len(b_sizes))
                for k in whole.tolist():
                    a, b = slice(*merged.a_from[k : k + 2]), slice(*merged.b_from[k : k + 2])
                    if len(whole) == merged.rows:
                        codes = signs[a.start + b.start : a.stop + b.stop]
                    else:
                        codes = merged.written(a, b, n_a, len(b_sizes))
                    line = b"".join(map(written.__getitem__, codes.tolist()))[:-1]
                    texts[k] = line.decode() if keep_groups else hashlib.sha256(line).hexdigest() if line else ""
            sums = [merged.sums(best[found[0]], best[found[1]]), merged.sums(links[found[0]], links[found[1]])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_part"),
                    batch.column("_row"),
                    *(pa.array(v, pa.int64()) for v in [*values, *sums]),
                    pa.array(texts, pa.string()),
                ],
                names=["_id", *(c.split()[0] for c in RESULT_SCHEMA.split(", "))],
            )

    kind = pieces.schema["_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"_id {kind}, {RESULT_SCHEMA}")


FRAGMENT_SCHEMA = "_part int, _row long, _piece int, _closed boolean, _first string, _second string, _middle string, _third string, _fourth string"


def _fragments(pieces: DataFrame, paths) -> DataFrame:
    """Per piece the A and B ids up to its first common end, the groups closed between the first and
    the last, and the ids behind the last."""

    def run(batches):
        a_sizes, b_sizes, written = _tables(*paths)
        listed = lambda ids: "".join(f"{i}," for i in ids.tolist())
        for batch in batches:
            merged = Merged(batch, a_sizes, b_sizes)
            columns = [[] for _ in range(6)]
            for k in range(merged.rows):
                (a0, a1), (b0, b1) = merged.a_from[k : k + 2], merged.b_from[k : k + 2]
                a_ties, b_ties = (np.flatnonzero(t) for t in (merged.a_tied[a0:a1], merged.b_tied[b0:b1]))
                if not len(a_ties):
                    row = (False, listed(merged.a[a0:a1]), listed(merged.b[b0:b1]), "", "", "")
                else:
                    a, b = slice(a0 + a_ties[0] + 1, a0 + a_ties[-1] + 1), slice(b0 + b_ties[0] + 1, b0 + b_ties[-1] + 1)
                    codes = merged.written(a, b, len(a_sizes), len(b_sizes)).tolist()
                    middle = b"".join(map(written.__getitem__, codes)).decode()
                    heads = listed(merged.a[a0 : a.start]), listed(merged.b[b0 : b.start])
                    row = (True, *heads, middle, listed(merged.a[a.stop : a1]), listed(merged.b[b.stop : b1]))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.bool_(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("_part", "_row", "_piece")),
                    *(pa.array(c, kind) for c, kind in zip(columns, kinds)),
                ],
                names=[c.split()[0] for c in FRAGMENT_SCHEMA.split(", ")],
            )

    return pieces.mapInArrow(run, FRAGMENT_SCHEMA)


def _stitched(fragments: DataFrame, keep_groups: bool) -> DataFrame:
    """Groups of texts of several pieces. A task gets the pieces of a text in order, hashes what is
    closed and holds one open group."""

    def run(batches):
        key, digest, kept, a_open, b_open, begun = None, None, [], [], [], False

        def put(line: str):
            kept.append(line) if keep_groups else digest.update(line.encode())

        def row():
            out = "".join(kept) if keep_groups else digest.hexdigest()
            names = ["_part", "_row", "groups"]
            kinds = [pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, out), kinds)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["_part"], r["_row"]):
                    if key is not None:
                        yield row()
                    key, digest = (r["_part"], r["_row"]), hashlib.sha256()
                    kept, a_open, b_open, begun = [], [], [], False
                a_open.append(r["_first"])
                b_open.append(r["_second"])
                if r["_closed"]:
                    put(";" * begun + "".join(a_open)[:-1] + "|" + "".join(b_open)[:-1])
                    if r["_middle"]:
                        put(";" + r["_middle"][:-1])
                    a_open, b_open, begun = [r["_third"]], [r["_fourth"]], True
        if key is not None:
            yield row()

    dealt = fragments.repartition("_part", "_row").sortWithinPartitions("_part", "_row", "_piece")
    return dealt.mapInArrow(run, "_part int, _row long, groups string")


def align(
    docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, piece: int = PIECE,
    pairs_per_pass: int = PAIRS_PER_PASS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links of pairs that are their B
    id's most frequent), ``count_sum`` (over the links, how many links hold the same pair) and ``groups``: the groups
    written as ``a1,a2|b1;a3|b2``, or, unless they are to be kept, their SHA-256 ('' without tokens)."""
    paths = (path_a, path_b)
    pieces = stage(cut_texts(docs, path_a, path_b, piece, id_col, text_col), "pieces")
    pairs = stage(pair_counts(pieces, path_a, path_b), "pairs")
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    parts = [
        _judged(pieces, pairs, ids, number == 0, keep_groups, paths)
        for number, ids in enumerate(_ranges(pairs, pairs_per_pass))
    ]
    long_texts = _stitched(_fragments(pieces.filter("_pieces > 1"), paths), keep_groups)
    parts.append(
        long_texts.select(
            F.lit(None).cast(pieces.schema["_id"].dataType).alias("_id"),
            "_part",
            "_row",
            *(F.lit(0).cast("long").alias(n) for n in names[2:-1]),
            "groups",
        )
    )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("_part", "_row").agg(
        F.max("_id").alias(id_col), *(F.sum(n).alias(n) for n in names[2:-1]), F.max("groups").alias("groups")
    ).drop("_part", "_row")
