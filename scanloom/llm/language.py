"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a public vocabulary. Each language has a probability for every piece; the
probability of a word is the sum, by the forward algorithm, over all ways to cut it into pieces,
and that of a text the product over its words (runs of letters, lower-cased). Probabilities come
from expected piece counts: every training word is spread over its segmentations, all pieces being
equally likely a priori (one round of expectation maximisation from the uniform start).

Tasks keep word scores in a table of bounded size and send piece counts per language, bounded by
the vocabulary; only these totals reach the driver.

Defined cases: ``und`` with score 0 for texts that are null or have no letter, and for all texts if
nothing was learned; null languages are not learned; ties go to the first language in order; letters
that no piece holds count as an unknown piece; long words are cut at ``WORD_CHARS`` letters; null and
repeated ids are carried as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import release_memos, ship
from scanloom.llm.quality import held_out
from scanloom.llm.tokens import batches_of

# About so many documents of each language are learned from, picked by a hash of their id and text,
# so that rows without an id, or with one id, are drawn one by one; equal rows share a draw.
LEARNED_DOCS = 5_000
SMOOTHING = 0.1
WORD_CHARS = 40
MEMO_WORDS = 400_000
BATCH_CHARS = 1 << 21
BEGIN = "▁"
UNDETERMINED = "und"

_WORDS = regex.compile(r"\p{L}{1,%d}" % WORD_CHARS)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, lower case, of any length; the last number is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(BEGIN)
        if piece == piece.lower() and (body == "" or body.isalpha()):
            pieces.setdefault(piece, len(pieces))
    pieces.setdefault(BEGIN, len(pieces))
    return pieces


def lattice(words: list[str], pieces: dict[str, int]) -> np.ndarray:
    """[word, start, length] -> piece, or -1. Words are marked at their begin and of equal length."""
    n, unknown = len(words[0]), len(pieces)
    longest = min(n, max(map(len, pieces), default=1))
    out = np.full((len(words), n, longest), -1, np.int32)
    get = pieces.get
    for w, word in enumerate(words):
        row = out[w]
        for i in range(n):
            row[i, 0] = get(word[i], unknown)
            for size in range(2, min(longest, n - i) + 1):
                piece = get(word[i : i + size])
                if piece is not None:
                    row[i, size - 1] = piece
    return out


def forward(cuts: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """[word, position, language]: probability of the letters before a position, over all cuts.

    ``chances`` has one row per piece, one for the unknown piece and a last one of zeros.
    """
    words, n, longest = cuts.shape
    alpha = np.zeros((words, n + 1, chances.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, n + 1):
        for size in range(1, min(longest, end) + 1):
            alpha[:, end] += alpha[:, end - size] * chances[cuts[:, end - size, size - 1]]
    return alpha


def expected_counts(words: list[str], pieces: dict[str, int]):
    """(word, piece, expected times) under equally likely pieces, for words of equal length."""
    cuts = lattice(words, pieces)
    chances = np.full((len(pieces) + 2, 1), 1.0 / (len(pieces) + 1))
    chances[-1] = 0.0
    ahead = forward(cuts, chances)[:, :, 0]
    count, n, longest = cuts.shape
    behind = np.zeros((count, n + 1))
    behind[:, n] = 1.0
    flat = chances[:, 0]
    for start in range(n - 1, -1, -1):
        for size in range(1, min(longest, n - start) + 1):
            behind[:, start] += flat[cuts[:, start, size - 1]] * behind[:, start + size]
    w, start, size = np.nonzero(cuts >= 0)
    piece = cuts[w, start, size]
    share = ahead[w, start] * flat[piece] * behind[w, start + size + 1] / ahead[w, n]
    return w, piece, share


def by_length(words) -> list[list[str]]:
    groups = defaultdict(list)
    for word in words:
        groups[len(word)].append(word)
    return [group[i : i + 4096] for group in groups.values() for i in range(0, len(group), 4096)]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def piece_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    learned: int = LEARNED_DOCS,
) -> list:
    """(language, piece, expected count) over the rows that are learned from."""
    ship(docs.sparkSession)

    def run(batches):
        release_memos()
        pieces = vocabulary(path)
        totals = defaultdict(lambda: np.zeros(len(pieces) + 1))
        for batch in batches:
            langs, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in batches_of(all_texts, BATCH_CHARS):
                seen = defaultdict(Counter)
                for lang, text in zip(langs[first:], texts):
                    seen[lang].update(words_of(text))
                names = sorted(seen)
                for group in by_length(set().union(*seen.values())):
                    w, piece, share = expected_counts([BEGIN + word for word in group], pieces)
                    for lang in names:
                        times = np.fromiter(map(seen[lang].__getitem__, group), float, len(group))
                        totals[lang] += np.bincount(piece, share * times[w], len(pieces) + 1)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())],
                names=["lang", "piece", "times"],
            )

    picked = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # One count per language gives each its rate.
    counts = {str(lang): n for lang, n in picked.groupBy(lang_col).count().collect()}
    rates = {lang: min(1.0, learned / n) for lang, n in counts.items()}
    if any(rate < 1.0 for rate in rates.values()):
        rate = F.create_map(*(F.lit(x) for item in rates.items() for x in item))
        drawn = F.pmod(F.xxhash64(F.lit("learn"), id_col, text_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
        picked = picked.filter(drawn < rate[F.col(lang_col).cast("string")])
    rows = picked.select(F.col(lang_col).cast("string"), text_col).mapInArrow(
        run, "lang string, piece int, times double"
    )
    return rows.groupBy("lang", "piece").agg(F.sum("times").alias("times")).collect()


class Languages:
    """Names in order, and the table of piece probabilities with a last row of zeros."""

    def __init__(self, counts, n_pieces: int, smoothing: float = SMOOTHING):
        self.names = sorted({lang for lang, _, _ in counts})
        table = np.full((n_pieces + 1, len(self.names)), smoothing)
        at = {lang: k for k, lang in enumerate(self.names)}
        for lang, piece, times in counts:
            table[piece, at[lang]] += times
        self.chances = np.vstack([table / table.sum(axis=0), np.zeros((1, len(self.names)))])


class Scorer:
    """Scores texts; ``rows`` remembers the place of each recent word in ``logs``."""

    def __init__(self, model: Languages, path: str):
        self.model, self.pieces = model, vocabulary(path)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.names)))

    def _add(self, words) -> None:
        parts = [self.logs]
        for group in by_length(words):
            ends = forward(lattice([BEGIN + w for w in group], self.pieces), self.model.chances)[:, -1]
            for word in group:
                self.rows[word] = len(self.rows)
            parts.append(np.log(np.maximum(ends, 1e-300)))
        self.logs = np.vstack(parts)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        found = [words_of(text) for text in texts]
        every = set(chain.from_iterable(found))
        fresh = every - self.rows.keys()
        if len(self.rows) + len(fresh) > MEMO_WORDS:
            self.rows, self.logs, fresh = {}, self.logs[:0], every
        if fresh:
            self._add(fresh)
        out = []
        for words in found:
            if not words or not self.model.names:
                out.append((UNDETERMINED, 0.0))
                continue
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            logs = self.logs[at].sum(axis=0)
            weights = np.exp(logs - logs.max())
            best = int(weights.argmax())
            out.append((self.model.names[best], float(weights[best] / weights.sum())))
        return out


def predict(docs: DataFrame, model: Languages, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every document; no shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        release_memos()
        scorer = Scorer(model, path)
        for batch in batches:
            for first, texts in batches_of(batch.column(1).to_pylist(), BATCH_CHARS):
                said = scorer.predict(texts)
                columns = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(said)), *columns],
                    names=[id_col, "lang_pred", "score"],
                )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double"
    )


def keep_identified(
    docs: DataFrame, model: Languages, path: str, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` with a language of a score of at least ``least``, whole and unshuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        release_memos()
        scorer = Scorer(model, path)
        for batch in batches:
            for first, texts in batches_of(batch.column(at).to_pylist(), BATCH_CHARS):
                said = [lang != UNDETERMINED and score >= least for lang, score in scorer.predict(texts)]
                yield batch.slice(first, len(said)).filter(pa.array(said, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    return Languages(piece_counts(docs, path, id_col, lang_col, text_col), len(vocabulary(path)))


def identify(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score``; learns from the rows not held out."""
    away = held_out(id_col, 4, 2)
    model = learn(docs.filter(~away), path, id_col, text_col, lang_col)
    return predict(docs, model, path, id_col, text_col).withColumn("held_out", away)
