"""Quality classifier: regularised quadratic discriminant over statistics of a text.

Every text becomes a short vector of transformed statistics (lengths, kinds of characters,
repetition). Each class has a mean and a covariance, shrunk towards the pooled covariance and
towards a multiple of the identity; the score is the logistic of the difference of the two
log densities, from Mahalanobis distances with the Cholesky factors kept in the model.

Training uses every labelled row it is given: tasks send class sums and sums of products, of a
fixed size, and only these totals reach the driver. Texts are read once; their vectors are staged.

Defined cases: a null text is empty; an empty text has a score like any other; repeated labels count
as repeated observations; null labels are left out; without rows of both classes every score is the
share of label 1 (0.5 without any label); null and repeated ids are carried as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import release_memos, ship, stage

# Weight of the pooled covariance, and of the identity.
POOLED, ROUND = 0.1, 0.02
# A text counts as if it had so many more words of the usual kind, so that short ones are not judged
# by the chance of a few words.
PRIOR_WORDS = 12

STATISTICS = [
    "length", "word_length", "upper", "digits", "symbols", "bars", "shouts", "stops", "wide",
    "same_next", "top_word", "distinct_words", "short_words", "lines", "distinct_lines", "longest_word",
]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"]] = True


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, all finite."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n_bytes = max(1, int(counts.sum()))
    words, lines = text.split(), text.split("\n")
    n, n_lines = len(words) + PRIOR_WORDS, len(lines)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    tops = Counter(words).most_common(1)
    rate = lambda x: math.log1p(50.0 * x / n)
    mean = lambda x, usual: (x + PRIOR_WORDS * usual) / n
    return [
        math.log(len(text) + 200.0),
        math.log(mean(sum(map(len, words)), 6.0)),
        math.sqrt((upper + PRIOR_WORDS * 0.2) / (upper + lower + PRIOR_WORDS * 6.0)),
        rate(int(counts[48:58].sum())),
        rate(int(counts[_SYMBOLS].sum())),
        rate(int(counts[124])),
        rate(int(counts[33])),
        math.sqrt(mean(int(counts[44] + counts[46]), 0.15)),
        math.sqrt(int(counts[128:].sum()) / (n_bytes + 100.0)),
        rate(sum(map(eq, words, words[1:]))),
        math.sqrt(tops[0][1] / n) if tops else 0.0,
        mean(len(set(words)), 0.7),
        mean(sum(1 for w in words if len(w) < 4), 0.35),
        rate(n_lines),
        (len(set(lines)) + 2) / (n_lines + 2),
        math.log(max(map(len, words), default=0) + 20.0),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (array<double>); no shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        release_memos()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                stats = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(stats, pa.list_(pa.float64()))], names=[id_col, "stats"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


class Discriminant:
    """Two Gaussians. ``totals[k]`` is (rows, sums, sums of products) of class k."""

    def __init__(self, totals: list[tuple[float, np.ndarray, np.ndarray]], pooled=POOLED, round_=ROUND):
        rows = [t[0] for t in totals]
        self.share = rows[1] / sum(rows) if sum(rows) else 0.5
        self.ready = min(rows) > 1
        if not self.ready:
            return
        means = [s / n for n, s, _ in totals]
        scatter = [q - n * np.outer(m, m) for (n, _, q), m in zip(totals, means)]
        common = sum(scatter) / sum(rows)
        size = len(means[0])
        # The scale of each statistic, so that the identity means the same for all of them.
        scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
        common = common / np.outer(scale, scale)
        self.scale, self.classes = scale, []
        for n, mean, own in zip(rows, means, scatter):
            own = own / n / np.outer(scale, scale)
            mixed = (1 - pooled) * own + pooled * common
            mixed = (1 - round_) * mixed + round_ * np.trace(mixed) / size * np.eye(size)
            factor = np.linalg.cholesky(mixed)
            constant = math.log(n / sum(rows)) - float(np.log(np.diag(factor)).sum())
            self.classes.append((mean, factor, constant))

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, factor, constant in self.classes:
            z = np.linalg.solve(factor, ((x - mean) / self.scale).T)
            out.append(constant - 0.5 * (z * z).sum(axis=0))
        return np.stack(out, axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), self.share)
        logs = self.log_densities(x)
        return 1.0 / (1.0 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700.0, 700.0)))


def fit(labelled: DataFrame, label_col: str = "quality") -> Discriminant:
    """From rows with ``stats`` and a label of 0 or 1."""
    ship(labelled.sparkSession)
    size = len(STATISTICS)

    def run(batches):
        sums = {k: np.zeros(1 + size + size * size) for k in (0, 1)}
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            for k, total in sums.items():
                own = x[label == k]
                total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k, total in sums.items():
            columns = [[k] * len(total), list(range(len(total))), total]
            kinds = [pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "at", "total"]
            )

    picked = labelled.select("stats", F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    rows = (
        picked.mapInArrow(run, "k int, at int, total double").groupBy("k", "at").agg(F.sum("total")).collect()
    )
    totals = np.zeros((2, 1 + size + size * size))
    for k, at, total in rows:
        totals[k, at] = total
    return Discriminant([(t[0], t[1 : 1 + size], t[1 + size :].reshape(size, size)) for t in totals])


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` rows without their vectors, with ``score``."""
    ship(stats.sparkSession)
    keep = [c for c in stats.columns if c != "stats"]
    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(len(keep)).to_pylist(), float).reshape(-1, len(STATISTICS))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(model.scores(x), pa.float64())], names=[*keep, "score"]
            )

    return stats.select(*keep, "stats").mapInArrow(run, f"{schema}, score double")


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, whole and unshuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        release_memos()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                x = np.array([statistics(t) for t in part.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, buckets: int, bucket: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets == bucket, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every document; the model learns from
    the labels of the documents that are not held out."""
    stats = stage(with_statistics(docs, id_col, text_col), "statistics").withColumn(
        "held_out", held_out(id_col, 3, 1)
    )
    known = labels.select(F.col(id_col), F.col("quality"))
    model = fit(stats.filter(~F.col("held_out")).join(known, id_col), "quality")
    return score(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
