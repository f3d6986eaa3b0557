"""Ranked lexical search: exact top documents of every item by a dual-tree search.

A first pass cuts the texts into terms and stages, per document, its length and how often it holds
each of the items' terms. From these come the counts of the whole corpus and so each term's weight
and each occurrence's share of a score. Then every task takes its staged documents in runs of
``RUN_DOCS`` and builds a hierarchy over them: sorted by their heaviest terms, so that documents
sharing rare terms are neighbours, then ``LEAF_DOCS`` to a leaf and ``FAN`` nodes to a parent, each
node with the maximum of its documents' shares in every term. The items have such a hierarchy of
their own, with the maxima of their term weights. Both trees are walked together: the product of two
nodes' maxima bounds every score between them, and where it is below the weakest kth score of the
items in the node, the whole batch of pairs is left out; such a pair can change no item's answer. Only
leaves that meet are scored. Nodes with high bounds come first, and scores found stay with the task's
later runs. A task gives at most k rows an item (and what ties with the kth); Spark ranks those of all tasks.

Items go in blocks of at most ``ITEM_BYTES`` bytes of text, or one longer item, with sizes
counted first; each block is a search of its own. What is broadcast is a block's terms and weights.

Defined cases: null and empty texts have no terms and are not counted; an item without terms, or whose
terms no document holds, has no rows; rows with one item id are one item whose texts are read in order
(repeated rows count once), a null id among them; repeated document ids are documents of their own,
and a null document id ranks before the others at equal scores; very long texts are cut in parts; empty
tables give no rows; other columns are not carried. Integers have 64 bits: ``25 * n * N`` must fit.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scanloom.llm.common import ship, stage
from scanloom.llm.words import HashIndex, equal_words, in_blocks, word_blocks, word_hashes

# Bytes of item texts that are searched for at once; their terms make the nodes' width.
ITEM_BYTES = 1 << 20
RUN_DOCS = 4096
# Cells of the leaves' maxima that a run of documents may take; wider items make shorter runs.
NODE_CELLS = 1 << 21
LEAF_DOCS = 32
LEAF_ITEMS = 8
FAN = 4
_COLUMNS = ("_id", "_n", "_terms", "_times")


class Terms:
    """The distinct terms of a block of items, and each item's terms with their repeats."""

    def __init__(self, items: list[tuple]):
        self.item_ids, number = [], {}
        words, owners = [], []
        for item, text in items:
            if item not in number:
                number[item] = len(number)
                self.item_ids.append(item)
            for block in word_blocks(pa.array([text], pa.large_string())):
                low = block.low.tobytes()
                found = [low[s:e] for s, e in zip(block.starts.tolist(), block.ends.tolist())]
                words += found
                owners += [number[item]] * len(found)
        self.terms = sorted(set(words))
        place = {t: i for i, t in enumerate(self.terms)}
        sizes = np.array([len(t) for t in self.terms], np.int64)
        self.low = np.frombuffer(b"".join(self.terms), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.index = HashIndex(word_hashes(self.low, self.starts, self.ends))
        pairs, times = np.unique(
            np.array([o * max(1, len(place)) + place[w] for o, w in zip(owners, words)], np.int64), return_counts=True
        )
        self.pair_item, self.pair_term = np.divmod(pairs, max(1, len(place)))
        self.pair_times = times

    def counted(self, texts: pa.Array):
        """Per text: its number of words; and (text, term, times) of the terms that are known."""
        n = np.zeros(len(texts), np.int64)
        found = []
        for block in word_blocks(texts):
            n += np.bincount(block.doc, minlength=len(texts))
            place, term = self.index.find(word_hashes(block.low, block.starts, block.ends))
            same = equal_words(
                block.low, block.starts[place], block.ends[place], self.low, self.starts[term], self.ends[term]
            )
            found.append(block.doc[place[same]] * max(1, len(self.terms)) + term[same])
        pairs, times = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        doc, term = np.divmod(pairs, max(1, len(self.terms)))
        return n, doc, term, times


def count_terms(docs: DataFrame, terms, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its number of terms, and the known ones among them with how often they occur."""

    def run(batches):
        for batch in batches:
            n, doc, term, times = terms.value.counted(batch.column(1))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((term, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=list(_COLUMNS))

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(id_col, text_col)
    return read.mapInArrow(run, f"_id {kind}, _n long, _terms array<int>, _times array<long>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def shares(times: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one unit of weight gives for a term that occurs ``times`` in a document of ``n`` terms."""
    m = 100 - 25 + (25 * n * documents) // max(1, terms)
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def neighbours(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """An order of rows in which those that share their highest coordinates lie together."""
    order = np.lexsort((cols, -values, rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keys = []
    for k in (2, 1, 0):
        key = np.full(count, -1, np.int64)
        key[rows[rank == k]] = cols[rank == k]
        keys.append(key)
    return np.lexsort(keys)


def tree_spans(count: int, leaf: int) -> tuple[list[tuple[int, int]], list[range]]:
    """Rows and children of the nodes of a hierarchy over ``count`` rows: leaves first, the root last."""
    spans = [(i, min(i + leaf, count)) for i in range(0, count, leaf)]
    children = [range(0)] * len(spans)
    low, high = 0, len(spans)
    while high - low > 1:
        for i in range(low, high, FAN):
            inner = range(i, min(i + FAN, high))
            children.append(inner)
            spans.append((spans[i][0], spans[inner[-1]][1]))
        low, high = high, len(spans)
    return spans, children


class DocumentTree:
    """A hierarchy over a run of documents; ``maxima`` has a row of all terms for every node."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, given: np.ndarray, ids: list, width: int):
        order = np.argsort(rows, kind="stable")
        self.rows, self.cols, self.given, self.ids = rows[order], cols[order], given[order], ids
        self.spans, self.children = tree_spans(len(ids), LEAF_DOCS)
        self.maxima = np.zeros((len(self.spans), width), np.int64)
        np.maximum.at(self.maxima, (self.rows // LEAF_DOCS, self.cols), self.given)
        for node, inner in enumerate(self.children):
            if inner:
                self.maxima[node] = self.maxima[inner.start : inner.stop].max(axis=0)

    def given_in(self, leaf: int, terms: np.ndarray) -> np.ndarray:
        """The shares of a leaf's documents in some terms."""
        first, last = self.spans[leaf]
        at = slice(*np.searchsorted(self.rows, [first, last]))
        place = np.minimum(np.searchsorted(terms, self.cols[at]), len(terms) - 1)
        known = terms[place] == self.cols[at]
        out = np.zeros((last - first, len(terms)), np.int64)
        out[self.rows[at][known] - first, place[known]] = self.given[at][known]
        return out


class Searcher:
    """The hierarchy over the items, each item's best k scores so far, and the walk over both trees.
    An item node knows the terms of its items and the largest weight in each."""

    def __init__(self, terms: Terms, weights: np.ndarray, k: int):
        count = len(terms.item_ids)
        values = terms.pair_times * weights[terms.pair_term]
        order = neighbours(terms.pair_item, terms.pair_term, values, count)
        self.names = [terms.item_ids[i] for i in order.tolist()]
        place = np.argsort(order)[terms.pair_item]
        self.spans, self.children = tree_spans(count, LEAF_ITEMS)
        self.used, self.largest, self.weights = [], [], []
        for (a, b), inner in zip(self.spans, self.children):
            mine = (a <= place) & (place < b)
            used, at = np.unique(terms.pair_term[mine], return_inverse=True)
            largest = np.zeros(len(used), np.int64)
            np.maximum.at(largest, at, values[mine])
            own = np.zeros((0 if inner else b - a, len(used)), np.int64)
            if not inner:
                own[place[mine] - a, at] = values[mine]
            self.used.append(used)
            self.largest.append(largest)
            self.weights.append(own)
        self.k, self.best = k, [[] for _ in range(count)]
        self.weakest = np.ones(count, np.int64)

    def limit(self, node: int) -> int:
        """The weakest kth score of a node's items; 1 while one of them has fewer than k."""
        a, b = self.spans[node]
        return int(self.weakest[a:b].min())

    def bounds(self, node: int, maxima: np.ndarray) -> np.ndarray:
        return maxima[:, self.used[node]] @ self.largest[node]

    def search(self, docs: DocumentTree):
        if not self.spans or not docs.spans:
            return
        items, root = len(self.spans) - 1, len(docs.spans) - 1
        queue = [(-int(self.bounds(items, docs.maxima[root:])[0]), items, root)]
        while queue:
            bound, q, d = heapq.heappop(queue)
            if -bound < self.limit(q):
                continue
            if not self.children[q] and not docs.children[d]:
                self.score(q, docs, d)
                continue
            nodes = docs.children[d] or range(d, d + 1)
            for child in self.children[q] or [q]:
                bounds = self.bounds(child, docs.maxima[nodes.start : nodes.stop])
                for at in np.flatnonzero(bounds >= self.limit(child)).tolist():
                    heapq.heappush(queue, (-int(bounds[at]), child, nodes[at]))

    def score(self, q: int, docs: DocumentTree, d: int):
        (first, last), begin = self.spans[q], docs.spans[d][0]
        if not len(self.used[q]):
            return
        scores = docs.given_in(d, self.used[q]) @ self.weights[q].T
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.weakest[first:last]))):
            heap = self.best[first + item]
            entry = (int(scores[doc, item]), _Last(docs.ids[begin + doc]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.weakest[first + item] = heap[0][0]

    def found(self) -> tuple[list, list, list]:
        rows = [(name, key.id, score) for name, heap in zip(self.names, self.best) for score, key in heap]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [])


class _Last:
    """Orders ids so that the smallest, or null, is the best."""

    __slots__ = ("id",)

    def __init__(self, key):
        self.id = key

    def __lt__(self, other):
        if self.id is None or other.id is None:
            return self.id is not None and other.id is None
        return self.id > other.id

    def __eq__(self, other):
        return self.id == other.id


def search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The best k documents of each item of one block, from every task: ``_name``, ``_id``, ``_score``."""
    spark = docs.sparkSession
    # Bounded by the block's size, which in_blocks has counted.
    terms = Terms(sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is not None, *r)))
    width, shared = len(terms.terms), spark.sparkContext.broadcast(terms)
    counted = stage(count_terms(docs, shared, id_col, text_col).filter("_n > 0"), "terms")
    documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    # One row for each term of the block.
    held = dict(map(tuple, counted.select(F.explode("_terms").alias("_term")).groupBy("_term").count().collect()))
    weights = np.array([term_weight(documents, held.get(i, 0)) for i in range(width)], np.int64)
    weights = spark.sparkContext.broadcast(weights)
    run_docs = max(LEAF_DOCS, min(RUN_DOCS, NODE_CELLS // max(1, width) * LEAF_DOCS))
    kinds = [to_arrow_type(items.schema[0].dataType), to_arrow_type(docs.schema[id_col].dataType), pa.int64()]

    def run(batches):
        searcher = Searcher(shared.value, weights.value, k)
        for batch in batches:
            for begin in range(0, len(batch), run_docs):
                part = batch.slice(begin, run_docs)
                offsets = part.column("_terms").offsets.to_numpy()
                inside = slice(offsets[0], offsets[-1])
                rows = np.repeat(np.arange(len(part)), np.diff(offsets))
                cols = part.column("_terms").values.to_numpy()[inside].astype(np.int64)
                times = part.column("_times").values.to_numpy()[inside]
                given = shares(times, part.column("_n").to_numpy()[rows], documents, length)
                order = neighbours(rows, cols, given * weights.value[cols], len(part))
                ids = part.column("_id").take(pa.array(order)).to_pylist()
                searcher.search(DocumentTree(np.argsort(order)[rows], cols, given, ids, width))
        columns = [pa.array(v, kind) for v, kind in zip(searcher.found(), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["_name", "_id", "_score"])

    name, kind = items.schema[0].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    touched = counted.filter(F.size("_terms") > 0)
    return touched.mapInArrow(run, f"_name {name}, _id {kind}, _score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per item its ``k`` documents of highest score above 0, ties to the smaller document id: the item's id,
    ``rank`` from 1, the document's id, ``score``."""
    ship(docs.sparkSession)
    named = items.select(F.col(item_id_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    found = None
    for block in in_blocks(named.distinct(), "text", ["item"], ITEM_BYTES):
        part = search_block(docs, block, k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    # A task's k rows an item are all that is shuffled, and Spark limits each partition's before that.
    rank = F.row_number().over(Window.partitionBy("_name").orderBy(F.desc("_score"), F.asc_nulls_first("_id")))
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select(F.col("_name").alias(item_id_col), "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"))
    )
