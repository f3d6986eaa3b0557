"""Approximate nearest neighbours by inner product: stable projections, kd-tree, chi-square stop.

Inner products become distances: a vector x gets the coordinate sqrt(M^2 - |x|^2), M the largest
norm, and a query is scaled to norm M; then nearer means a larger product. Gaussian (2-stable)
projections to ``PROJECTED`` dimensions make the squared projected distance of a pair its squared
distance times a chi-square variable. A search takes leaves of a kd-tree over the projections in
order of their projected distance, verifies their rows on the original vectors, and stops when a
nearer row than the k-th found would have come earlier with probability ``CONFIDENCE``.

The upper tree, of at most ``MAX_CELLS`` cells, is fitted on at most ``SAMPLE_ROWS`` projected rows;
every row is indexed in its cell. A cell is cut into blocks of about ``BLOCK_ROWS`` rows by a hash of
the id, so copies of one vector spread over many tasks; a block has its own kd-tree. A query first
searches a block of its own cell, which bounds the distance of its k-th neighbour, and then every
block of the cells that the stopping test leaves. Queries meet a block in chunks of bounded size.

Defined cases: vectors that are null, zero, of another length than most, or hold nulls or
non-finite numbers take no part; nor do null ids; rows that share an id count once, with the
smallest vector; equal scores go to the smaller id; with fewer candidates than k all are returned;
empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from scanloom.llm.common import ship, stage

PROJECTED = 12
CONFIDENCE = 0.98
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024
BLOCK_ROWS = 4096
LEAF_ROWS = 64
QUERY_CHUNK = 4096
WAVE_LEAVES = 8
SEED = 20


def chi_square(p: float, m: int) -> float:
    """Quantile of the chi-square distribution by the cube-root normal approximation."""
    a = 2.0 / (9.0 * m)
    return m * (1.0 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def kd_cells(points: np.ndarray, cells: int) -> list[np.ndarray]:
    """Positions of ``points`` in ``cells`` (a power of two) parts, halved along the widest side."""
    parts = [np.arange(len(points))]
    while len(parts) < cells:
        halves = []
        for part in parts:
            own = points[part]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            order = np.argsort(own[:, side], kind="stable")
            halves += [part[order[: len(order) // 2]], part[order[len(order) // 2 :]]]
        parts = halves
    return parts


class Tree:
    """The upper tree: split planes from a sample, as a complete binary tree."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.side = np.zeros(1 << depth, int)
        self.cut = np.zeros(1 << depth)
        parts = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = sample[parts[node]]
            if len(own):
                side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut = float(np.median(own[:, side]))
                self.side[node], self.cut[node] = side, cut
                left = own[:, side] < cut
                parts[2 * node], parts[2 * node + 1] = parts[node][left], parts[node][~left]
            else:
                parts[2 * node] = parts[2 * node + 1] = parts[node]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.side[node]] >= self.cut[node]
            node = 2 * node + right
        return node - (1 << self.depth)

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to each cell, from the planes between them."""
        low = {1: np.zeros(len(point))}
        for node in range(1, 1 << self.depth):
            gap, side = low.pop(node), self.side[node]
            reach = point[side] - self.cut[node]
            for child, across in ((2 * node, reach >= 0), (2 * node + 1, reach < 0)):
                own = gap
                if across and abs(reach) > gap[side]:
                    own = gap.copy()
                    own[side] = abs(reach)
                low[child] = own
        first = 1 << self.depth
        return np.array([float((low[first + c] ** 2).sum()) for c in range(first)])


class Space:
    """The projection and the stopping test, the same in every task."""

    def __init__(self, dim: int, norm: float, projected: int = PROJECTED, confidence: float = CONFIDENCE):
        self.dim, self.norm = dim, norm
        self.matrix = np.random.RandomState(SEED).standard_normal((dim + 1, projected))
        self.limit = chi_square(confidence, projected)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0.0))
        return np.hstack([vectors, rest[:, None]]) @ self.matrix

    def place_query(self, vector: np.ndarray) -> np.ndarray:
        return (vector * (self.norm / np.sqrt((vector**2).sum()))) @ self.matrix[: self.dim]

    def distance(self, vector: np.ndarray, score: float) -> float:
        """Squared distance between a scaled query and a row with that inner product."""
        return max(0.0, 2.0 * self.norm**2 - 2.0 * score * self.norm / float(np.sqrt((vector**2).sum())))


def _vectors(column, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Block:
    """A block's rows with their own kd-tree."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        self.space = space
        leaves = 1
        while leaves * LEAF_ROWS < len(ids):
            leaves *= 2
        points = space.place(vectors)
        order = np.concatenate(parts := kd_cells(points, leaves))
        self.ids, self.vectors = ids[order], vectors[order]
        self.edges = np.cumsum([0, *map(len, parts)])
        full = [points[p] for p in parts]
        self.low = np.array([p.min(axis=0) if len(p) else np.full(points.shape[1], np.inf) for p in full])
        self.high = np.array([p.max(axis=0) if len(p) else np.full(points.shape[1], np.inf) for p in full])

    def search(self, own: int, vector: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows found with a score of at least ``floor``, best first."""
        space, point = self.space, self.space.place_query(vector)
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        reach = (gap**2).sum(axis=1)
        order = np.argsort(reach, kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), WAVE_LEAVES):
            worst = max(floor, scores[k - 1]) if len(scores) >= k else floor
            if worst > -np.inf and reach[order[at]] > space.limit * space.distance(vector, worst):
                break
            rows = np.concatenate(
                [np.arange(self.edges[leaf], self.edges[leaf + 1]) for leaf in order[at : at + WAVE_LEAVES]]
            )
            # Summed row by row in one order, so that equal vectors have equal scores.
            found = (self.vectors[rows] * vector).sum(axis=1)
            good = (found >= worst) & (self.ids[rows] != own)
            ids = np.concatenate([ids, self.ids[rows[good]]])
            scores = np.concatenate([scores, found[good]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def nearest(
    vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found for each row of ``is_query``."""
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(vector_col, lambda x: x != 0)
    rows = (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
        .groupBy(F.col(id_col).cast("long").alias("vec_id"))
        .agg(F.min(vector_col).alias("vector"))
    )
    rows = stage(rows, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = (
        rows.groupBy(F.size("vector").alias("dim"))
        .agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm"))
        .orderBy(F.desc("n"), "dim")
        .first()
    )
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n, space = sizes["dim"], sizes["n"], Space(sizes["dim"], sizes["norm"])
    rows = rows.filter(F.size("vector") == dim)

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    depth = max(0, min(MAX_CELLS.bit_length() - 1, ((n - 1) // BLOCK_ROWS).bit_length()))
    tree = Tree(space.place(np.array([r[0] for r in sample], np.float64)), depth)

    def assign(batches):
        for batch in batches:
            cells = tree.cells(space.place(_vectors(batch.column(1), dim)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "vector", "cell"]
            )

    kind = rows.schema["vector"].dataType.simpleString()
    celled = rows.mapInArrow(assign, f"vec_id long, vector {kind}, cell int")
    # At most MAX_CELLS counts.
    counts = dict(map(tuple, celled.groupBy("cell").count().collect()))
    blocks = {c: max(1, -(-m // BLOCK_ROWS)) for c, m in counts.items()}
    first = dict(zip(sorted(blocks), np.cumsum([0, *(blocks[c] for c in sorted(blocks))]).tolist()))
    base = F.create_map(*(F.lit(x) for c in sorted(first) for x in (c, first[c])))
    width = F.create_map(*(F.lit(x) for c in sorted(blocks) for x in (c, blocks[c])))
    salt = F.pmod(F.xxhash64("vec_id"), width[F.col("cell")])
    indexed = stage(
        celled.select("vec_id", "vector", (base[F.col("cell")] + salt).cast("int").alias("block")), "index"
    )

    queries = indexed.filter(is_query(F.col("vec_id")))
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(chunks)).cast("int"))

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and asked.num_rows:
            block = Block(
                space, candidates.column("vec_id").to_numpy(), _vectors(candidates.column("vector"), dim)
            )
            floors = asked.column("floor").to_numpy()
            for own, vector, floor in zip(
                asked.column("vec_id").to_pylist(), _vectors(asked.column("vector"), dim), floors
            ):
                ids, scores = block.search(own, vector, k, floor)
                out["query_id"].append(np.full(len(ids), own))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.empty(0, kinds[c]), *v]).astype(kinds[c]) for c, v in out.items()})

    def visit(asked: DataFrame) -> DataFrame:
        """``asked`` rows name a block and a chunk; every block is read once for each chunk."""
        present = indexed.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        return (
            present.groupBy("block", "chunk")
            .cogroup(asked.groupBy("block", "chunk"))
            .applyInArrow(search, "query_id long, vec_id long, score double")
        )

    home = stage(visit(queries.withColumn("floor", F.lit(float("-inf")))), "home")
    reached = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    known = queries.join(reached, queries["vec_id"] == reached["query_id"], "left").select(
        "vec_id", "vector", "block", "chunk", F.when(F.col("n") >= k, F.col("worst")).alias("floor")
    )
    spans = [(first[c], blocks[c]) if c in blocks else (0, 0) for c in range(1 << depth)]

    def spread(batches):
        for batch in batches:
            picked, targets, floors = [], [], []
            homes, bounds = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            for i, vector in enumerate(_vectors(batch.column(1), dim)):
                floor = -np.inf if bounds[i] is None else bounds[i]
                far = np.inf if bounds[i] is None else space.limit * space.distance(vector, floor)
                for cell in np.flatnonzero(tree.bounds(space.place_query(vector)) <= far):
                    for block in range(spans[cell][0], sum(spans[cell])):
                        if block != homes[i]:
                            picked.append(i)
                            targets.append(block)
                            floors.append(floor)
            at = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(targets, pa.int32()),
                    batch.column(3).take(at),
                    pa.array(floors, pa.float64()),
                ],
                names=["vec_id", "vector", "block", "chunk", "floor"],
            )

    rest = visit(known.mapInArrow(spread, f"vec_id long, vector {kind}, block int, chunk int, floor double"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(rest)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
