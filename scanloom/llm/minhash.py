"""Near-duplicates: an inverted join of MinHash signatures, and exact confirmation.

A document's set holds the hashes of its word shingles. Equal sets are one class from the start.
Each class has a signature of ``COORDINATES`` minima. Classes whose sets reach the threshold agree
in at least ``needed`` coordinates, but for a chance of ``MISS`` per pair (binomial tail), so:

* Every coordinate value is a posting list. Coordinates of a class are ordered by the length of
  their lists, and only the first ``COORDINATES - needed + 1`` are posted: classes that agree in
  ``needed`` coordinates meet in one of them (prefix). The longest lists are thereby skipped: a line
  that half the corpus holds is posted only by classes that have nothing rarer.
* The classes of a posting list meet through its smallest one, the pivot. Members that agree with
  the pivot in ``needed`` coordinates are joined to it; the others are counted against all members
  of the pivot's lists, in blocks of bounded size. No list is expanded into its pairs.
* The components of what is joined are small families that hold every link. Inside a family sets
  are built from the texts again and links are exact: num * union <= den * intersection. A family
  is searched breadth first over what is not yet reached, and only the tree's links leave the task,
  so copies are never expanded into all pairs. Families too large for one task are cut into blocks
  that meet in pairs.

Defined cases: texts that are null or without words have the empty set and are linked with nothing;
with fewer words than a shingle has, the whole sequence is the one shingle; rows that share an id
are one document; rows with a null id take the smallest id of their class or null and are not kept;
an empty table gives no rows; other columns are not carried. Shingles are 64-bit hashes, equal sets
128-bit ones.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import release_memos, ship, stage
from scanloom.llm.components import components

COORDINATES = 64
MISS = 1e-9
BLOCK_MEMBERS = 1024
FAMILY_SHINGLES = 1_500_000
SEED = 7

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def agreements_needed(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most agreements that a pair at the threshold falls short of with a chance of ``miss``."""
    total = 0.0
    for k in range(coordinates + 1):
        total += comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if total > miss:
            return max(1, k)
    return coordinates


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Words are runs of anything but ASCII white
    space, with A-Z lowered."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    out = np.full(len(parts) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _STEP + hashed[i : len(parts) - size + 1 + i]
    first, second, shift = _MIX
    out ^= out >> shift
    out *= first
    out ^= out >> shift
    out *= second
    out ^= out >> shift
    return np.unique(out)


def _multipliers() -> np.ndarray:
    draw = np.random.RandomState(SEED)
    return draw.randint(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum under each multiplier, mixed down to 32 bits."""
    least = np.empty(len(factors), np.uint64)
    room = np.empty_like(hashes)
    for k, factor in enumerate(factors):
        np.multiply(hashes, factor, out=room)
        least[k] = room.min()
    least *= _MIX[0]
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``n_shingles``, ``digest`` (of the set), ``minima`` (array<int>), ``short`` (16 bits
    of each, for counting agreements)."""

    def run(batches):
        release_memos()
        factors = _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, digests, minima, shorts = [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_set(text, words)
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    own = signature(hashes, factors) if len(hashes) else np.empty(0, np.uint32)
                    minima.append(own)
                    shorts.append(own.astype("<u2").tobytes())
                ends = pa.array(np.cumsum([0, *map(len, minima)]), pa.int32())
                flat = pa.array(np.concatenate(minima).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(ends, flat),
                        pa.array(shorts, pa.binary()),
                    ],
                    names=["doc", "n_shingles", "digest", "minima", "short"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(
        run, "doc long, n_shingles long, digest binary, minima array<int>, short binary"
    )


def _posted(classes: DataFrame, needed: int) -> DataFrame:
    """``token``, ``doc``: each class under its prefix of coordinate values, rarest first."""
    tokens = classes.select("doc", F.posexplode("minima").alias("at", "value")).select(
        "doc", (F.col("at").cast("long") * F.lit(1 << 32) + (F.col("value").cast("long") + (1 << 31))).alias("token")
    )
    lengths = tokens.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    # The size check knows of a class what its row takes in the file, not that it became many rows.
    shared = tokens.hint("merge").join(lengths, "token").groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("length", "token"))).alias("lists")
    )
    # Values that no other class has come first in the order and take places of the prefix.
    places = F.size("lists") - (needed - 1)
    return shared.filter(places > 0).select(
        "doc", F.explode(F.transform(F.slice("lists", F.lit(1), places), lambda x: x["token"])).alias("token")
    )


def _agree(batch_a, batch_b) -> np.ndarray:
    a = np.frombuffer(b"".join(batch_a), "<u2").reshape(-1, COORDINATES)
    b = np.frombuffer(b"".join(batch_b), "<u2").reshape(-1, COORDINATES)
    return (a == b).sum(axis=1)


def _links(docs: np.ndarray, found) -> pa.Table:
    at = np.array(list(found), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(docs[at[:, 0]], pa.int64()), "b": pa.array(docs[at[:, 1]], pa.int64())})


def _reach(n: int, starts, near):
    """Breadth-first trees: ``near(x, others)`` gives the positions in ``others`` linked with x. Nodes
    are first reached from ``starts``; yields the links of the trees."""
    left = np.ones(n, bool)
    for start in starts:
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return
            found = others[near(x, others)]
            left[found] = False
            for y in found.tolist():
                yield x, y
                queue.append(y)


def candidate_edges(classes: DataFrame, needed: int) -> DataFrame:
    """``a``, ``b``: links of trees whose components hold every pair of ``needed`` agreements."""
    posted = stage(_posted(classes, needed), "posted")
    pivots = posted.groupBy("token").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last"))
    members = (
        posted.hint("merge").join(pivots.filter("pivot <> last").select("token", "pivot"), "token")
        .filter("doc <> pivot")
        .select("pivot", "doc")
        .distinct()
    )
    short = classes.select("doc", "short")
    pairs = members.join(short, "doc").join(
        short.select(F.col("doc").alias("pivot"), F.col("short").alias("pivot_short")), "pivot"
    )

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                agree = _agree(batch.column(3).to_pylist(), batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(agree >= needed)], names=["pivot", "doc", "short", "near"]
                )

    met = stage(
        pairs.select("pivot", "doc", "short", "pivot_short").mapInArrow(
            compare, "pivot long, doc long, short binary, near boolean"
        ),
        "met",
    )
    star = met.filter("near").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))

    # Members that are not near their pivot meet all members of its lists, block by block.
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK_MEMBERS))).cast("int")
    sizes = (
        met.groupBy("pivot")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("out"))
        .filter("out > 0 AND n > 1")
        .select("pivot", blocks(F.col("n")).alias("columns"), blocks(F.col("out")).alias("rows"))
    )
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    spread = met.join(sizes, "pivot").withColumns({"row": block("rows"), "column": block("columns")})
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = spread.filter("NOT near").select("pivot", "doc", "short", "row", F.explode(span("columns")).alias("column"), F.lit(True).alias("asked"))
    there = spread.select("pivot", "doc", "short", F.explode(span("rows")).alias("row"), "column", F.lit(False).alias("asked"))

    def count(group: pa.Table) -> pa.Table:
        docs, asks = group.column("doc").to_numpy(), group.column("asked").to_numpy()
        sigs = np.frombuffer(b"".join(group.column("short").to_pylist()), "<u2").reshape(-1, COORDINATES)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            # Of each pair one has to be an outsider; the others are joined to the pivot already.
            able = np.ones(len(others), bool) if asks[x] else asks[others]
            able[able] = (sigs[others[able]] == sigs[x]).sum(axis=1) >= needed
            return able

        return _links(docs, _reach(len(docs), np.flatnonzero(asks), near))

    return star.unionByName(
        asked.unionByName(there).groupBy("pivot", "row", "column").applyInArrow(count, "a long, b long")
    )


def exact_edges(
    families: DataFrame, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str
) -> DataFrame:
    """``a``, ``b``: trees of the exact links inside each family of ``doc``, ``family``, ``n_shingles``."""
    sizes = families.groupBy("family").agg(
        F.ceil(F.sum("n_shingles") / F.lit(float(FAMILY_SHINGLES))).cast("int").alias("blocks")
    )
    own = families.join(sizes, "family").withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "doc"), F.col("blocks")).cast("int")
    )
    # A family of several blocks sends each block to every pair it is part of.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda i: F.struct(F.least(i, F.col("block")).alias("x"), F.greatest(i, F.col("block")).alias("y")))
    texts = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        .join(own.select("doc", "family", pairs.alias("pairs")), "doc")
        .select("doc", "family", F.explode("pairs").alias("pair"), "text")
    )

    def confirm(group: pa.Table) -> pa.Table:
        sets = [shingle_set(t.as_py(), words) for t in group.column("text")]
        full = [i for i, s in enumerate(sets) if len(s)]
        docs_in = group.column("doc").to_numpy()[full]
        sets = [sets[i] for i in full]
        if not sets:
            return _links(docs_in, [])
        lengths = np.array(list(map(len, sets)))
        _, items = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        marked = np.zeros(items.max() + 1, bool)
        # The items of what is not reached, laid out once and cut down when half of it is reached.
        held = {"at": np.arange(len(sets)), "items": items, "begins": begins}

        def near(x: int, others: np.ndarray) -> np.ndarray:
            if 2 * len(others) < len(held["at"]):
                held["items"] = np.concatenate([items[begins[o] : begins[o + 1]] for o in others])
                held["begins"] = np.concatenate([[0], np.cumsum(lengths[others])])
                held["at"] = others
            mine = items[begins[x] : begins[x + 1]]
            marked[mine] = True
            common = np.add.reduceat(marked[held["items"]], held["begins"][:-1], dtype=np.int64)
            marked[mine] = False
            common = common[np.searchsorted(held["at"], others)]
            return den * common >= num * (lengths[x] + lengths[others] - common)

        return _links(docs_in, _reach(len(sets), range(len(sets)), near))

    return texts.groupBy("family", "pair").applyInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable over links of
    den * intersection >= num * union) and ``kept`` (the document is that one)."""
    ship(docs.sparkSession)
    needed = agreements_needed(num / den)
    read = stage(signatures(docs, words, id_col, text_col), "signatures")
    classes = stage(
        read.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("n_shingles", "minima", "short")))
        .filter("doc IS NOT NULL"),
        "classes",
    )
    families = components(candidate_edges(classes, needed))
    roots = families.select(F.col("component").alias("node"), "component").distinct()
    members = (
        families.unionByName(roots)
        .join(classes.select(F.col("doc").alias("node"), "n_shingles"), "node")
        .groupBy("node", "component")
        .agg(F.max("n_shingles").alias("n_shingles"))
        .select(F.col("node").alias("doc"), F.col("component").alias("family"), "n_shingles")
    )
    found = components(exact_edges(members, docs, words, num, den, id_col, text_col))
    named = classes.select("digest", "doc").join(found, F.col("doc") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "doc").alias("component_id"))
    return (
        read.join(named, "digest", "left")
        .select(
            F.col("doc").alias(id_col),
            "n_shingles",
            F.coalesce("component_id", "doc").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
