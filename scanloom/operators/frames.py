"""Stabilising a stream of outline detections, as a batch over recorded frames.

Frames are ``(session_id, frame_id, ts_ms, corners?)``. A session may hold any number of frames:
frames are numbered, cut into chunks that borrow the few frames before them, and only one value per
chunk is carried on, so no session has to fit in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom import scale

# Buffer size, quorum, hold time and smoothing factor.
BUFFER_FRAMES = 7
QUORUM = 3
HOLD_MS = 500
SMOOTHING = 0.35

KEYS = ["session_id"]


def _median_corners(recent: Column) -> Column:
    """Per-coordinate upper median of the buffered outlines."""

    def middle(i: int, axis: str) -> Column:
        values = F.array_sort(F.transform(recent, lambda c: F.element_at(c, i + 1)[axis]))
        return F.get(values, F.floor(F.size(recent) / 2).cast("int"))

    return F.array(*[F.struct(middle(i, "x").alias("x"), middle(i, "y").alias("y")) for i in range(4)])


def _numbered(frames: DataFrame) -> DataFrame:
    return scale.number_rows(frames, KEYS, scale.span_bucket(F.col("ts_ms"), 60_000), ["ts_ms", "frame_id"], "pos")


def _with_recent(frames: DataFrame, size: int, rows: int) -> tuple[DataFrame, DataFrame]:
    numbered = _numbered(frames)
    buffer = W.partitionBy(*KEYS, "chunk").orderBy("pos").rowsBetween(-(size - 1), 0)
    recent = (
        scale.chunk_with_overlap(numbered, "pos", size - 1, rows)
        .withColumn("recent", F.collect_list("corners").over(buffer))
        .filter("own")
        .drop("own")
    )
    chunks = numbered.select(*KEYS, F.floor(F.col("pos") / rows).cast("long").alias("chunk")).distinct()
    return recent, chunks


def stabilize(
    frames: DataFrame,
    size: int = BUFFER_FRAMES,
    quorum: int = QUORUM,
    hold_ms: int = HOLD_MS,
    rows: int = scale.CHUNK_ROWS,
) -> DataFrame:
    """Shown outline per frame: the median of the buffer, the held one, or none.

    Adds ``pos``, ``status`` (valid, held, none), ``shown`` and ``shown_pos`` (the frame the shown
    outline was made at).
    """
    recent, chunks = _with_recent(frames, size, rows)
    agreed = recent.withColumn(
        "_agreed",
        F.when(
            F.size("recent") >= quorum,
            F.struct(F.col("ts_ms").alias("at"), F.col("pos"), _median_corners(F.col("recent")).alias("corners")),
        ),
    ).drop("recent")
    carried = scale.carry_forward(agreed, KEYS, ["pos"], "_agreed", "_last", chunks)
    valid = F.col("_agreed").isNotNull()
    held = F.col("ts_ms") - F.col("_last.at") < hold_ms
    status = F.when(valid, "valid").when(held, "held").otherwise("none")
    return carried.withColumn("status", status).select(
        *frames.columns,
        "pos",
        "status",
        F.when(F.col("status") != "none", F.col("_last.corners")).alias("shown"),
        F.when(F.col("status") != "none", F.col("_last.pos")).alias("shown_pos"),
    )


def last_valid(frames: DataFrame, size: int = BUFFER_FRAMES, quorum: int = QUORUM, rows: int = scale.CHUNK_ROWS) -> DataFrame:
    """Time of the last frame at which enough detections agreed, at or before each frame."""
    recent, chunks = _with_recent(frames, size, rows)
    agreed = recent.withColumn("_at", F.when(F.size("recent") >= quorum, F.col("ts_ms"))).drop("recent")
    return scale.carry_forward(agreed, KEYS, ["pos"], "_at", "last_valid_ms", chunks).select(
        *frames.columns, "last_valid_ms"
    )


def stabilize_smooth(frames: DataFrame, alpha: float = SMOOTHING, **settings) -> DataFrame:
    """Stabilised outlines with exponential smoothing over valid frames, restarted after a loss.

    Between two losses the smoothed value is a weighted sum with weights ``(1-alpha)**age``. Cut into
    chunks that borrow enough earlier frames for the remaining weight to vanish in double precision,
    it becomes a running sum, so long sessions need no sequential pass.
    """
    keep = 1.0 - alpha
    borrow = math.ceil(math.log(1e-24) / math.log(keep))
    rows = max(borrow + 1, int(math.log(1e-200) / math.log(keep)) - borrow)
    shown = stabilize(frames, **settings)
    parts = scale.prefix_sum(
        shown, KEYS, scale.span_bucket(F.col("pos")), ["pos"],
        (F.col("status") == "none").cast("long"), "part",
    )
    valid = parts.filter(F.col("status") == "valid").select(*KEYS, "part", "pos", "shown")
    group = [*KEYS, "part"]
    numbered = scale.number_rows(valid, group, scale.span_bucket(F.col("pos")), ["pos"], "k")
    chunked = scale.chunk_with_overlap(numbered, "k", borrow, rows)
    whole = W.partitionBy(*group, "chunk")
    running = whole.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    age = F.col("k") - F.min("k").over(whole)
    weighed = chunked.withColumn("_i", age).withColumn(
        "_w", F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(keep), -F.col("_i"))
    )
    names = [(i, a) for i in range(4) for a in ("x", "y")]
    sums = {
        f"_{a}{i}": F.pow(F.lit(keep), F.col("_i"))
        * F.sum(F.col("_w") * F.element_at("shown", i + 1)[a]).over(running)
        for i, a in names
    }
    smooth = F.array(*[F.struct(F.col(f"_x{i}").alias("x"), F.col(f"_y{i}").alias("y")) for i in range(4)])
    smoothed = weighed.withColumns(sums).filter("own").select(*KEYS, F.col("pos").alias("shown_pos"), smooth.alias("smoothed"))
    seen = shown.filter(F.col("status") != "none").join(smoothed, [*KEYS, "shown_pos"], "left")
    lost = shown.filter(F.col("status") == "none")
    columns = [*frames.columns, "pos", "status", "smoothed"]
    return seen.select(*columns).unionByName(lost.select(*columns[:-1]), allowMissingColumns=True)
