"""Live outline stabiliser: one small state per camera session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanloom.operators.frames import BUFFER_FRAMES, HOLD_MS, QUORUM, SMOOTHING

COORDS = [f"{a}{i}" for i in range(1, 5) for a in "xy"]
OUTPUT = "session_id long, frame_id long, ts_ms long, status string, " + ", ".join(
    f"{c} double" for c in COORDS
) + ", " + ", ".join(f"s{c} double" for c in COORDS)


class Stabiliser(StatefulProcessor):
    """Buffers recent detections; emits the shown and the smoothed outline of every frame.

    Frames of a micro-batch are taken in (ts_ms, frame_id) order. A frame older than the newest one
    already handled changes nothing and comes out as ``late``, so late frames can be counted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("session", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self._state.get()
        state = json.loads(saved[0]) if saved else {"at": None, "buffer": [], "held": None, "smooth": None}
        frames = pd.concat(list(rows)).sort_values(["ts_ms", "frame_id"])
        out = []
        for frame in frames.itertuples(index=False):
            position = [int(frame.ts_ms), int(frame.frame_id)]
            if state["at"] is not None and position <= state["at"]:
                out.append((key[0], frame.frame_id, frame.ts_ms, "late", *[None] * 16))
                continue
            state["at"] = position
            status, shown = self._show(state, frame)
            out.append((key[0], frame.frame_id, frame.ts_ms, status, *(shown or [None] * 8), *(state["smooth"] or [None] * 8)))
        self._state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["session_id", "frame_id", "ts_ms", "status", *COORDS, *[f"s{c}" for c in COORDS]])

    @staticmethod
    def _show(state: dict, frame) -> tuple[str, list[float] | None]:
        corners = None if pd.isna(frame.x1) else [float(getattr(frame, c)) for c in COORDS]
        state["buffer"] = (state["buffer"] + [corners])[-BUFFER_FRAMES:]
        seen = [c for c in state["buffer"] if c is not None]
        if len(seen) >= QUORUM:
            median = [sorted(values)[len(seen) // 2] for values in zip(*seen)]
            before = state["smooth"] or median
            state["smooth"] = [b + (m - b) * SMOOTHING for b, m in zip(before, median)]
            state["held"] = [int(frame.ts_ms), median]
            return "valid", median
        if state["held"] and frame.ts_ms - state["held"][0] < HOLD_MS:
            return "held", state["held"][1]
        state["held"] = state["smooth"] = None
        return "none", None

    def close(self) -> None:
        pass


def flat_frames(frames: DataFrame) -> DataFrame:
    """Frames with one column per coordinate, as the processor takes them."""
    from pyspark.sql import functions as F

    coords = [
        F.element_at("corners", i // 2 + 1)["xy"[i % 2]].alias(c) for i, c in enumerate(COORDS)
    ]
    return frames.select("session_id", "frame_id", "ts_ms", *coords)


def stabilize_stream(frames: DataFrame) -> DataFrame:
    """Streaming twin of ``stabilize`` and ``stabilize_smooth`` over ``flat_frames``."""
    return frames.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=Stabiliser(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
