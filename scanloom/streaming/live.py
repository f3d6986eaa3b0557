"""Live views over a feed of page changes, and live capture and preview requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanloom.functions.text import request_key
from scanloom.operators.captures import NEW_DOCUMENT_BASE, PAGES_PER_SESSION


class Summary(StatefulProcessor):
    """Latest version of every page of one document; emits count and cover after each batch of changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pages = handle.getMapState("pages", "page_id long", "version long, sort_order int, small string, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for change in pd.concat(list(rows)).sort_values("version").itertuples(index=False):
            page = (int(change.page_id),)
            if not self._pages.containsKey(page) or self._pages.getValue(page)[0] < change.version:
                small = None if pd.isna(change.small_preview_path) else change.small_preview_path
                self._pages.updateValue(page, (int(change.version), int(change.sort_order), small, bool(change.deleted)))
        count, first = 0, None
        for page, (_, order, small, gone) in self._pages.iterator():
            if not gone:
                count += 1
                first = min(first or (order, page[0], small), (order, page[0], small), key=lambda p: p[:2])
        yield pd.DataFrame(
            {"document_id": [key[0]], "page_count": [count], "first_small_preview": [first[2] if first else None]}
        )

    def close(self) -> None:
        pass


def live_summary(changes: DataFrame) -> DataFrame:
    """``changes(document_id, page_id, version, sort_order, small_preview_path, deleted)`` to summaries."""
    return changes.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=Summary(),
        outputStructType="document_id long, page_count long, first_small_preview string",
        outputMode="Update",
        timeMode="None",
    )


def live_pages(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Latest version of each page: a built-in streaming aggregate (update or complete mode)."""
    latest = F.max_by(F.struct(*fields), "version")
    return (
        changes.groupBy("document_id", "page_id")
        .agg(latest.alias("_l"), F.max("version").alias("version"))
        .select("document_id", "page_id", "version", "_l.*")
    )


class CaptureCounter(StatefulProcessor):
    """Numbers the captures of one session across micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self._count.get()[0] if self._count.exists() else 0
        document = int(key[0]) + NEW_DOCUMENT_BASE
        out = []
        for capture in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            image = f"cap_{key[0]}_{capture.seq}.jpg"
            if capture.is_retake:
                out.append(("retake", None, int(capture.retake_page_id), None, image))
                continue
            if n == 0:
                out.append(("document", document, None, None, None))
            if not 0 <= capture.seq < PAGES_PER_SESSION:
                raise ValueError("capture number out of range")
            out.append(("page", document, document * PAGES_PER_SESSION + int(capture.seq), n, image))
            n += 1
        self._count.update((n,))
        # Object columns first: ids beside NULLs would pass through floats and lose digits.
        frame = pd.DataFrame(out, columns=["what", "document_id", "page_id", "sort_order", "image_path"], dtype=object)
        yield frame.astype({"document_id": "Int64", "page_id": "Int64", "sort_order": "Int64"})

    def close(self) -> None:
        pass


def capture_stream(captures: DataFrame) -> DataFrame:
    """Inserts and replacements for the catalogue, one row per change, in capture order per session."""
    return captures.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=CaptureCounter(),
        outputStructType="what string, document_id long, page_id long, sort_order long, image_path string",
        outputMode="Append",
        timeMode="None",
    )


def preview_request_stream(requests: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Each distinct render request once while it may still be in flight."""
    key = request_key(F.col("image_path"), F.col("filter_name"), F.col("rotation_degrees"))
    return (
        requests.withColumn("request_key", key)
        .withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["request_key"])
    )
