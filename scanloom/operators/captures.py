"""Turning capture events into documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.operators import mutations as mut

# Keys of new rows are derived from the session and its capture number, so reruns give the same keys.
NEW_DOCUMENT_BASE = 1_000_000_000_000
PAGES_PER_SESSION = 1_000_000


def new_document_id(session_id: Column) -> Column:
    return session_id + F.lit(NEW_DOCUMENT_BASE)


def ingest_captures(
    documents: DataFrame, pages: DataFrame, captures: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``captures(session_id, seq, is_retake, retake_page_id, busy?)`` into new tables.

    The first capture of a session creates its document, the following ones append to it; a retake
    replaces one page's image and keeps its edits. Captures flagged ``busy`` arrived while another
    one was being handled and are ignored.
    """
    taken = captures.filter(~F.coalesce("busy", F.lit(False))) if "busy" in captures.columns else captures
    image = F.concat(F.lit("cap_"), F.col("session_id").cast("string"), F.lit("_"), F.col("seq").cast("string"), F.lit(".jpg"))
    # A number outside the space of its session would silently name another page.
    fits = F.col("seq").between(0, PAGES_PER_SESSION - 1) & F.col("session_id").between(0, NEW_DOCUMENT_BASE - 1)
    page_id = F.when(fits, new_document_id(F.col("session_id")) * PAGES_PER_SESSION + F.col("seq")).otherwise(
        F.raise_error(F.lit("capture number or session id out of range")).cast("long")
    )
    fresh = taken.filter(~F.col("is_retake")).select(
        page_id.alias("id"),
        new_document_id(F.col("session_id")).alias("document_id"),
        F.col("seq").alias("capture_index"),
        image.alias("image_path"),
    )
    retakes = taken.filter(F.col("is_retake")).select(
        F.col("retake_page_id").alias("page_id"), image.alias("image_path"), "seq"
    )
    created = mut.create_documents(
        documents,
        fresh.select(F.col("document_id").alias("id")).distinct().withColumn("name", F.lit(None).cast("string")),
        now,
    )
    documents_1, pages_1 = mut.add_pages(created, pages, fresh, now)
    return mut.replace_pages(documents_1, pages_1, retakes, now)
