"""Export plan: ordered pages with their page geometry, and the progress log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom.functions import geometry as g, status
from scanloom.functions.text import safe_file_name
from scanloom.operators.catalog import page_numbers, preset_key


def export_manifest(documents: DataFrame, pages: DataFrame, images: DataFrame, mode: str = "integer") -> DataFrame:
    """One row per exported page: number, source, edit parameters, page size and placement.

    ``images(image_path, img_w, img_h)`` lists decodable sources. Pages whose image is missing are
    skipped after numbering, so their numbers stay as gaps; documents without pages do not appear.
    ``mode="integer"`` gives whole page sizes, ``"points"`` fractional ones.
    """
    numbered = page_numbers(pages)
    dims = g.rotated_dims(F.col("img_w"), F.col("img_h"), F.col("rotation_degrees"))
    size = (g.pdf_size if mode == "integer" else g.pdf_rect)(F.col("out_w"), F.col("out_h"))
    return (
        numbered.join(images, "image_path")
        .join(documents.select(F.col("id").alias("document_id"), "name"), "document_id")
        .withColumn("_dims", dims)
        .withColumns({"out_w": F.col("_dims.w"), "out_h": F.col("_dims.h")})
        .withColumn("_size", size)
        .withColumns({"page_w": F.col("_size.w"), "page_h": F.col("_size.h")})
        .withColumn("_place", g.placement(F.col("out_w"), F.col("out_h"), F.col("page_w"), F.col("page_h")))
        .select(
            "document_id",
            F.concat(safe_file_name(F.col("name")), F.lit(".pdf")).alias("file_name"),
            F.col("id").alias("page_id"),
            "page_number",
            "image_path",
            preset_key(F.col("filter_name")).alias("filter_name"),
            "rotation_degrees",
            "out_w",
            "out_h",
            "page_w",
            "page_h",
            F.col("_place.scale").alias("scale"),
            F.col("_place.dx").alias("dx"),
            F.col("_place.dy").alias("dy"),
        )
    )


def export_sources(pages: DataFrame) -> DataFrame:
    """What a page is rendered from: the original image and its edit, never a preview."""
    return pages.select(
        F.col("id").alias("page_id"), "image_path", preset_key(F.col("filter_name")).alias("filter_name"),
        g.norm_rotation(F.col("rotation_degrees")).alias("rotation_degrees"),
    )


def export_progress(pages: DataFrame) -> DataFrame:
    """Progress rows per document: preparing, one per page, finalizing.

    The page rows come from the pages themselves, so a very large document is not expanded in one row.
    """
    numbered = page_numbers(pages)
    totals = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.min_by("id", F.struct("sort_order", "id")).alias("_first"),
        F.max_by("id", F.struct("sort_order", "id")).alias("_last"),
    )
    rendering = numbered.join(totals, "document_id").select(
        "document_id", F.lit("rendering").alias("phase"), F.col("page_number").alias("current"), "total",
        F.col("id").alias("page_id"), "filter_name",
    )
    ends = totals.withColumn(
        "_e",
        F.explode(
            F.array(
                F.struct(F.lit("preparing").alias("phase"), F.lit(0).cast("long").alias("current"), F.col("_first").alias("page_id")),
                F.struct(F.lit("finalizing").alias("phase"), F.col("total").alias("current"), F.col("_last").alias("page_id")),
            )
        ),
    ).select("document_id", "_e.phase", "_e.current", "total", "_e.page_id", F.lit(None).cast("string").alias("filter_name"))
    log = rendering.unionByName(ends)
    phase, current, total = F.col("phase"), F.col("current"), F.col("total")
    step = F.when(phase == "preparing", F.lit(0).cast("long")).when(phase == "rendering", current).otherwise(total + 1)
    return log.select(
        "document_id",
        step.alias("step"),
        "phase",
        "current",
        "total",
        "page_id",
        status.progress_text(phase, current, total, F.col("filter_name")).alias("message"),
        status.progress_fraction(phase, current, total).alias("fraction"),
        status.progress_ratio(current, total).alias("ratio"),
    )
