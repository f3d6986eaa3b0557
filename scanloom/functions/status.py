"""Preview status and export progress as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.operators.catalog import preset_key, preset_name


def page_list_status(has_bitmap: Column, has_path: Column, loading: Column) -> Column:
    return (
        F.when(has_bitmap, "IMAGE")
        .when(~has_path | loading, "LOADING_PLACEHOLDER")
        .otherwise("NUMBER_PLACEHOLDER")
    )


def page_edit_status(
    use_working: Column, has_working: Column, computing: Column, has_large: Column, has_path: Column, loading: Column
) -> Column:
    return (
        F.when(use_working & has_working, "IMAGE")
        .when(use_working & computing, "FILTER_LOADING")
        .when(~use_working & has_large, "IMAGE")
        .when(~use_working & (~has_path | loading), "PREVIEW_LOADING")
        .otherwise("EMPTY_PLACEHOLDER")
    )


def page_card_status(has_large: Column, regenerating: Column) -> Column:
    return F.when(has_large, "IMAGE").when(regenerating, "LOADING").otherwise("PLACEHOLDER")


def page_editor_status(has_working: Column, generating: Column, has_large: Column) -> Column:
    return (
        F.when(has_working, "MEMORY_IMAGE")
        .when(generating, "LOADING")
        .when(has_large, "IMAGE")
        .otherwise("PLACEHOLDER")
    )


def camera_control(captured: Column) -> Column:
    return F.when(captured == 0, "CLOSE_BUTTON").otherwise("THUMBNAIL_STACK")


def small_preview_status(has_bitmap: Column) -> Column:
    return F.when(has_bitmap, "IMAGE").otherwise("PLACEHOLDER")


def progress_ratio(current: Column, total: Column) -> Column:
    """Clamped share of pages done; 0 when there are none."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(current, F.lit(0)), total) / total)


def progress_fraction(phase: Column, current: Column, total: Column) -> Column:
    """Share done by phase; NULL when there are no pages."""
    return F.when(
        total > 0,
        F.when(phase == "preparing", F.lit(0.0))
        .when(phase == "finalizing", F.lit(1.0))
        .otherwise(F.least(F.greatest(current / total, F.lit(0.0)), F.lit(1.0))),
    )


def progress_text(phase: Column, current: Column, total: Column, filter_name: Column) -> Column:
    some = total > 0
    count = F.concat(current.cast("string"), F.lit(" / "), total.cast("string"), F.lit("ページを"))
    plain = filter_name.isNull() | (preset_key(filter_name) == "original")
    return (
        F.when((phase == "preparing") & some, F.concat(total.cast("string"), F.lit("ページのPDFを準備中…")))
        .when(phase == "preparing", F.lit("PDFを準備中…"))
        .when((phase == "finalizing") & some, F.concat(total.cast("string"), F.lit("ページのPDFを書き出し中…")))
        .when(phase == "finalizing", F.lit("PDFを書き出し中…"))
        .when(~some, F.lit("ページを処理中…"))
        .when(plain, F.concat(count, F.lit("処理中…")))
        .otherwise(F.concat(count, preset_name(filter_name), F.lit("で処理中…")))
    )
