"""Read-side operators of the document/page catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import scale
from scanloom.schema import DEFAULT_PRESET, PAGES, PRESETS


def upgrade_pages(pages: DataFrame) -> DataFrame:
    """Bring any older page table to the current columns; missing preview paths become NULL."""
    empty = pages.sparkSession.createDataFrame([], PAGES)
    return empty.unionByName(pages, allowMissingColumns=True)


def with_page_defaults(pages: DataFrame) -> DataFrame:
    """Fill what an insert may leave out: filter, rotation and both preview paths."""
    have = set(pages.columns)
    filter_name = F.coalesce("filter_name", F.lit(DEFAULT_PRESET)) if "filter_name" in have else F.lit(DEFAULT_PRESET)
    rotation = F.coalesce("rotation_degrees", F.lit(0)) if "rotation_degrees" in have else F.lit(0)
    filled = pages.withColumns({"filter_name": filter_name, "rotation_degrees": rotation.cast("int")})
    for name in ("small_preview_path", "large_preview_path"):
        if name not in have:
            filled = filled.withColumn(name, F.lit(None).cast("string"))
    return filled


def document_by_id(documents: DataFrame, document_id: int | Column) -> DataFrame:
    return documents.filter(F.col("id") == document_id)


def page_by_id(pages: DataFrame, page_id: int | Column) -> DataFrame:
    return pages.filter(F.col("id") == page_id)


def pages_of(pages: DataFrame, document_id: int | Column) -> DataFrame:
    return pages.filter(F.col("document_id") == document_id).orderBy("sort_order", "id")


def image_path_of(pages: DataFrame, page_id: int | Column) -> DataFrame:
    return page_by_id(pages, page_id).select("image_path")


def page_attr_for_documents(pages: DataFrame, ids: DataFrame, attr: str) -> DataFrame:
    """One attribute of every page of a set of documents; NULL previews are returned too."""
    wanted = ids.select(F.col("id").alias("document_id")).distinct()
    return pages.join(wanted, "document_id", "left_semi").select("document_id", F.col("id").alias("page_id"), attr)


def preset_key(key: Column) -> Column:
    """A known filter key, or the default for an unknown or missing one."""
    known = key.isin([k for k, _ in PRESETS])
    return F.when(known, key).otherwise(F.lit(DEFAULT_PRESET))


def preset_name(key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PRESETS for v in pair])
    return F.element_at(table, preset_key(key))


def resolve_preset(df: DataFrame, key: str = "filter_name") -> DataFrame:
    return df.withColumns({"preset": preset_key(F.col(key)), "preset_name": preset_name(F.col(key))})


def document_summary(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Page count and first page's small preview (NULL kept) per document.

    One partially aggregated shuffle of the pages instead of a subquery per document; a document
    with very many pages is reduced on the map side.
    """
    per_document = pages.groupBy(F.col("document_id").alias("id")).agg(
        F.count("id").alias("page_count"),
        F.min_by("small_preview_path", F.struct("sort_order", "id")).alias("first_small_preview"),
    )
    return documents.join(per_document, "id", "left").select(
        "id",
        "name",
        "updated_at",
        F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"),
        "first_small_preview",
    )


def recent_documents(documents: DataFrame, n: int | None = None) -> DataFrame:
    ordered = documents.orderBy(F.col("updated_at").desc(), F.col("id"))
    return ordered if n is None else ordered.limit(n)


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))


def last_page_preview(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("captured_count"),
        F.max_by("small_preview_path", F.struct("sort_order", "id")).alias("last_small_preview"),
    )


def number_pages(pages: DataFrame, name: str = "pos") -> DataFrame:
    """0-based position of every page in its document's order."""
    return scale.number_rows(
        pages, ["document_id"], scale.span_bucket(F.col("sort_order")), ["sort_order", "id"], name
    )


def renumber(pages: DataFrame) -> DataFrame:
    columns = pages.columns
    return number_pages(pages, "_pos").withColumn("sort_order", F.col("_pos").cast("int")).select(*columns)


def page_numbers(pages: DataFrame) -> DataFrame:
    return number_pages(pages, "_pos").withColumn("page_number", F.col("_pos") + 1).drop("_pos")


PAGES_PER_PART = 500


def collect_pages(pages: DataFrame, fields: list[str], per_part: int = PAGES_PER_PART) -> DataFrame:
    """Ordered page structs per document, in parts of at most ``per_part`` pages.

    A list column cannot hold an arbitrarily large document, so the list comes in numbered parts;
    reading the parts in order gives the whole list.
    """
    numbered = number_pages(pages, "_pos")
    return (
        numbered.groupBy("document_id", F.floor(F.col("_pos") / per_part).cast("long").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_pos").alias("pos"), *fields))).alias("pages"))
    )


def last_per_key(commands: DataFrame, keys: list[str]) -> DataFrame:
    """One command per key: the one with the highest ``seq`` where there is one, else the greatest."""
    rest = [c for c in commands.columns if c not in keys]
    order = [F.col("seq")] if "seq" in rest else []
    order += [F.col(c) for c in sorted(rest) if c != "seq"]
    picked = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return commands.groupBy(*keys).agg(picked.alias("_last")).select(*keys, "_last.*")


def order_with_missing(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages in the order of ``ids(document_id, page_id, position)``; unlisted ones keep their order after.

    A page listed twice stands at its last position.
    """
    listed = ids.groupBy(F.col("page_id").alias("id"), "document_id").agg(F.max("position").cast("long").alias("_at"))
    joined = pages.join(listed, ["document_id", "id"], "left")
    unlisted = F.col("_at").isNull()
    bucket = F.struct(
        unlisted.alias("late"),
        scale.span_bucket(F.coalesce(F.col("_at"), F.col("sort_order").cast("long"))).alias("span"),
    )
    order = [unlisted.asc(), F.coalesce(F.col("_at"), F.col("sort_order").cast("long")), "id"]
    return scale.number_rows(joined, ["document_id"], bucket, order, "resolved_order").drop("_at")


def cascade_delete(documents: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return (
        documents.join(gone, "id", "left_anti"),
        pages.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti"),
    )


# --- edits against saved pages -----------------------------------------------------------------


def unsaved_edits(edits: DataFrame, saved: DataFrame) -> DataFrame:
    """Flag edits that differ from the saved page; an edit whose page is gone does not count."""
    before = saved.select(
        F.col("id").alias("page_id"), F.col("filter_name").alias("_f"), F.col("rotation_degrees").alias("_r")
    )
    differs = (F.col("filter_name") != F.col("_f")) | (F.col("rotation_degrees") != F.col("_r"))
    return (
        edits.join(before, "page_id", "left")
        .withColumn("has_unsaved", F.coalesce(differs, F.lit(False)))
        .drop("_f", "_r")
    )


def refresh_edits(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Take image and large preview from the catalogue, keep filter and rotation of the edit."""
    current = pages.select(
        F.col("id").alias("page_id"),
        F.col("image_path").alias("_image"),
        F.col("large_preview_path").alias("_large"),
        F.lit(True).alias("_found"),
    )
    return (
        edits.join(current, "page_id", "left")
        .withColumns(
            {
                "image_path": F.coalesce("_image", "image_path"),
                "large_preview_path": F.when(F.col("_found"), F.col("_large")).otherwise(F.col("large_preview_path")),
            }
        )
        .drop("_image", "_large", "_found")
    )


def document_dirty(edits: DataFrame, saved: DataFrame) -> DataFrame:
    """A document is dirty when its lists differ in length or in any filter/rotation by position."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        numbered = number_pages(df, "_pos")
        return numbered.select(
            "document_id",
            "_pos",
            F.col("filter_name").alias(f"_f{tag}"),
            F.col("rotation_degrees").alias(f"_r{tag}"),
            F.lit(1).alias(f"_has{tag}"),
        )

    both = side(edits, "a").join(side(saved, "b"), ["document_id", "_pos"], "full")
    differs = (
        F.col("_hasa").isNull()
        | F.col("_hasb").isNull()
        | ~F.col("_fa").eqNullSafe(F.col("_fb"))
        | ~F.col("_ra").eqNullSafe(F.col("_rb"))
    )
    return both.groupBy("document_id").agg(F.bool_or(differs).alias("is_dirty"))
