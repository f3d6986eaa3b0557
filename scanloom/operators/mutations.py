"""Catalogue mutations as pure functions over whole tables.

Each takes the current tables and a table of commands and returns the next tables; nothing is
updated in place. Where several commands hit one row, the one with the highest ``seq`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import scale
from scanloom.functions.text import default_name, trim
from scanloom.operators.artefacts import asset_deletes, with_exists
from scanloom.operators.catalog import last_per_key, number_pages, renumber, with_page_defaults


def touch(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Advance ``updated_at`` to the latest change per document: ``changed(document_id, ts)``."""
    latest = changed.groupBy(F.col("document_id").alias("id")).agg(F.max("ts").alias("_ts"))
    return documents.join(latest, "id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_ts")
    ).drop("_ts")


def _at(changed: DataFrame, now: Column) -> DataFrame:
    return changed.select("document_id", now.alias("ts"))


def create_documents(documents: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Insert ``new(id, name?)``; a missing name becomes the dated default."""
    rows = new.select(
        "id",
        F.coalesce(F.col("name"), default_name(now)).alias("name"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return documents.unionByName(rows)


def rename(documents: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """``commands(document_id, name, seq)``: names are trimmed, blank ones ignored."""
    wanted = (
        commands.withColumn("name", trim(F.col("name")))
        .filter(F.length("name") > 0)
        .groupBy(F.col("document_id").alias("id"))
        .agg(F.max_by("name", F.struct("seq", "name")).alias("_name"))
    )
    return documents.join(wanted, "id", "left").select(
        "id",
        F.coalesce("_name", "name").alias("name"),
        "created_at",
        F.when(F.col("_name").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def delete_documents(
    documents: DataFrame, pages: DataFrame, ids: DataFrame, inventory: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining documents, remaining pages and the files to delete."""
    gone = ids.select("id").distinct()
    by_document = gone.withColumnRenamed("id", "document_id")
    doomed = pages.join(by_document, "document_id", "left_semi")
    return (
        documents.join(gone, "id", "left_anti"),
        pages.join(by_document, "document_id", "left_anti"),
        asset_deletes(doomed, inventory),
    )


def append_order(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Sort order of ``new(id, document_id, capture_index)``: current page count + capture position."""
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("_count"))
    numbered = scale.number_rows(
        new, ["document_id"], scale.span_bucket(F.col("capture_index")), ["capture_index", "id"], "_pos"
    )
    return (
        numbered.join(counts, "document_id", "left")
        .withColumn("sort_order", (F.coalesce("_count", F.lit(0)) + F.col("_pos")).cast("int"))
        .drop("_count", "_pos")
    )


def add_pages(
    documents: DataFrame, pages: DataFrame, new: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    placed = with_page_defaults(append_order(pages, new)).select(*pages.columns)
    return touch(documents, _at(new, now)), pages.unionByName(placed)


def replace_pages(
    documents: DataFrame, pages: DataFrame, commands: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``commands(page_id, image_path, seq)``: new image, previews reset, filter and rotation kept."""
    columns = pages.columns
    latest = commands.groupBy(F.col("page_id").alias("id")).agg(F.max_by("image_path", F.struct("seq", "image_path")).alias("_image"))
    joined = pages.join(latest, "id", "left")
    hit = F.col("_image").isNotNull()
    replaced = joined.withColumns(
        {
            "image_path": F.coalesce("_image", "image_path"),
            "small_preview_path": F.when(~hit, F.col("small_preview_path")),
            "large_preview_path": F.when(~hit, F.col("large_preview_path")),
        }
    ).select(*columns)
    return touch(documents, _at(joined.filter(hit), now)), replaced


def delete_pages(
    documents: DataFrame, pages: DataFrame, targets: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``targets(page_id, document_id)``: the document is renumbered and touched even if the page was absent.

    Only documents named by a target are renumbered; other pages pass through unshuffled by order.
    """
    columns = pages.columns
    named = targets.select("document_id").distinct()
    left = pages.join(targets.select(F.col("page_id").alias("id")).distinct(), "id", "left_anti")
    affected = left.join(named, "document_id", "left_semi")
    untouched = left.join(named, "document_id", "left_anti")
    return (
        touch(documents, _at(targets, now)),
        renumber(affected.select(*columns)).unionByName(untouched.select(*columns)),
    )


def reorder(
    documents: DataFrame, pages: DataFrame, orders: DataFrame, now: Column, same_document: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``orders(document_id, page_id, position)``: listed pages take their index, others keep theirs.

    A page listed twice takes its last index.     ``same_document=False`` also moves pages listed under a document they do not belong to.
    """
    columns = pages.columns
    listed = orders.withColumnRenamed("page_id", "id")
    keys = ["document_id", "id"] if same_document else ["id"]
    last = listed.groupBy(*keys).agg(F.max("position").cast("int").alias("_to"))
    joined = pages.join(last, keys, "left")
    moved = joined.withColumn("sort_order", F.coalesce("_to", "sort_order")).select(*columns)
    return touch(documents, _at(orders, now)), moved


def move(
    documents: DataFrame, pages: DataFrame, commands: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``commands(document_id, source, destination, seq?)``, the last per document: take a page out, put it back elsewhere.

    Out-of-range and no-op moves leave the document alone. The pages between source and destination
    shift by one, so no list is ever built.
    """
    columns = pages.columns
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    src, dst, pos = F.col("source"), F.col("destination"), F.col("_pos")
    valid = last_per_key(commands, ["document_id"]).join(counts, "document_id").filter(
        src.between(0, F.col("_n") - 1) & dst.between(0, F.col("_n") - 1) & (src != dst)
    )
    numbered = number_pages(pages, "_pos").join(valid.drop("_n"), "document_id", "left")
    shifted = (
        F.when(src.isNull(), F.col("sort_order").cast("long"))
        .when(pos == src, dst.cast("long"))
        .when((pos > src) & (pos <= dst), pos - 1)
        .when((pos >= dst) & (pos < src), pos + 1)
        .otherwise(pos)
    )
    moved = numbered.withColumn("sort_order", shifted.cast("int")).select(*columns)
    return touch(documents, _at(valid, now)), moved


def _set_by_page(documents, pages, commands, now, column: str) -> tuple[DataFrame, DataFrame]:
    columns = pages.columns
    latest = commands.groupBy(F.col("page_id").alias("id")).agg(F.max_by(column, F.struct("seq", column)).alias("_new"))
    joined = pages.join(latest, "id", "left")
    updated = joined.withColumn(column, F.coalesce("_new", column)).select(*columns)
    return touch(documents, _at(joined.filter("_new IS NOT NULL"), now)), updated


def set_filter(documents: DataFrame, pages: DataFrame, commands: DataFrame, now: Column):
    """``commands(page_id, filter_name, seq)``."""
    return _set_by_page(documents, pages, commands, now, "filter_name")


def set_rotation(documents: DataFrame, pages: DataFrame, commands: DataFrame, now: Column):
    """``commands(page_id, rotation_degrees, seq)``."""
    return _set_by_page(documents, pages, commands, now, "rotation_degrees")


def set_document_filter(documents: DataFrame, pages: DataFrame, commands: DataFrame, now: Column):
    """``commands(document_id, filter_name, seq)`` for every page of the document."""
    columns = pages.columns
    latest = commands.groupBy("document_id").agg(F.max_by("filter_name", F.struct("seq", "filter_name")).alias("_new"))
    updated = pages.join(latest, "document_id", "left").withColumn(
        "filter_name", F.coalesce("_new", "filter_name")
    )
    return touch(documents, _at(commands, now)), updated.select(*columns)


def apply_edits(
    documents: DataFrame, pages: DataFrame, edits: DataFrame, inventory: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write ``edits(page_id, filter_name, rotation_degrees, seq?)``; also return the pages to render again.

    A page is rendered again when its edit changed something or one of its previews is missing.
    """
    columns = pages.columns
    wanted = last_per_key(edits, ["page_id"]).select(
        F.col("page_id").alias("id"), F.col("filter_name").alias("_f"), F.col("rotation_degrees").alias("_r")
    )
    edited = pages.join(wanted, "id").withColumn(
        "changed", (F.col("filter_name") != F.col("_f")) | (F.col("rotation_degrees") != F.col("_r"))
    )
    checked = with_exists(edited, "small_preview_path", "small", inventory, "has_small")
    checked = with_exists(checked, "large_preview_path", "large", inventory, "has_large")
    jobs = checked.filter(F.col("changed") | ~F.col("has_small") | ~F.col("has_large")).select(
        F.col("id").alias("page_id"),
        "image_path",
        F.col("_f").alias("filter_name"),
        F.col("_r").alias("rotation_degrees"),
        "changed",
    )
    updated = pages.join(wanted, "id", "left").withColumns(
        {"filter_name": F.coalesce("_f", "filter_name"), "rotation_degrees": F.coalesce("_r", "rotation_degrees")}
    )
    return touch(documents, _at(edited, now)), updated.select(*columns), jobs
