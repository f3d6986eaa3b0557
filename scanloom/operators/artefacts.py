"""Keeping preview files consistent with the catalogue: what to make, what to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import scale
from scanloom.functions.geometry import center_square, fit_dims, sample_size
from scanloom.functions.text import request_key, working_key, working_prefix
from scanloom.operators.catalog import last_per_key

# Cache limit, kept share, preview sizes and qualities.
WORKING_CACHE_BYTES = 100 * 1024 * 1024
WORKING_CACHE_KEEP = 0.8
SMALL_SIDE, SMALL_QUALITY = 200, 85
LARGE_SIDE, LARGE_QUALITY = 1600, 90
FIT_SMALL_SIDE, FIT_QUALITY = 160, 82


def with_exists(df: DataFrame, name: str, kind: str, inventory: DataFrame, flag: str) -> DataFrame:
    """Whether the named file is in the inventory; false for a NULL name."""
    files = (
        inventory.filter(F.col("kind") == kind)
        .select(F.col("file_name").alias(name), F.lit(0).alias("_salt"), F.lit(True).alias("_present"))
        .distinct()
    )
    # Missing names would all hash to one partition; the salt spreads them and they match nothing.
    salt = F.when(F.col(name).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(256))).otherwise(0).cast("int")
    return (
        df.withColumn("_salt", salt)
        .join(files, [name, "_salt"], "left")
        .withColumn(flag, F.coalesce("_present", F.lit(False)))
        .select(*df.columns, flag)
    )


def total_size(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("cache_id", "kind").agg(
        F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("files")
    )


def working_files_of(pages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Working files named ``{page id}_…``: the id is parsed out, so this is an equi-join."""
    files = inventory.filter(F.col("kind") == "working").select(
        "file_name", F.expr("try_cast(substring_index(file_name, '_', 1) AS BIGINT)").alias("page_id")
    )
    return pages.select(F.col("id").alias("page_id")).join(files, "page_id")


def working_files_by_prefix(sources: DataFrame, inventory: DataFrame) -> DataFrame:
    """Working files whose name starts with the sanitised stem of ``sources(image_path)``.

    One stem may be a prefix of another, so matches can overlap, as they do for a plain prefix test.
    A name's prefixes of the lengths that stems have become keys of an equi-join, as hashes of 64 bits; the
    letters are compared where two hashes meet.
    """
    stems = sources.select(working_prefix(F.col("image_path")).alias("stem")).distinct()
    # One row, of as many numbers as stems differ in length.
    lengths = stems.agg(F.collect_set(F.length("stem")).alias("_lengths"))
    prefix = lambda n: F.substring(F.col("file_name"), F.lit(1), n)
    names = inventory.filter(F.col("kind") == "working").select("file_name").crossJoin(lengths)
    files = names.select(
        "file_name", F.explode(F.filter("_lengths", lambda n: (n >= 1) & (n <= F.length("file_name")))).alias("_n")
    ).select("file_name", F.xxhash64(prefix(F.col("_n"))).alias("_hash"))
    met = stems.withColumn("_hash", F.xxhash64("stem")).join(files, "_hash")
    return met.filter(F.col("stem") == prefix(F.length("stem"))).select("stem", "file_name")


def eviction_plan(
    inventory: DataFrame, limit: int = WORKING_CACHE_BYTES, keep: float = WORKING_CACHE_KEEP
) -> DataFrame:
    """Which working files go, oldest first, when a cache exceeds its limit.

    A file goes when what is still held before it exceeds the kept share. The running total is
    bucketed by age, so one cache holding every file is still spread over many tasks.
    """
    working = inventory.filter(F.col("kind") == "working")
    totals = working.groupBy("cache_id").agg(F.sum("size").alias("_total"))
    age = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("mtime"))
    running = scale.prefix_sum(
        working, ["cache_id"], scale.span_bucket(age, 3600), ["mtime", "file_name"],
        F.col("size"), "_freed", inclusive=False,
    )
    target = int(limit * keep)
    over = F.col("_total") > limit
    return running.join(totals, "cache_id").select(
        "cache_id",
        "file_name",
        "size",
        "mtime",
        (over & (F.col("_total") - F.col("_freed") > target)).alias("evict"),
    )


def needs_regeneration(pages: DataFrame, inventory: DataFrame) -> DataFrame:
    both = with_exists(pages, "small_preview_path", "small", inventory, "has_small")
    both = with_exists(both, "large_preview_path", "large", inventory, "has_large")
    return both.withColumn("needs_regeneration", ~F.col("has_small") | ~F.col("has_large"))


def preview_jobs(pages: DataFrame) -> DataFrame:
    """One job per page and missing preview type."""
    types = F.filter(
        F.array(
            F.struct(F.lit("small").alias("type"), F.col("small_preview_path").alias("path")),
            F.struct(F.lit("large").alias("type"), F.col("large_preview_path").alias("path")),
        ),
        lambda t: t["path"].isNull(),
    )
    return (
        pages.withColumn("_job", F.explode(types))
        .select(
            F.col("id").alias("page_id"), F.col("_job.type").alias("type"),
            "image_path", "filter_name", "rotation_degrees",
        )
    )


def job_outcomes(jobs: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """SUCCESS, FAILURE or RETRY per ``jobs(page_id, type, io_error)`` given ``sources(image_path)``."""
    known = pages.select(
        F.col("id").alias("page_id"), "image_path", "small_preview_path", "large_preview_path",
        F.lit(True).alias("_page"),
    )
    present = sources.select("image_path").distinct().withColumn("_source", F.lit(True))
    joined = jobs.join(known.join(present, "image_path", "left"), "page_id", "left")
    kind = F.col("type")
    done = F.when(kind == "small", F.col("small_preview_path").isNotNull()).when(
        kind == "large", F.col("large_preview_path").isNotNull()
    )
    outcome = (
        F.when(F.col("_page").isNull() | kind.isNull() | ~kind.isin("small", "large"), "FAILURE")
        .when(done, "SUCCESS")
        .when(F.col("_source").isNull(), F.when(kind == "small", "FAILURE").otherwise("RETRY"))
        .when(F.col("io_error"), "RETRY")
        .otherwise("SUCCESS")
    )
    return joined.select("page_id", "type", outcome.alias("outcome"))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """One row per render key, with how many requests it answers and the first of them."""
    key = request_key(F.col("image_path"), F.col("filter_name"), F.col("rotation_degrees"))
    return requests.groupBy(key.alias("request_key")).agg(
        F.count(F.lit(1)).alias("requests"), F.min("request_id").alias("first_request")
    )


def reconcile(pages: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store ``results(page_id, new_small, new_large, failed)``; list replaced files for deletion.

    A failed render clears both paths and deletes nothing.
    """
    columns = pages.columns
    last = last_per_key(results, ["page_id"])
    joined = pages.join(last.withColumnRenamed("page_id", "id").withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    ok = hit & ~F.coalesce("failed", F.lit(False))

    def path(old: str, new: str) -> Column:
        return F.when(~hit, F.col(old)).when(ok, F.col(new))

    stored = joined.withColumns(
        {
            "small_preview_path": path("small_preview_path", "new_small"),
            "large_preview_path": path("large_preview_path", "new_large"),
        }
    ).select(*columns)
    replaced = F.filter(
        F.array(
            F.struct(F.lit("small").alias("kind"), F.col("small_preview_path").alias("old"), F.col("new_small").alias("new")),
            F.struct(F.lit("large").alias("kind"), F.col("large_preview_path").alias("old"), F.col("new_large").alias("new")),
        ),
        lambda f: f["old"].isNotNull() & (f["old"] != f["new"]),
    )
    deletes = (
        joined.filter(ok)
        .withColumn("_f", F.explode(replaced))
        .select(F.col("id").alias("page_id"), F.col("_f.kind").alias("kind"), F.col("_f.old").alias("file_name"))
    )
    return stored, deletes


def swap_applied_previews(pages: DataFrame, new_paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace both previews of ``new_paths(page_id, new_small, new_large)``; every old file goes."""
    columns = pages.columns
    last = last_per_key(new_paths, ["page_id"])
    joined = pages.join(last.withColumnRenamed("page_id", "id").withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    swapped = joined.withColumns(
        {
            "small_preview_path": F.when(hit, F.col("new_small")).otherwise(F.col("small_preview_path")),
            "large_preview_path": F.when(hit, F.col("new_large")).otherwise(F.col("large_preview_path")),
        }
    ).select(*columns)
    olds = F.array(
        F.struct(F.lit("small").alias("kind"), F.col("small_preview_path").alias("old")),
        F.struct(F.lit("large").alias("kind"), F.col("large_preview_path").alias("old")),
    )
    deletes = (
        joined.filter(hit)
        .withColumn("_f", F.explode(F.filter(olds, lambda f: f["old"].isNotNull())))
        .select(F.col("id").alias("page_id"), F.col("_f.kind").alias("kind"), F.col("_f.old").alias("file_name"))
    )
    return swapped, deletes


def preview_geometry(pages: DataFrame, mode: str = "crop") -> DataFrame:
    """Sizes of both previews. ``crop``: square small preview; ``fit``: both scaled to fit."""
    w, h = F.col("img_w"), F.col("img_h")
    if mode == "crop":
        box = center_square(w, h)
        large = fit_dims(w, h, LARGE_SIDE)
        small_w, small_h, quality = F.lit(SMALL_SIDE), F.lit(SMALL_SIDE), (SMALL_QUALITY, LARGE_QUALITY)
        extra = [
            box["side"].alias("crop_side"), box["left"].alias("crop_left"), box["top"].alias("crop_top"),
            sample_size(w, h, F.lit(SMALL_SIDE)).alias("small_sample"),
            sample_size(w, h, F.lit(LARGE_SIDE)).alias("large_sample"),
        ]
    else:
        small, large = fit_dims(w, h, FIT_SMALL_SIDE), fit_dims(w, h, LARGE_SIDE)
        small_w, small_h, quality = small["w"], small["h"], (FIT_QUALITY, FIT_QUALITY)
        extra = []
    return pages.select(
        F.col("id").alias("page_id"),
        small_w.cast("int").alias("small_w"), small_h.cast("int").alias("small_h"),
        large["w"].alias("large_w"), large["h"].alias("large_h"),
        F.lit(quality[0]).alias("small_quality"), F.lit(quality[1]).alias("large_quality"),
        *extra,
    )


def stale_working(edits: DataFrame, saved: DataFrame, inventory: DataFrame) -> DataFrame:
    """Working files of pages whose edit equals the saved state."""
    before = saved.select(
        F.col("id").alias("page_id"), F.col("filter_name").alias("_f"), F.col("rotation_degrees").alias("_r")
    )
    settled = edits.join(before, "page_id").filter(
        (F.col("filter_name") == F.col("_f")) & (F.col("rotation_degrees") == F.col("_r"))
    )
    return working_files_of(settled.select(F.col("page_id").alias("id")), inventory)


def asset_deletes(pages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every file that belongs to the given pages; NULL names are dropped."""
    named = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("image_path").alias("file_name")),
        F.struct(F.lit("small").alias("kind"), F.col("small_preview_path").alias("file_name")),
        F.struct(F.lit("large").alias("kind"), F.col("large_preview_path").alias("file_name")),
    )
    listed = (
        pages.withColumn("_f", F.explode(named))
        .select(F.col("id").alias("page_id"), "_f.kind", "_f.file_name")
        .filter(F.col("file_name").isNotNull())
    )
    working = working_files_of(pages, inventory).select("page_id", F.lit("working").alias("kind"), "file_name")
    return listed.unionByName(working)


def manifest_filter_grid(manifest: DataFrame, filters: list[str], sources: DataFrame) -> DataFrame:
    """Each manifest entry with each selected filter, skipping entries whose step-1 image is missing."""
    present = sources.select(F.col("path").alias("step1")).distinct()
    key = F.explode(F.array(*[F.lit(f) for f in sorted(filters)]))
    return (
        manifest.join(present, "step1", "left_semi")
        .withColumn("filter_key", key)
        .select("id", "step1", "filter_key", F.element_at("filters", F.col("filter_key")).alias("out_path"))
    )
