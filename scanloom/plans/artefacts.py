"""Preview maintenance queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.text import preview_base_name
from scanloom.operators import artefacts as art
from scanloom.plans import fixtures as fx
from scanloom.plans.catalogue import EDITS, edits_of
from scanloom.plans.fixtures import ARTEFACTS, CATALOGUE
from scanloom.registry import query

HAS = "EXISTS (SELECT 1 FROM file_inventory f WHERE f.kind = '{k}' AND f.file_name = p.{k}_preview_path)"


@query("file_inventory", ARTEFACTS + "SELECT * FROM file_inventory")
def file_inventory(spark, sf):
    return fx.inventory(spark, sf)


@query("total_size", ARTEFACTS + """
SELECT cache_id, kind, cast(sum(size) AS bigint) AS total_bytes, count(*) AS files FROM file_inventory GROUP BY 1, 2""")
def total_size(spark, sf):
    return art.total_size(fx.inventory(spark, sf))


@query("page_preview_exists", ARTEFACTS + f"SELECT p.id, {HAS.format(k='small')} AS has_small FROM scan_pages p")
def page_preview_exists(spark, sf):
    p = fx.pages(spark, sf).select("id", "small_preview_path")
    return art.with_exists(p, "small_preview_path", "small", fx.inventory(spark, sf), "has_small").select("id", "has_small")


@query("pages_without_preview", ARTEFACTS + f"SELECT p.id FROM scan_pages p WHERE NOT {HAS.format(k='large')}")
def pages_without_preview(spark, sf):
    p = fx.pages(spark, sf).select("id", "large_preview_path")
    found = art.with_exists(p, "large_preview_path", "large", fx.inventory(spark, sf), "has_large")
    return found.filter(~F.col("has_large")).select("id")


@query("working_files_by_page", ARTEFACTS + """
SELECT p.id AS page_id, f.file_name FROM scan_pages p JOIN file_inventory f
ON f.kind = 'working' AND starts_with(f.file_name, concat(p.id::varchar, '_'))""".replace(
    "starts_with(f.file_name, concat(p.id::varchar, '_'))", "split_part(f.file_name, '_', 1) = p.id::varchar"))
def working_files_by_page(spark, sf):
    return art.working_files_of(fx.pages(spark, sf), fx.inventory(spark, sf))


def prefixed_files(spark, sf):
    """Working files named after the source image, as the other naming scheme does."""
    return fx.pages(spark, sf).filter(F.col("small_preview_path").isNull()).select(
        F.lit("working").alias("kind"),
        F.concat(preview_base_name(F.col("image_path")), F.lit("_"), F.col("id").cast("string"), F.lit(".jpg")).alias("file_name"),
    )


@query("working_files_by_prefix", CATALOGUE + """,
stems AS (SELECT DISTINCT regexp_replace(image_path, '\\.jpg$', '') AS stem FROM scan_pages),
files AS (SELECT concat(regexp_replace(image_path, '\\.jpg$', ''), '_', id::varchar, '.jpg') AS file_name
  FROM scan_pages WHERE small_preview_path IS NULL)
SELECT s.stem, f.file_name FROM files f, range(1, 64) n(k), stems s
WHERE n.k <= length(f.file_name) AND s.stem = substr(f.file_name, 1, n.k)""")
def working_files_by_prefix(spark, sf):
    return art.working_files_by_prefix(fx.pages(spark, sf), prefixed_files(spark, sf))


@query("eviction_plan", ARTEFACTS + """, w AS (SELECT *, sum(size) OVER () AS total,
  coalesce(sum(size) OVER (ORDER BY mtime, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM file_inventory WHERE kind = 'working')
SELECT cache_id, file_name, size, mtime, total > 104857600 AND total - freed > 83886080 AS evict FROM w""")
def eviction_plan(spark, sf):
    return art.eviction_plan(fx.inventory(spark, sf))


@query("needs_regeneration", ARTEFACTS + f"""
SELECT id, has_small, has_large, NOT has_small OR NOT has_large AS needs_regeneration FROM (
  SELECT p.id, {HAS.format(k='small')} AS has_small, {HAS.format(k='large')} AS has_large FROM scan_pages p) t""")
def needs_regeneration(spark, sf):
    found = art.needs_regeneration(
        fx.pages(spark, sf).select("id", "small_preview_path", "large_preview_path"), fx.inventory(spark, sf)
    )
    return found.select("id", "has_small", "has_large", "needs_regeneration")


@query("preview_jobs", CATALOGUE + """
SELECT id AS page_id, 'small' AS type, image_path, filter_name, rotation_degrees FROM scan_pages WHERE small_preview_path IS NULL
UNION ALL SELECT id, 'large', image_path, filter_name, rotation_degrees FROM scan_pages WHERE large_preview_path IS NULL""")
def preview_jobs(spark, sf):
    return art.preview_jobs(fx.pages(spark, sf))


def jobs_with_faults(spark, sf):
    """Jobs of every page, with unknown pages, odd types and I/O errors mixed in by line attributes."""
    lines = fx.pages(spark, sf)
    return lines.select(
        F.when(F.col("filter_name") == "legacy", F.col("id") + 900000000000).otherwise(F.col("id")).alias("page_id"),
        F.explode(F.array(F.lit("small"), F.lit("large"), F.lit("huge"))).alias("type"),
        (F.col("rotation_degrees") == 90).alias("io_error"),
    )


@query("job_outcomes", CATALOGUE + """,
jobs AS (SELECT CASE WHEN filter_name = 'legacy' THEN id + 900000000000 ELSE id END AS page_id, t.type,
  rotation_degrees = 90 AS io_error FROM scan_pages, (VALUES ('small'), ('large'), ('huge')) t(type)),
src AS (SELECT DISTINCT image_path FROM scan_pages WHERE filter_name <> 'magic')
SELECT j.page_id, j.type, CASE
  WHEN p.id IS NULL OR j.type NOT IN ('small', 'large') THEN 'FAILURE'
  WHEN j.type = 'small' AND p.small_preview_path IS NOT NULL THEN 'SUCCESS'
  WHEN j.type = 'large' AND p.large_preview_path IS NOT NULL THEN 'SUCCESS'
  WHEN s.image_path IS NULL THEN CASE j.type WHEN 'small' THEN 'FAILURE' ELSE 'RETRY' END
  WHEN j.io_error THEN 'RETRY' ELSE 'SUCCESS' END AS outcome
FROM jobs j LEFT JOIN scan_pages p ON p.id = j.page_id LEFT JOIN src s ON s.image_path = p.image_path""")
def job_outcomes(spark, sf):
    p = fx.pages(spark, sf)
    sources = p.filter(F.col("filter_name") != "magic").select("image_path")
    return art.job_outcomes(jobs_with_faults(spark, sf), p, sources)


@query("dedupe_requests", CATALOGUE + """
SELECT concat(image_path, '|', filter_name, '|', rotation_degrees::varchar, '|persisted') AS request_key,
  count(*) AS requests, min(id) AS first_request FROM scan_pages GROUP BY 1""")
def dedupe_requests(spark, sf):
    return art.dedupe_requests(fx.pages(spark, sf).withColumnRenamed("id", "request_id"))


@query("reconcile_previews", CATALOGUE + """,
res AS (SELECT id, CASE WHEN filter_name = 'bw' THEN small_preview_path ELSE concat('ns_', id::varchar) END AS ns,
  concat('nl_', id::varchar) AS nl, filter_name = 'magic' AS failed FROM scan_pages WHERE filter_name <> 'legacy'),
j AS (SELECT p.*, r.id IS NOT NULL AS hit, r.ns, r.nl, coalesce(r.failed, false) AS failed
  FROM scan_pages p LEFT JOIN res r ON r.id = p.id)
SELECT 'page' AS what, id, CASE WHEN NOT hit THEN small_preview_path WHEN NOT failed THEN ns END AS small,
  CASE WHEN NOT hit THEN large_preview_path WHEN NOT failed THEN nl END AS large FROM j
UNION ALL SELECT 'delete', id, small_preview_path, NULL FROM j WHERE hit AND NOT failed AND small_preview_path IS NOT NULL AND small_preview_path <> ns
UNION ALL SELECT 'delete', id, NULL, large_preview_path FROM j WHERE hit AND NOT failed AND large_preview_path IS NOT NULL""")
def reconcile_previews(spark, sf):
    p = fx.pages(spark, sf)
    name = lambda tag: F.concat(F.lit(tag), F.col("id").cast("string"))
    results = p.filter(F.col("filter_name") != "legacy").select(
        F.col("id").alias("page_id"),
        F.when(F.col("filter_name") == "bw", F.col("small_preview_path")).otherwise(name("ns_")).alias("new_small"),
        name("nl_").alias("new_large"),
        (F.col("filter_name") == "magic").alias("failed"),
    )
    return _tables(*art.reconcile(p, results))


def _tables(stored, deletes):
    kept = stored.select(
        F.lit("page").alias("what"), "id", F.col("small_preview_path").alias("small"), F.col("large_preview_path").alias("large")
    )
    gone = deletes.select(
        F.lit("delete").alias("what"),
        F.col("page_id").alias("id"),
        F.when(F.col("kind") == "small", F.col("file_name")).alias("small"),
        F.when(F.col("kind") == "large", F.col("file_name")).alias("large"),
    )
    return kept.unionByName(gone)


@query("swap_applied_previews", CATALOGUE + """,
j AS (SELECT *, filter_name <> 'legacy' AS hit FROM scan_pages)
SELECT 'page' AS what, id, CASE WHEN hit THEN concat('as_', id::varchar) ELSE small_preview_path END AS small,
  CASE WHEN hit THEN concat('al_', id::varchar) ELSE large_preview_path END AS large FROM j
UNION ALL SELECT 'delete', id, small_preview_path, NULL FROM j WHERE hit AND small_preview_path IS NOT NULL
UNION ALL SELECT 'delete', id, NULL, large_preview_path FROM j WHERE hit AND large_preview_path IS NOT NULL""")
def swap_applied_previews(spark, sf):
    p = fx.pages(spark, sf)
    fresh = p.filter(F.col("filter_name") != "legacy").select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("as_"), F.col("id").cast("string")).alias("new_small"),
        F.concat(F.lit("al_"), F.col("id").cast("string")).alias("new_large"),
    )
    return _tables(*art.swap_applied_previews(p, fresh))


SAMPLE_SQL = """(SELECT min(s) FROM (SELECT cast(pow(2, e) AS bigint) AS s FROM range(0, 31) r(e)) q
  WHERE greatest(img_w, img_h) // s <= {m} * 2)"""
ROUND_SQL = "greatest(1, cast(floor({v} + 0.5) AS int))"


def _fit_sql(v: str, m: int) -> str:
    scale = f"(CASE WHEN greatest(img_w, img_h) <= {m} THEN 1.0::double ELSE {m}::double / greatest(img_w, img_h) END)"
    return ROUND_SQL.format(v=f"{v} * {scale}")


@query("preview_geometry_crop", CATALOGUE + f"""
SELECT id AS page_id, 200 AS small_w, 200 AS small_h, {_fit_sql('img_w', 1600)} AS large_w, {_fit_sql('img_h', 1600)} AS large_h,
  85 AS small_quality, 90 AS large_quality, least(img_w, img_h) AS crop_side,
  (img_w - least(img_w, img_h)) // 2 AS crop_left, (img_h - least(img_w, img_h)) // 2 AS crop_top,
  cast(CASE WHEN greatest(img_w, img_h) // 1 <= 400 THEN 1 WHEN greatest(img_w, img_h) // 2 <= 400 THEN 2
    WHEN greatest(img_w, img_h) // 4 <= 400 THEN 4 WHEN greatest(img_w, img_h) // 8 <= 400 THEN 8 ELSE 16 END AS int) AS small_sample,
  cast(CASE WHEN greatest(img_w, img_h) // 1 <= 3200 THEN 1 ELSE 2 END AS int) AS large_sample FROM scan_pages""")
def preview_geometry_crop(spark, sf):
    return art.preview_geometry(fx.pages(spark, sf, with_dims=True), "crop")


@query("preview_geometry_fit", CATALOGUE + f"""
SELECT id AS page_id, {_fit_sql('img_w', 160)} AS small_w, {_fit_sql('img_h', 160)} AS small_h,
  {_fit_sql('img_w', 1600)} AS large_w, {_fit_sql('img_h', 1600)} AS large_h, 82 AS small_quality, 82 AS large_quality FROM scan_pages""")
def preview_geometry_fit(spark, sf):
    return art.preview_geometry(fx.pages(spark, sf, with_dims=True), "fit")


@query("stale_working", ARTEFACTS + f""", {EDITS}
SELECT e.page_id, f.file_name FROM edits e JOIN scan_pages s ON s.id = e.page_id AND s.filter_name = e.filter_name
  AND s.rotation_degrees = e.rotation_degrees
JOIN file_inventory f ON f.kind = 'working' AND cast(split_part(f.file_name, '_', 1) AS bigint) = e.page_id""")
def stale_working(spark, sf):
    p = fx.pages(spark, sf)
    return art.stale_working(edits_of(p).select("page_id", "filter_name", "rotation_degrees"), p, fx.inventory(spark, sf))


def manifest_of(spark, sf):
    """One manifest entry per web page; every page's language-independent URL names its images."""
    key = F.col("page_id").cast("string")
    path = lambda tag: F.concat(F.lit(f"{tag}/"), key, F.lit(".png"))
    return fx.table(spark, sf, "pages").select(
        key.alias("id"), path("step1").alias("step1"), F.length("html").alias("_len"),
        F.create_map(*[v for f in ("sharpen", "bw", "whiteboard", "vivid") for v in (F.lit(f), path(f))]).alias("filters"),
    )


@query("manifest_filter_grid", """
SELECT p.page_id::varchar AS id, concat('step1/', p.page_id::varchar, '.png') AS step1, f.filter_key,
  concat(f.filter_key, '/', p.page_id::varchar, '.png') AS out_path
FROM pages p CROSS JOIN (VALUES ('sharpen'), ('bw'), ('whiteboard'), ('vivid')) f(filter_key)
WHERE length(p.html) > 1500""")
def manifest_filter_grid(spark, sf):
    m = manifest_of(spark, sf)
    sources = m.filter(F.col("_len") > 1500).select(F.col("step1").alias("path"))
    return art.manifest_filter_grid(m.drop("_len"), ["vivid", "sharpen", "whiteboard", "bw"], sources)
