"""Export queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import export as ex
from scanloom.plans import fixtures as fx
from scanloom.plans.catalogue import PRESET_NAME_SQL, PRESET_SQL
from scanloom.plans.fixtures import CATALOGUE
from scanloom.registry import query

A4P, A4L = "(210.0::double/297.0)", "(297.0::double/210.0)"
P4P, P4L = "(595.28::double/841.89)", "(841.89::double/595.28)"


def _images(spark, sf):
    """Decodable images: those of pages that do not use the 'magic' filter."""
    p = fx.pages(spark, sf, with_dims=True).filter(F.col("filter_name") != "magic")
    return p.groupBy("image_path").agg(F.min("img_w").alias("img_w"), F.min("img_h").alias("img_h"))


def _manifest_sql(w: str, h: str) -> str:
    return CATALOGUE + f""", img AS (SELECT image_path, min(img_w) AS iw, min(img_h) AS ih FROM scan_pages
  WHERE filter_name <> 'magic' GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sort_order, id) AS page_number FROM scan_pages),
o AS (SELECT n.*, d.name, CASE WHEN rotation_degrees IN (90, 270) THEN ih ELSE iw END AS out_w,
  CASE WHEN rotation_degrees IN (90, 270) THEN iw ELSE ih END AS out_h
  FROM n JOIN img USING (image_path) JOIN scan_documents d ON d.id = n.document_id),
r AS (SELECT *, out_w::double / out_h AS ratio FROM o),
s AS (SELECT *, {w} AS page_w, {h} AS page_h FROM r),
t AS (SELECT *, least(page_w::double / out_w, page_h::double / out_h) AS sc FROM s)
SELECT document_id, concat(regexp_replace(name, '[/\\\\:*?"<>|]', '_', 'g'), '.pdf') AS file_name, id AS page_id, page_number,
  image_path, {PRESET_SQL.format(c='filter_name')} AS filter_name, rotation_degrees, out_w, out_h,
  floor((page_w)*1e8 + 0.5)/1e8 AS page_w, floor((page_h)*1e8 + 0.5)/1e8 AS page_h, floor((sc)*1e8 + 0.5)/1e8 AS scale,
  floor(((page_w - out_w * sc) / 2)*1e8 + 0.5)/1e8 AS dx, floor(((page_h - out_h * sc) / 2)*1e8 + 0.5)/1e8 AS dy FROM t"""


def _rounded(df):
    return df.withColumns({c: F.floor(F.col(c).cast("double") * 1e8 + 0.5) / 1e8 for c in ("page_w", "page_h", "scale", "dx", "dy")})


@query("export_manifest", _manifest_sql(
    f"""(CASE WHEN abs(ratio-{A4P})/{A4P} <= 0.2 THEN 595 WHEN abs(ratio-{A4L})/{A4L} <= 0.2 OR ratio >= 1 THEN 842
      ELSE greatest(1, floor(842*ratio + 0.5)) END)::double""",
    f"""(CASE WHEN abs(ratio-{A4P})/{A4P} <= 0.2 THEN 842 WHEN abs(ratio-{A4L})/{A4L} <= 0.2 THEN 595
      WHEN ratio >= 1 THEN greatest(1, floor(842/ratio + 0.5)) ELSE 842 END)::double"""))
def export_manifest(spark, sf):
    return _rounded(ex.export_manifest(fx.documents(spark, sf), fx.pages(spark, sf), _images(spark, sf)))


@query("export_manifest_points", _manifest_sql(
    f"""(CASE WHEN abs(ratio-{P4P})/{P4P} <= 0.2 THEN 595.28::double
      WHEN abs(ratio-{P4L})/{P4L} <= 0.2 OR ratio >= 1 THEN 841.89::double ELSE 841.89::double*ratio END)""",
    f"""(CASE WHEN abs(ratio-{P4P})/{P4P} <= 0.2 THEN 841.89::double WHEN abs(ratio-{P4L})/{P4L} <= 0.2 THEN 595.28::double
      WHEN ratio >= 1 THEN 841.89::double/ratio ELSE 841.89::double END)"""))
def export_manifest_points(spark, sf):
    return _rounded(ex.export_manifest(fx.documents(spark, sf), fx.pages(spark, sf), _images(spark, sf), "points"))


@query("export_sources", CATALOGUE + f"""
SELECT id AS page_id, image_path, {PRESET_SQL.format(c='filter_name')} AS filter_name,
  cast(((rotation_degrees % 360) + 360) % 360 AS int) AS rotation_degrees FROM scan_pages""")
def export_sources(spark, sf):
    return ex.export_sources(fx.pages(spark, sf))


@query("export_progress", CATALOGUE + f""",
n AS (SELECT id, document_id, {PRESET_SQL.format(c='filter_name')} AS f, row_number() OVER w AS k,
  count(*) OVER (PARTITION BY document_id) AS total FROM scan_pages WINDOW w AS (PARTITION BY document_id ORDER BY sort_order, id))
SELECT document_id, k AS step, 'rendering' AS phase, k AS current, total, id AS page_id,
  concat(k::varchar, ' / ', total::varchar, 'ページを', CASE WHEN f = 'original' THEN '' ELSE concat({PRESET_NAME_SQL.format(k='f')}, 'で') END, '処理中…') AS message,
  k::double / total AS fraction, k::double / total AS ratio FROM n
UNION ALL SELECT document_id, 0, 'preparing', 0, total, id, concat(total::varchar, 'ページのPDFを準備中…'), 0.0, 0.0 FROM n WHERE k = 1
UNION ALL SELECT document_id, total + 1, 'finalizing', total, total, id, concat(total::varchar, 'ページのPDFを書き出し中…'), 1.0, 1.0 FROM n WHERE k = total""")
def export_progress(spark, sf):
    return ex.export_progress(fx.pages(spark, sf))
