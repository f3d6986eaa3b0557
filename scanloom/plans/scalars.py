"""Scalar functions applied to whole tables, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g, status as st, text as tx
from scanloom.plans import fixtures as fx
from scanloom.plans.artefacts import _fit_sql
from scanloom.plans.exports import A4L, A4P, P4L, P4P
from scanloom.plans.fixtures import CATALOGUE
from scanloom.registry import query
from scanloom.schema import NAME_PREFIX

def sides():
    return F.col("img_w"), F.col("img_h")


def dims(spark, sf):
    return fx.pages(spark, sf, with_dims=True)


def r8(column, name):
    """Eight decimals, half up; written out so that both engines break ties alike."""
    return (F.floor(column * 1e8 + 0.5) / 1e8).alias(name)


def r6(column, name):
    return F.round(column, 6).alias(name)


WS = tx.WHITE_SPACE
NAMED = """CASE doc_id % 5 WHEN 0 THEN chr(12288) || chr(9) WHEN 1 THEN chr(12288) || source || text || chr(8195) || chr(10)
  ELSE source || text END"""


@query("safe_file_name", rf"""
SELECT doc_id, CASE WHEN regexp_matches(c, '^{WS}*$') THEN 'document' ELSE c END AS plain,
  CASE WHEN regexp_matches(t, '^{WS}*$') THEN 'document' ELSE t END AS trimmed
FROM (SELECT doc_id, regexp_replace(n, '[/\\:*?"<>|]', '_', 'g') AS c,
  regexp_replace(regexp_replace(n, '^{WS}+|{WS}+$', '', 'g'), '[/\\:*?"<>|]', '_', 'g') AS t
  FROM (SELECT doc_id, {NAMED} AS n FROM documents) d) q""")
def safe_file_name(spark, sf):
    whole, kind = F.concat("source", "text"), F.col("doc_id") % 5
    # Blank and padded names, with a full-width space, an em space, a tab and a line end.
    name = F.when(kind == 0, "\u3000\t").when(kind == 1, F.concat(F.lit("\u3000"), whole, F.lit("\u2003\n"))).otherwise(whole)
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.safe_file_name(name).alias("plain"), tx.safe_file_name(name, trim_first=True).alias("trimmed")
    )


@query("preview_base_name", r"""
SELECT page_id, CASE WHEN k = '' THEN 'document' ELSE k END AS base FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(url, '(.)\.[^./]*$', '\1'), '[^A-Za-z0-9_-]', '_', 'g'), '_') AS k FROM pages) q""")
def preview_base_name(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.preview_base_name(F.col("url")).alias("base"))


@query("default_names", f"SELECT event_id, concat('{NAME_PREFIX}', strftime(ts, '%Y-%m-%d %H:%M')) AS name FROM events")
def default_names(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tx.default_name(F.col("ts")).alias("name"))


@query("list_labels", CATALOGUE + """
SELECT d.id, concat(count(p.id)::varchar, 'ページ · ', strftime(d.updated_at, '%Y/%m/%d')) AS label
FROM scan_documents d LEFT JOIN scan_pages p ON p.document_id = d.id GROUP BY d.id, d.updated_at""")
def list_labels(spark, sf):
    from scanloom.operators.catalog import document_summary

    summary = document_summary(fx.documents(spark, sf), fx.pages(spark, sf))
    return summary.select("id", tx.list_label(F.col("page_count"), F.col("updated_at")).alias("label"))


@query("rotation", CATALOGUE + """
SELECT id, cast(((d % 360) + 360) % 360 AS int) AS norm, cast((rotation_degrees - 90 + 360) % 360 AS int) AS turned,
  CASE WHEN ((d % 360) + 360) % 360 IN (90, 270) THEN img_h ELSE img_w END AS w,
  CASE WHEN ((d % 360) + 360) % 360 IN (90, 270) THEN img_w ELSE img_h END AS h
FROM (SELECT *, rotation_degrees - 450 * (sort_order % 3) AS d FROM scan_pages) t""")
def rotation(spark, sf):
    W, H = sides()
    d = F.col("rotation_degrees") - 450 * (F.col("sort_order") % 3)
    turned = g.rotated_dims(W, H, d)
    return dims(spark, sf).select(
        "id", g.norm_rotation(d).alias("norm"), g.quarter_left(F.col("rotation_degrees")).alias("turned"),
        turned["w"].alias("w"), turned["h"].alias("h"),
    )


@query("preview_sizes", CATALOGUE + f"""
SELECT id, cast(CASE WHEN m // 1 <= 100 THEN 1 WHEN m // 2 <= 100 THEN 2 WHEN m // 4 <= 100 THEN 4 WHEN m // 8 <= 100 THEN 8
    WHEN m // 16 <= 100 THEN 16 WHEN m // 32 <= 100 THEN 32 ELSE 64 END AS int) AS sample,
  {_fit_sql('img_w', 1600)} AS fit_w, {_fit_sql('img_h', 1600)} AS fit_h,
  round(img_w * CASE WHEN m <= 1600 THEN 1.0::double ELSE 1600.0::double / m END, 6) AS exact_w,
  least(img_w, img_h) AS side, cast((img_w - least(img_w, img_h)) // 2 AS int) AS left_, cast((img_h - least(img_w, img_h)) // 2 AS int) AS top_
FROM (SELECT *, greatest(img_w, img_h) AS m FROM scan_pages) t""")
def preview_sizes(spark, sf):
    W, H = sides()
    fit, exact, box = g.fit_dims(W, H, 1600), g.fit_dims(W, H, 1600, "exact"), g.center_square(W, H)
    return dims(spark, sf).select(
        "id", g.sample_size(W, H, F.lit(50)).alias("sample"), fit["w"].alias("fit_w"), fit["h"].alias("fit_h"),
        r6(exact["w"].cast("double"), "exact_w"), box["side"].alias("side"), box["left"].alias("left_"), box["top"].alias("top_"),
    )


@query("artefact_keys", CATALOGUE + """
SELECT id, concat(id::varchar, '_', filter_name, '_', rotation_degrees::varchar, '.jpg') AS working,
  concat(image_path, '|', filter_name, '|', rotation_degrees::varchar, '|persisted') AS request FROM scan_pages""")
def artefact_keys(spark, sf):
    f, r = F.col("filter_name"), F.col("rotation_degrees")
    return fx.pages(spark, sf).select(
        "id", tx.working_key(F.col("id"), f, r).alias("working"), tx.request_key(F.col("image_path"), f, r).alias("request")
    )


@query("page_layout", CATALOGUE + f"""
SELECT id, floor((CASE WHEN abs(q-{A4P})/{A4P} <= 0.2 THEN {A4P} WHEN abs(q-{A4L})/{A4L} <= 0.2 THEN {A4L} ELSE q END)*1e8 + 0.5)/1e8 AS ratio,
  cast(pw AS int) AS pdf_w, cast(ph AS int) AS pdf_h,
  floor((CASE WHEN abs(q-{P4P})/{P4P} <= 0.2 THEN 595.28 WHEN abs(q-{P4L})/{P4L} <= 0.2 OR q >= 1 THEN 841.89 ELSE 841.89*q END)*1e8 + 0.5)/1e8 AS rect_w,
  floor((CASE WHEN abs(q-{P4P})/{P4P} <= 0.2 THEN 841.89 WHEN abs(q-{P4L})/{P4L} <= 0.2 THEN 595.28 WHEN q >= 1 THEN 841.89/q ELSE 841.89 END)*1e8 + 0.5)/1e8 AS rect_h,
  floor((s)*1e8 + 0.5)/1e8 AS scale, floor(((pw - img_w*s)/2)*1e8 + 0.5)/1e8 AS dx, floor(((ph - img_h*s)/2)*1e8 + 0.5)/1e8 AS dy
FROM (SELECT *, least(pw::double/img_w, ph::double/img_h) AS s FROM (SELECT *,
  CASE WHEN abs(q-{A4P})/{A4P} <= 0.2 THEN 595 WHEN abs(q-{A4L})/{A4L} <= 0.2 OR q >= 1 THEN 842 ELSE greatest(1, floor(842*q + 0.5)) END AS pw,
  CASE WHEN abs(q-{A4P})/{A4P} <= 0.2 THEN 842 WHEN abs(q-{A4L})/{A4L} <= 0.2 THEN 595 WHEN q >= 1 THEN greatest(1, floor(842/q + 0.5)) ELSE 842 END AS ph
  FROM (SELECT *, img_w::double/img_h AS q FROM scan_pages) a) b) c""")
def page_layout(spark, sf):
    W, H = sides()
    size, rect = g.pdf_size(W, H), g.pdf_rect(W, H)
    place = g.placement(W, H, size["w"], size["h"])
    return dims(spark, sf).select(
        "id", r8(g.display_ratio(W, H), "ratio"), size["w"].alias("pdf_w"), size["h"].alias("pdf_h"),
        r8(rect["w"], "rect_w"), r8(rect["h"], "rect_h"),
        r8(place["scale"], "scale"), r8(place["dx"], "dx"), r8(place["dy"], "dy"),
    )


SNAP = """CASE WHEN abs({r}/{p}-1) <= abs({r}/{l}-1) AND abs({r}/{p}-1) <= 0.2 THEN {p}
  WHEN abs({r}/{p}-1) > abs({r}/{l}-1) AND abs({r}/{l}-1) <= 0.2 THEN {l} END"""


def snap_sql(r: str) -> str:
    return SNAP.format(r=r, p=A4P, l=A4L)


@query("normalized_sizes", CATALOGUE + f"""
SELECT id, round(t, 6) AS target, greatest(1, cast(floor(sqrt(a*t)) AS int)) AS cut_w, greatest(1, cast(floor(sqrt(a/t)) AS int)) AS cut_h,
  greatest(1, cast(floor(sqrt(a*t)+0.5) AS int)) AS round_w, greatest(1, cast(floor(sqrt(a/t)+0.5) AS int)) AS round_h,
  CASE WHEN t IS NULL THEN 'keep_original_ratio'
    WHEN floor(sqrt(a*t)+0.5) = img_w AND floor(sqrt(a/t)+0.5) = img_h THEN 'already_close_to_a4'
    WHEN t < 1 THEN 'a4_portrait' ELSE 'a4_landscape' END AS mode,
  round(img_h / floor(img_h * CASE WHEN img_h > 500 THEN 500.0::double/img_h ELSE 1.0 END + 0.5), 6) AS by_height,
  round(img_h / floor(img_h * CASE WHEN m > 500 THEN 500.0::double/m ELSE 1.0 END + 0.5), 6) AS by_side,
  round(coalesce(t, {A4P}), 6) AS placeholder
FROM (SELECT *, {snap_sql('q')} AS t FROM (SELECT *, img_w::double/img_h AS q, img_w::double*img_h AS a, greatest(img_w, img_h) AS m
  FROM scan_pages) x) y""")
def normalized_sizes(spark, sf):
    W, H = sides()
    target = g.snap_ratio(W.cast("double") / H)
    cut, rnd = g.normalized_size(W, H, target), g.normalized_size(W, H, target, "round")
    known = target.isNotNull()
    return dims(spark, sf).select(
        "id", r6(target, "target"),
        F.when(known, cut["w"]).otherwise(1).alias("cut_w"), F.when(known, cut["h"]).otherwise(1).alias("cut_h"),
        F.when(known, rnd["w"]).otherwise(1).alias("round_w"), F.when(known, rnd["h"]).otherwise(1).alias("round_h"),
        g.normalize_mode(W, H, F.lit(None).cast("double")).alias("mode"),
        r6(g.detection_ratio(W, H, "height"), "by_height"), r6(g.detection_ratio(W, H, "side"), "by_side"),
        r6(g.placeholder_ratio(target), "placeholder"),
    )


@query("preview_status", CATALOGUE + """,
f AS (SELECT id, small_preview_path IS NOT NULL AS bm, large_preview_path IS NOT NULL AS lp, rotation_degrees = 90 AS ld,
  filter_name = 'magic' AS uw, sort_order % 2 = 0 AS hw, rotation_degrees = 180 AS cp, sort_order FROM scan_pages)
SELECT id, CASE WHEN bm THEN 'IMAGE' WHEN NOT lp OR ld THEN 'LOADING_PLACEHOLDER' ELSE 'NUMBER_PLACEHOLDER' END AS list_status,
  CASE WHEN uw AND hw THEN 'IMAGE' WHEN uw AND cp THEN 'FILTER_LOADING' WHEN NOT uw AND bm THEN 'IMAGE'
    WHEN NOT uw AND (NOT lp OR ld) THEN 'PREVIEW_LOADING' ELSE 'EMPTY_PLACEHOLDER' END AS edit_status,
  CASE WHEN lp THEN 'IMAGE' WHEN ld THEN 'LOADING' ELSE 'PLACEHOLDER' END AS card_status,
  CASE WHEN hw THEN 'MEMORY_IMAGE' WHEN cp THEN 'LOADING' WHEN lp THEN 'IMAGE' ELSE 'PLACEHOLDER' END AS editor_status,
  CASE WHEN sort_order = 0 THEN 'CLOSE_BUTTON' ELSE 'THUMBNAIL_STACK' END AS camera,
  CASE WHEN bm THEN 'IMAGE' ELSE 'PLACEHOLDER' END AS small_status FROM f""")
def preview_status(spark, sf):
    bitmap, path = F.col("small_preview_path").isNotNull(), F.col("large_preview_path").isNotNull()
    loading, computing = F.col("rotation_degrees") == 90, F.col("rotation_degrees") == 180
    working, has_working = F.col("filter_name") == "magic", F.col("sort_order") % 2 == 0
    return fx.pages(spark, sf).select(
        "id",
        st.page_list_status(bitmap, path, loading).alias("list_status"),
        st.page_edit_status(working, has_working, computing, bitmap, path, loading).alias("edit_status"),
        st.page_card_status(path, loading).alias("card_status"),
        st.page_editor_status(has_working, computing, path).alias("editor_status"),
        st.camera_control(F.col("sort_order")).alias("camera"),
        st.small_preview_status(bitmap).alias("small_status"),
    )
