"""Worked examples, invariants, and the chunked paths on small inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from scanloom import scale
from scanloom.functions import geometry as g, sql, status as st, text as tx
from scanloom.operators import artefacts as art, catalog as cat, frames as fr
from scanloom.plans import fixtures as fx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- page sizes ------------------------------------------------------------------------------------

PAGE_SIZES = [
    (2100, 2970, 0.7071, 595, 842),
    (2970, 2100, 1.4143, 842, 595),
    (778, 1000, 0.7071, 595, 842),
    (3000, 1000, 3.0, 842, 281),
    (500, 2000, 0.25, 211, 842),
    (1000, 1000, 1.0, 842, 842),
    (0, 0, 0.7071, 595, 842),
]


@pytest.mark.parametrize("w,h,ratio,pw,ph", PAGE_SIZES)
def test_page_ratio_and_pdf_size(spark, w, h, ratio, pw, ph):
    row = one(spark, g.display_ratio(F.lit(w), F.lit(h)).alias("r"), g.pdf_size(F.lit(w), F.lit(h)).alias("s"))
    assert row.r == pytest.approx(ratio, abs=1e-4)
    assert (row.s.w, row.s.h) == (pw, ph)


@pytest.mark.parametrize("w,h,pw,ph", [(2100, 2970, 595.28, 841.89), (2970, 2100, 841.89, 595.28), (1600, 900, 841.89, 841.89 * 9 / 16), (0, 0, 595.28, 841.89)])
def test_pdf_rect(spark, w, h, pw, ph):
    size = one(spark, g.pdf_rect(F.lit(w), F.lit(h)).alias("s")).s
    assert (size.w, size.h) == (pytest.approx(pw), pytest.approx(ph))


SIDES = [
    (210, 210, 297, 297, 0.7071), (297, 297, 210, 210, 1.4143), (150, 500, 350, 340, 0.7071),
    (350, 340, 150, 500, 1.4143), (250, 250, 250, 250, None),
]


@pytest.mark.parametrize("top,bottom,left,right,want", SIDES)
def test_paper_ratio_from_sides(spark, top, bottom, left, right, want):
    got = one(spark, g.sides_paper_ratio(*[F.lit(v) for v in (top, bottom, left, right)]).alias("r")).r
    assert got is None if want is None else got == pytest.approx(want, abs=1e-4)


def test_normalised_size_keeps_area(spark):
    size = one(spark, g.normalized_size(F.lit(1200), F.lit(900), F.lit(210 / 297), "exact").alias("s")).s
    assert size.w / size.h == pytest.approx(210 / 297, abs=1e-3)
    assert size.w * size.h == pytest.approx(1200 * 900, rel=1e-3)
    assert size.w < size.h


def test_safe_file_name(spark):
    row = one(spark, tx.safe_file_name(F.lit("スキャン 2026/03/29 01:08")).alias("a"), tx.safe_file_name(F.lit("  ")).alias("b"))
    assert (row.a, row.b) == ("スキャン 2026_03_29 01_08", "document")


def test_four_quarter_turns(spark):
    turns, d = [], F.lit(0)
    for _ in range(4):
        d = g.quarter_left(d)
        turns.append(d)
    assert list(one(spark, F.array(*turns).alias("t")).t) == [270, 180, 90, 0]


def test_preview_status(spark):
    b = F.lit
    cases = [
        (st.page_list_status(b(True), b(True), b(False)), "IMAGE"),
        (st.page_list_status(b(False), b(False), b(False)), "LOADING_PLACEHOLDER"),
        (st.page_list_status(b(False), b(True), b(False)), "NUMBER_PLACEHOLDER"),
        (st.page_edit_status(b(True), b(False), b(True), b(False), b(True), b(False)), "FILTER_LOADING"),
        (st.page_edit_status(b(True), b(True), b(False), b(False), b(True), b(False)), "IMAGE"),
        (st.page_edit_status(b(False), b(False), b(False), b(False), b(False), b(False)), "PREVIEW_LOADING"),
        (st.page_edit_status(b(False), b(False), b(False), b(False), b(True), b(False)), "EMPTY_PLACEHOLDER"),
        (st.page_card_status(b(True), b(False)), "IMAGE"),
        (st.page_card_status(b(False), b(True)), "LOADING"),
        (st.page_editor_status(b(True), b(False), b(True)), "MEMORY_IMAGE"),
        (st.page_editor_status(b(False), b(True), b(True)), "LOADING"),
        (st.page_editor_status(b(False), b(False), b(True)), "IMAGE"),
        (st.camera_control(b(0)), "CLOSE_BUTTON"),
        (st.camera_control(b(2)), "THUMBNAIL_STACK"),
        (st.small_preview_status(b(False)), "PLACEHOLDER"),
    ]
    row = one(spark, *[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)])
    assert list(row) == [want for _, want in cases]


def test_progress(spark):
    def text(phase, current, total, name=None):
        return st.progress_text(F.lit(phase), F.lit(current), F.lit(total), F.lit(name).cast("string"))

    row = one(
        spark,
        text("preparing", 0, 4).alias("a"), text("rendering", 3, 8, "whiteboard").alias("b"),
        text("rendering", 1, 2, "original").alias("c"), text("finalizing", 5, 5).alias("d"),
        st.progress_fraction(F.lit("rendering"), F.lit(3), F.lit(8)).alias("e"),
        st.progress_ratio(F.lit(8), F.lit(5)).alias("f"), st.progress_ratio(F.lit(1), F.lit(0)).alias("g"),
        st.progress_fraction(F.lit("rendering"), F.lit(1), F.lit(0)).alias("h"),
    )
    assert list(row) == [
        "4ページのPDFを準備中…", "3 / 8ページをホワイトボードで処理中…", "1 / 2ページを処理中…", "5ページのPDFを書き出し中…",
        0.375, 1.0, 0.0, None,
    ]


def test_sql_functions_match_columns(spark):
    sql.register(spark)
    sizes = spark.createDataFrame([(w, h) for w, h, *_ in PAGE_SIZES if w], "w int, h int")
    both = sizes.select(
        F.expr("display_ratio(w, h)").alias("a"), g.display_ratio(F.col("w"), F.col("h")).alias("b"),
        F.expr("normalized_width(w, h, 210D/297D)").alias("c"), g.normalized_size(F.col("w"), F.col("h"), F.lit(210 / 297))["w"].alias("d"),
    )
    for r in both.collect():
        assert r.a == r.b and r.c == r.d


# --- skew-safe helpers -----------------------------------------------------------------------------


def test_number_rows_over_many_buckets(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(500), i) for i in range(2000) for k in [0 if rng.random() < 0.7 else rng.randrange(5)]]
    df = spark.createDataFrame(rows, "k int, o int, id int")
    got = {r.id: r.pos for r in scale.number_rows(df, ["k"], scale.span_bucket(F.col("o"), 7), ["o", "id"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])):
            want[r[2]] = n
    assert got == want


def test_renumbering_one_huge_document_uses_no_single_window(spark):
    pages = spark.range(20_000).select(
        F.col("id"), F.lit(1).cast("long").alias("document_id"), (F.col("id") * 3).cast("int").alias("sort_order")
    )
    renumbered = cat.renumber(pages)
    assert renumbered.filter("sort_order <> id").count() == 0
    plan = renumbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_bucket" in plan or "hashpartitioning(document_id" in plan and "_bucket" in plan, plan
    assert "windowspecdefinition(sort_order" not in plan


def test_chunked_frames_equal_unchunked(spark, small):
    frames = fx.frames(spark, small).withColumn("session_id", F.lit(1).cast("long"))
    whole = {r.frame_id: (r.status, r.shown) for r in fr.stabilize(frames).collect()}
    parts = {r.frame_id: (r.status, r.shown) for r in fr.stabilize(frames, rows=16).collect()}
    assert whole == parts
    assert {s for s, _ in whole.values()} == {"valid", "held", "none"}


def test_smoothing_equals_sequential(spark):
    """A long unbroken session, so that smoothing crosses several chunks."""
    n = 3000
    rng = np.random.default_rng(5)
    xs = rng.uniform(0.1, 0.9, n)
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([
        T.StructField("session_id", T.LongType()), T.StructField("frame_id", T.LongType()),
        T.StructField("ts_ms", T.LongType()), T.StructField("corners", T.ArrayType(point)),
    ])
    rows = [(1, i, i * 33, [(float(x), float(x) / 2)] * 4) for i, x in enumerate(xs)]
    got = {r.frame_id: r.smoothed[0].x if r.smoothed else None for r in fr.stabilize_smooth(spark.createDataFrame(rows, schema)).collect()}
    shown = None
    for i in range(n):
        near = xs[max(0, i - 6): i + 1]
        if len(near) < 3:
            assert got[i] is None
            continue
        median = sorted(near)[len(near) // 2]
        shown = median if shown is None else shown + 0.35 * (median - shown)
        assert got[i] == pytest.approx(shown, abs=1e-12)


# --- artefacts ---------------------------------------------------------------------------------------


def test_eviction_leaves_at_most_the_kept_share(spark):
    files = spark.range(400).select(
        F.lit("c").alias("cache_id"), F.lit("working").alias("kind"), F.concat(F.lit("f"), "id").alias("file_name"),
        (F.col("id") * 37 % 91 + 10).alias("size"),
        F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00' + make_dt_interval(0, id * 7 % 50, id % 60, 0)").alias("mtime"),
    )
    total = files.agg(F.sum("size")).first()[0]
    limit = total - 1
    kept = art.eviction_plan(files, limit=limit, keep=0.8).filter(~F.col("evict")).agg(F.sum("size")).first()[0]
    assert kept <= int(limit * 0.8) < kept + 101
    assert art.eviction_plan(files, limit=total).filter("evict").count() == 0


def test_applied_previews_are_swapped(spark):
    pages = spark.createDataFrame(
        [(1, "old-small.jpg", "old-large.jpg"), (2, None, None)], "id long, small_preview_path string, large_preview_path string"
    )
    new = spark.createDataFrame([(1, "new-small.jpg", "new-large.jpg"), (2, "small.jpg", "large.jpg")], "page_id long, new_small string, new_large string")
    stored, deletes = art.swap_applied_previews(pages, new)
    assert {(r.id, r.small_preview_path, r.large_preview_path) for r in stored.collect()} == {
        (1, "new-small.jpg", "new-large.jpg"), (2, "small.jpg", "large.jpg")
    }
    assert {r.file_name for r in deletes.collect()} == {"old-small.jpg", "old-large.jpg"}


# --- sources -----------------------------------------------------------------------------------------


def test_catalogue_round_trip_and_new_version(spark, small, tmp_path):
    from scanloom.sources import catalog as src

    docs, pages = fx.documents(spark, small), fx.pages(spark, small)
    folder = str(tmp_path / "catalogue")
    first = src.write_catalog(docs, pages, folder)
    d1, p1 = src.read_catalog(spark, folder)
    assert (d1.count(), p1.count()) == (docs.count(), pages.count())
    second = src.write_catalog(d1, p1.filter("sort_order = 0"), folder)
    assert first != second
    assert src.read_catalog(spark, folder)[1].filter("sort_order > 0").count() == 0
    assert p1.count() == pages.count()


def test_old_page_tables_gain_preview_columns(spark):
    old = spark.createDataFrame([(1, 2, 0, "a.jpg", "bw", 90)], "id long, document_id long, sort_order int, image_path string, filter_name string, rotation_degrees int")
    assert cat.upgrade_pages(old).first().asDict()["small_preview_path"] is None


def test_manifest(spark, tmp_path):
    from scanloom.sources import catalog as src

    entry = {k: f"{k}.png" for k in ("title", "description", "source", "step0", "step1", "magic_step2", "magic_step3")}
    kinds = ("sharpen", "bw", "whiteboard", "vivid")
    entries = [dict(entry, id=f"s{i}", step1=f"s{i}.png", filters={k: f"{k}/{i}.png" for k in kinds}) for i in range(12)]
    entries[4]["crop_mode"] = "copy_source"
    path = tmp_path / "m.json"
    path.write_text(json.dumps(entries))
    manifest = src.read_manifest(spark, str(path))
    assert manifest.count() == 12 and manifest.filter("crop_mode IS NOT NULL").count() == 1
    assert {r.id for r in src.read_manifest(spark, str(path), ("s1", "s3")).collect()} == {"s1", "s3"}
    sources = spark.createDataFrame([(f"s{i}.png",) for i in range(11)], "path string")
    assert art.manifest_filter_grid(manifest, list(kinds), sources).count() == 44


def test_images_and_inventory(spark, tmp_path):
    from scanloom.raster.grid import pixels
    from scanloom.sources import catalog as src, images as im

    jvm, w, h = spark.sparkContext._jvm, 5, 3
    picture = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(h):
        for x in range(w):
            picture.setRGB(x, y, (10 * x << 16) + (20 * y << 8) + x + y)
    (tmp_path / "img").mkdir()
    jvm.javax.imageio.ImageIO.write(picture, "png", jvm.java.io.File(str(tmp_path / "img" / "a.png")))
    (tmp_path / "img" / "broken.png").write_bytes(b"not an image")
    images = im.read_images(spark, str(tmp_path / "img"))
    assert [tuple(r) for r in im.image_dims(images).collect()] == [("a.png", w, h)]
    px = pixels(im.image_scanlines(images, F.lit(1)), "r", "g", "b").collect()
    assert {(r.x, r.y, r.r, r.g, r.b) for r in px} == {(x, y, 10 * x, 20 * y, x + y) for x in range(w) for y in range(h)}
    listing = src.read_inventory(spark, {"small": str(tmp_path / "img")})
    assert {r.file_name for r in listing.collect()} == {"a.png", "broken.png"}


def test_raster_round_trip(spark, small, tmp_path):
    from scanloom.raster.grid import pixels
    from scanloom.sources import catalog as src

    px = fx.page_rasters(spark, small)
    src.write_raster(px, str(tmp_path / "r"), "large")
    back = src.read_raster(spark, str(tmp_path / "r"), "large")
    total = lambda d: d.agg(F.count("r"), F.sum(F.col("r") * (F.col("x") + 31 * F.col("y")))).first()
    assert total(pixels(back, "r")) == total(pixels(px, "r"))


def test_sql_functions_equal_their_columns(spark):
    from scanloom.functions import geometry as g, sql

    sql.register(spark)
    quads = [
        [(10, 12), (200, 15), (210, 300), (8, 290)], [(200, 15), (10, 12), (8, 290), (210, 300)], [(0, 0), (100, 0), (20, 20), (0, 100)],
        [(5, 5), (305, 5), (290, 215), (20, 215)], [(0, 0), (0, 0), (90, 90), (0, 120)], [(50, 0), (100, 50), (50, 100), (0, 50)],
    ]
    sizes = [(2100, 2970), (2970, 2100), (778, 1000), (3000, 1000), (500, 2000), (1000, 1000)]
    rows = [([{"x": x, "y": y} for x, y in q], w, h) for q, (w, h) in zip(quads, sizes)]
    df = spark.createDataFrame(rows, "c array<struct<x int, y int>>, w int, h int")
    c = F.col("c")
    side = g.side_lengths(c)
    p, sides = g.points(c), "s.top, s.bottom, s.left, s.right"
    pairs = [
        (g.pdf_size(F.col("w"), F.col("h"))["w"], "pdf_width(w, h)"), (g.pdf_size(F.col("w"), F.col("h"))["h"], "pdf_height(w, h)"),
        (g.pdf_rect(F.col("w"), F.col("h"))["w"], "pdf_rect_width(w, h)"), (g.pdf_rect(F.col("w"), F.col("h"))["h"], "pdf_rect_height(w, h)"),
        (g.order_corners(c), "order_corners(c)"), (g.is_convex(c), "is_convex_quad(c)"),
        (g.angle_deg(p[0], p[1], p[2]), "corner_angle(c[0].x, c[0].y, c[1].x, c[1].y, c[2].x, c[2].y)"),
        (g.shape_score(g.corner_angles(c), side, F.lit(0.3)), f"shape_score(a[0], a[1], a[2], a[3], {sides}, 0.3)"),
        (g.ratio_of_sides(side), f"sides_ratio({sides})"),
        (g.sides_paper_ratio(side["top"], side["bottom"], side["left"], side["right"]), f"mean_sides_ratio({sides})"),
    ]
    ready = df.withColumn("s", side).withColumn("a", g.corner_angles(c))
    for column, text in pairs:
        for row in ready.select(column.alias("want"), F.expr(text).alias("got")).collect():
            same = row.got == row.want or (row.got is not None and row.got == pytest.approx(row.want))
            assert same, (text, row)


def test_prefixes_have_a_row_for_each_length_of_a_stem(spark):
    images = ["a.jpg", "ab.jpg", "ab.jpg", "zbc.jpg", "abcdef.jpg", None]
    names = ["a_1.jpg", "abc.jpg", "zbcd", "zbé", "b", "", None, "ab", "ab"]
    sources = spark.createDataFrame([(v,) for v in images], "image_path string")
    files = spark.createDataFrame([("working", n) for n in names] + [("small", "ab")], "kind string, file_name string")
    found = art.working_files_by_prefix(sources, files)
    stems = {v.removesuffix(".jpg") for v in images if v}
    want = sorted((s, n) for s in stems for n in names if n is not None and n.startswith(s))
    assert sorted(map(tuple, found.collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = art.working_files_by_prefix(sources, files)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "explode(filter(_lengths" in plan  # not every length of every name


def test_readers_of_the_pages_share_their_numbering(spark, small):
    from scanloom.plans import all_queries

    done = all_queries()["apply_edits"](spark, small)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # One for the readers that take every line, one for those that need a document.
    assert sum("FileScan" in line and "l_quantity" in line for line in plan.splitlines()) <= 2
