"""Raster operators that follow one another run as one Python step and gather the bands once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.plans import fixtures as fx
from scanloom.plans import all_queries
from scanloom.raster import grid, jobs, masks, neighbourhood as nb, point, stats, tone
from scanloom.raster import presets
from scanloom.raster.presets import to_lab

QUERIES = all_queries()


def pages(spark, ids=(1, 2, 3, None), h=12, w=10):
    rows = [
        (p, y, h, w, *[[None if (p, x, y) == (2, 4, 5) else (40 * (p or 1) + 31 * c + 17 * x * y) % 256 for x in range(w)] for c in range(3)])
        for p in ids for y in range(h)
    ]
    kind = "page_id long, y int, h int, w int, r array<int>, g array<int>, b array<int>"
    return grid.to_bands(spark.createDataFrame(rows, kind))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def unadapted(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_neighbourhood_steps_share_one_shuffle(unadapted):
    px = masks.accent_mask(masks.accent_mask(to_lab(pages(unadapted)), "l", "plain"), "l", "board", whiteboard=True)
    plan = plan_of(grid.as_text(px, "plain", "board"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_page_limit_and_mask_share_one_shuffle_of_the_scanlines(unadapted):
    plan = plan_of(grid.as_text(masks.paper_mask(to_lab(pages(unadapted)), "l", "m"), "m"))
    assert plan.count("ReusedExchange") == 1


def test_chained_steps_equal_steps_taken_one_by_one(spark):
    apart = lambda px: px.select("*")
    lab = to_lab(pages(spark))
    together = nb.median3(nb.gaussian(nb.close(lab, "l", 3), "l", nb.BLUR3, "l"), "l", "m")
    one_by_one = nb.median3(apart(nb.gaussian(apart(nb.close(apart(lab), "l", 3)), "l", nb.BLUR3, "l")), "l", "m")
    names = [*grid.POSITION, "r", "l", "m"]
    assert rows_of(together.select(*names)) == rows_of(one_by_one.select(*names))


def test_only_keeps_the_steps_that_are_needed(spark):
    px = grid.map_planes(pages(spark), ["r"], lambda v: v + 1, ["p"])
    px = grid.map_planes(px, ["p"], lambda v: v * 2, ["q"])
    px = grid.without(px, "p", "g", "b")
    assert px.columns == [*grid.POSITION, "r", "q"]
    for row in px.collect():
        assert row["q"] == [None if v is None else (v + 1) * 2 for v in row["r"]]


def test_bands_longer_than_a_gathering_stay_whole(spark, monkeypatch):
    rows = [(1, y, [(x * y) % 251 for x in range(6)]) for y in range(50)]
    monkeypatch.setattr(grid, "GATHERED_BYTES", 100)
    batches = [
        pa.RecordBatch.from_pydict({"page_id": pa.array([p] * 10, pa.int64()), "band": [0] * 10, "y": list(range(i, i + 10)), "v": [r[2] for r in rows[i : i + 10]]})
        for p in (1, 2, None) for i in range(0, 50, 10)
    ]
    got = [int(n) for _, counts in grid.whole_bands(iter(batches)) for n in counts]
    assert got == [50, 50, 50]


def test_text_leaves_out_missing_pixels(spark):
    kind = "page_id long, band int, y int, h int, w int, core boolean, v array<int>"
    px = spark.createDataFrame(
        [(1, 0, 0, 4, 3, True, [1, None, 300]), (1, 0, 1, 4, 3, True, None), (1, 0, 2, 4, 3, True, []),
         (1, 0, 3, 4, 3, True, [None]), (1, 0, 4, 4, 3, False, [7])], kind)
    plain = px.filter("core").select("page_id", "y", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))
    assert rows_of(grid.as_text(px, "v")) == rows_of(plain)


def test_histogram_needs_one_shuffle_up_to_its_percentiles(unadapted):
    found = stats.percentile_linear(stats.histogram(pages(unadapted), "r"), 0.1)
    assert plan_of(found).count("Exchange hashpartitioning") == 1


def test_histogram_counts_every_pixel_of_repeated_and_missing_pages(spark):
    px = pages(spark, ids=(2, 2, None))
    plain = px.filter("core").select("page_id", "h", F.explode("r").alias("v")).groupBy("page_id", "h", "v").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(stats.histogram(px, "r")) == rows_of(plain)


def test_page_ends_travel_with_the_scanlines(unadapted):
    px = nb.sobel_magnitude(pages(unadapted), "r", "_mag")
    plan = plan_of(grid.as_text(nb.min_max_normalise(px, "_mag", "edge"), "edge"))
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert plan.count("MapInArrow") == 1  # the magnitude is taken once


def test_page_ends_of_several_bands_and_missing_pages(spark):
    rows = [(p, y, 10, 3, [None if (p, y) == (1, 3) else (7 * y + x) * (p or 5) % 97 for x in range(3)]) for p in (1, 2, 2, None) for y in range(10)]
    lines = spark.createDataFrame(rows, "page_id long, y int, h int, w int, v array<int>")
    banded = grid.to_bands(lines, 4, 1).withColumn("d", F.col("v").cast("array<double>"))
    # The banding of ``settle`` is that of whole pages: each band must meet the ends of all of them.
    found = grid.settle(banded, totals={"_lo": (F.array_min("d"), "min", "double"), "_n": (F.size("v"), "sum")}, band_rows=4, pages_only=False)
    plain = banded.filter("core").groupBy("page_id").agg(F.min(F.array_min("d")).alias("_lo"), F.sum(F.size("v")).alias("_n"))
    whole = banded.join(plain, banded["page_id"].eqNullSafe(plain["page_id"])).drop(plain["page_id"])
    names = [*grid.POSITION, "v", "d", "_lo", "_n"]
    assert rows_of(found.select(*names)) == rows_of(whole.select(*names))
    one = nb.min_max_normalise(grid.to_bands(lines), "v", "e").filter("core").collect()
    for r in one:
        own = [v for o in one if o.page_id == r.page_id for v in o.v if v is not None]
        want = [None if v is None else 0 if r.page_id is None else int((v - min(own)) * (255.0 / (max(own) - min(own)))) for v in r.v]
        assert r.e == want


def test_lighting_and_richness_settle_without_joins(unadapted):
    px = pages(unadapted)
    assert "Join" not in plan_of(grid.as_text(presets.magic_step1(px), "r", "g", "b"))
    rich = presets.with_richness(grid.map_planes(px, ["r", "g"], lambda r, g: {"l": r, "p": (g > 90).astype("int32")}, ["l", "p"]), "b", "l", "p")
    assert rich.columns == [*grid.POSITION, "r", "g", "b", "l", "p", "top_sat", "richness"]


def test_shuffles_of_page_images_grow_with_the_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "PARTS_PER_SHUFFLED", 10)
    spark.range(1000).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        found = stats.percentile_linear(stats.histogram(fx.page_rasters(spark, str(tmp_path)), "r"), 0.1)
        assert "hashpartitioning(page_id#" in plan_of(found) and ", 100)" in plan_of(found)
        spark.range(10).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "few" / "part.parquet"))
        fx.page_rasters(spark, str(tmp_path / "few"))
        assert spark.conf.get(name) == "100"  # never fewer than something else in the session asked for
        assert found.count() == 1000
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("mode", ["docs", "app"])
def test_presets_in_one_chain_keep_their_own_operators(spark, mode):
    px = pages(spark, ids=(1,))
    for name in ("sharpen", "vivid"):
        rgb = [np.array([v for r in sorted(px.collect(), key=lambda r: r.y) for v in r[c]], np.int32) for c in "rgb"]
        want = dict(zip("rgb", rgb))
        if mode == "app":
            want = point.affine_matrix(*rgb, point.preset_matrix(point.PRESET_OPS[name]))
        for op, k in point.PRESET_OPS[name] if mode == "docs" else ():
            want = point.OPERATORS[op](want, k)
        found = sorted(presets.light_preset(px, name, mode).collect(), key=lambda r: r.y)
        assert all([v for r in found for v in r[c]] == want[c].tolist() for c in "rgb")


def test_both_presets_by_one_matrix(spark, small):
    found = QUERIES["light_presets_one_matrix"](spark, small)
    assert len(found.columns) == 8 and found.count() == 6400
    row, r, g, b = found.orderBy("page_id", "y").first(), *drawn(spark, small)
    for tag, name in (("s", "sharpen"), ("v", "vivid")):
        want = point.affine_matrix(r, g, b, point.preset_matrix(point.PRESET_OPS[name]))
        assert all(row[f"{tag}{c}"] == ",".join(map(str, want[c].tolist())) for c in "rgb")


def drawn(spark, small):
    line = fx.page_rasters(spark, small).orderBy("page_id", "y").first()
    return (np.array(line[c], np.int32) for c in "rgb")


@pytest.mark.parametrize("name", ["magic", "bw", "whiteboard"])
def test_pages_of_one_band_equal_those_of_several(spark, name):
    fn = presets.FILTERS[name]
    px = pages(spark, ids=(1, 3, 4, 7, 7, None), h=21, w=17)
    one = grid.core(fn(px))
    px._whole = False
    several = grid.core(fn(px))
    assert one.count() == 5 * 21 and rows_of(one.select(several.columns)) == rows_of(several)


def test_pages_of_one_band_shuffle_once(unadapted):
    px = pages(unadapted)
    for fn, name in ((presets.magic, "r"), (presets.whiteboard, "r"), (lambda px: nb.illumination(px, "r", "s"), "s")):
        small, large = fn(px)._parts
        assert plan_of(grid.as_text(small, name)).count("Exchange hashpartitioning") == 1
    assert grid.core(small).count() == 3 * 12 and grid.core(large).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_values_equal_the_table_form(spark, seed):
    rng = np.random.default_rng(seed)
    spans = [(0, 256), (250, 256), (236, 240), (180, 230), (7, 8), (190, 256)]
    images = [rng.integers(low, high, (6, 9)) for low, high in spans]
    rows = [(k, y, 6, 9, [int(v) for v in im[y]]) for k, im in enumerate(images) for y in range(6)]
    px = grid.to_bands(spark.createDataFrame(rows, "page_id long, y int, h int, w int, v array<int>"))
    want = {r.page_id: r.levels for r in tone.fitted_tones(stats.histogram(px, "v")).collect()}
    assert {k: tone.levels_of_values(im.ravel()) for k, im in enumerate(images)} == want
    stack, paper = np.stack(images), rng.integers(0, 2, (len(images), 6, 9))
    found = tone.to_page_levels(stack, paper)
    for k, own in want.items():
        halfway = np.rint((np.array(own[:-1]) + own[1:]) / 2)
        q = np.array(own)[(stack[k][..., None] >= halfway).sum(axis=-1)]
        top = np.maximum(q, own[-2]) if len(own) >= 3 else own[-1]
        assert (found[k] == np.where(paper[k] == 0, q, top)).all()


def test_statistics_of_stacks_equal_those_of_tables(spark):
    px = masks.with_limits(pages(spark), "r", ["paper", "dark"]).filter("page_id is not null")
    own = pages(spark).filter("page_id is not null")
    own._whole = True
    beside = masks.with_limits(own, "r", ["paper", "dark"])
    names = ["limit_paper", "limit_dark"]
    want = {(r.page_id, r.y): [r[n] for n in names] for r in px.collect()}
    assert {(r.page_id, r.y): [r[n][0] for n in names] for r in beside.collect()} == want
    edge = nb.sobel_magnitude(own, "g", "_mag")
    found = nb.min_max_normalise(edge, "_mag", "edge")
    plain = nb.min_max_normalise(nb.sobel_magnitude(pages(spark), "g", "_mag"), "_mag", "edge").filter("page_id is not null")
    assert rows_of(found.select("page_id", "y", "edge")) == rows_of(plain.select("page_id", "y", "edge"))


def test_pages_are_straightened_in_few_shuffles(unadapted):
    corners = [{"x": x, "y": y} for x, y in ((1, 1), (8, 1), (8, 10), (1, 10))]
    quads = unadapted.createDataFrame([(p, 0, corners) for p in (1, 2)], "page_id long, cand_id int, corners array<struct<x int, y int>>")
    plan = plan_of(jobs.straighten_and_normalise(pages(unadapted, ids=(1, 2)), quads))
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 9


def test_edges_shuffle_the_gray_plane_once(unadapted):
    own = pages(unadapted, ids=(1, 3)).filter("page_id is not null")
    own._whole = True
    gray = grid.only(grid.map_planes(own, ["r", "g", "b"], point.luma, ["v"]), [*grid.POSITION, "v"])
    plan = plan_of(nb.min_max_normalise(nb.sobel_magnitude(gray, "v", "_mag"), "_mag", "edge"))
    taken = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert plan.count("Exchange hashpartitioning") == 1 and "v#" in taken.split(")#")[0] and " r#" not in taken.split(")#")[0]
