"""Raster work that grows with its input: array steps, pages of several sizes, joins and tasks at size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.plans import fixtures as fx
from scanloom.raster import grid, neighbourhood as nb, point, presets, stats, tone, warp
from test_raster import brute_split, page, plane


@pytest.fixture(scope="module")
def sizes(spark):
    """Pages of several sizes and one with a missing pixel, in one table."""
    rng = np.random.default_rng(4)
    images = {k: rng.integers(0, 256, (5 + k, 4 + k % 3)) for k in range(12)}
    rows = [(k, y, *im.shape, [None if (k, y) == (11, 2) else int(v) for v in im[y]]) for k, im in images.items() for y in range(len(im))]
    df = spark.createDataFrame(rows, "page_id long, y int, h int, w int, v array<int>")
    return images, grid.to_bands(df, 6, 5)


def test_bands_of_several_sizes(sizes):
    images, px = sizes
    found = nb.dilate(px, "v", 3).filter("core").select("page_id", "y", "v").collect()
    for k, image in images.items():
        if k == 11:
            continue
        got = np.array([r.v for r in sorted(found, key=lambda r: r.y) if r.page_id == k])
        wide = np.pad(image, 1, constant_values=-1)
        n, w = image.shape
        near = [wide[dy : dy + n, dx : dx + w] for dy, dx in ((0, 1), (1, 0), (1, 1), (1, 2), (2, 1))]
        assert (got == np.max(near, axis=0)).all()


def test_missing_pixels_stay_missing_or_count_as_nothing(sizes):
    _, px = sizes
    lit = grid.map_planes(px, ["v"], lambda v: {"same": v, "byte": point.contrast(v, 1.0)}, ["same", "byte"])
    row = lit.filter("core and page_id = 11 and y = 2").first()
    assert set(row.same) == {None} and set(row.byte) == {255}


@pytest.mark.parametrize("fn", [point.luma, point.rgb_to_lab, point.rgb_to_hsv, point.lab_to_rgb, point.hsv_to_rgb])
def test_arrays_and_columns_agree(spark, fn):
    values = np.random.default_rng(9).integers(0, 256, (400, 3))
    if fn is point.hsv_to_rgb:
        values[:, 0] %= 180
    df = spark.createDataFrame([tuple(int(v) for v in row) for row in values], "a int, b int, c int")
    got = [r.v for r in df.select(fn(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    found = fn(*values.T.astype(np.int32))
    want = list(zip(*(v.tolist() for v in found.values()))) if isinstance(found, dict) else found.tolist()
    assert [tuple(v) if isinstance(found, dict) else v for v in got] == want


@pytest.mark.parametrize("k", [3, 4])
def test_split_of_arrays(k):
    values, n = np.array([3, 9, 40, 41, 100, 180, 250]), np.array([5.0, 1, 7, 7, 2, 9, 4])
    v, cw, cs = (np.concatenate([[0 - (i == 0)], a]) for i, a in enumerate((values, n.cumsum(), (n * values).cumsum())))
    assert tone.best_split(v, cw, cs, k) == pytest.approx(brute_split(values, n, k))


def test_no_side_is_broadcast_by_its_estimate(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (12, 9))
    page(spark, image, name="r").withColumns({"g": F.col("r"), "b": F.col("r")}).write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    corners = [{"x": x, "y": y} for x, y in ((0, 0), (8, 1), (8, 11), (1, 10))]
    quads = spark.createDataFrame([(1, 0, corners)], "page_id long, cand_id int, corners array<struct<x int, y int>>")
    quads.write.parquet(str(tmp_path / "quads"))
    quads = spark.read.parquet(str(tmp_path / "quads"))
    for df in (
        warp.warp(px, quads, ["r"]), warp.edge_support(px, "r", quads), presets.auto_stretch(px, "r"),
        warp.crop(px, stats.trim_bounds(px, "r"), ["r"]),
    ):
        assert len(df.collect()) > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("interp", ["nearest", "bilinear"])
def test_warp_over_several_bands(spark, interp):
    image = np.random.default_rng(2).integers(0, 256, (40, 15))
    corners = [{"x": x, "y": y} for x, y in ((3, -4), (14, 2), (16, 39), (0, 33))]
    quads = spark.createDataFrame([(1, corners)], "page_id long, corners array<struct<x int, y int>>")
    whole = plane(warp.warp(page(spark, image), quads, ["v"], interp), "v")
    cut = plane(warp.warp(page(spark, image, 7, 3), quads, ["v"], interp, band_rows=7), "v")
    assert whole.shape == cut.shape and (whole == cut).all() and (whole == 0).any() and (whole > 0).any()


def test_turned_pages_of_several_bands(spark):
    image = np.random.default_rng(3).integers(0, 256, (23, 6))
    for degrees, turns in ((90, -1), (270, 1)):
        px = page(spark, image, 5, 2).withColumn("rotation_degrees", F.lit(degrees))
        assert (plane(warp.rotate(px, ["v"]), "v") == np.rot90(image, turns)).all()


def test_tasks_grow_with_the_parts(spark, small, monkeypatch):
    monkeypatch.setattr(fx, "PARTS_PER_TASK", 10)
    px = fx.page_rasters(spark, small)
    assert px.select("page_id").distinct().count() == 200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert px.rdd.getNumPartitions() >= 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_drawn_lines_without_key():
    drawn = fx.draw_lines(pa.array([7, None], pa.int64()), pa.array([0, 0], pa.int32())).to_pylist()
    assert None not in drawn[0]["r"] and set(drawn[1]["r"]) == {None}


def test_copies_of_a_row_keep_their_order(spark):
    rows = [(1, y, 2, 1, [v]) for y, v in ((0, 5), (0, 1), (1, 9), (1, 2))]
    px = grid.to_bands(spark.createDataFrame(rows, "page_id long, y int, h int, w int, v array<int>").coalesce(1))
    placed = grid.map_bands(px, ["v"], lambda v: np.broadcast_to(np.arange(4)[None, :, None], v.shape), ["at"])
    assert {r.v[0]: r["at"][0] for r in placed.collect()} == {5: 0, 1: 1, 9: 2, 2: 3}
