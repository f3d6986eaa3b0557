"""Raster operators against brute force on small images, including pages cut into several bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.raster import grid, masks, neighbourhood as nb, point, presets, stats, tone, warp


def page(spark, image, band_rows=grid.BAND_ROWS, margin=grid.MARGIN_ROWS, name="v"):
    h, w = image.shape
    rows = [(1, y, h, w, [int(v) for v in image[y]]) for y in range(h)]
    return grid.to_bands(spark.createDataFrame(rows, f"page_id long, y int, h int, w int, {name} array<int>"), band_rows, margin)


def plane(px, name):
    rows = sorted(px.filter("core").select("y", name).collect(), key=lambda r: r.y)
    return np.array([r[name] for r in rows])


@pytest.fixture(scope="module")
def gray():
    return np.random.default_rng(11).integers(0, 256, (41, 17))


def windows(image, r, mode="edge"):
    padded = np.pad(image, r, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))


@pytest.mark.parametrize("band_rows,margin", [(2048, 160), (10, 8)])
def test_neighbours_across_bands(spark, gray, band_rows, margin):
    px = page(spark, gray, band_rows, margin)
    assert (plane(nb.median3(px, "v", "m"), "m") == np.median(windows(gray, 1), axis=(2, 3))).all()
    sums = nb.box_sums(px, "v", 7)
    assert (plane(sums, "box_sum") == windows(gray, 3).sum(axis=(2, 3))).all()
    kernel = np.outer(nb.BLUR5, nb.BLUR5)
    blurred = plane(nb.gaussian(px, "v", nb.BLUR5, "b"), "b")
    assert (blurred == np.floor((windows(gray, 2, "reflect") * kernel).sum(axis=(2, 3)) + 0.5)).all()


def test_morphology(spark, gray):
    ink = (gray > 180).astype(int)
    element = np.zeros((5, 5), dtype=bool)
    for dy, r in nb.ellipse(5).items():
        element[dy + 2, 2 - r: 3 + r] = True
    assert element.sum() == 17
    px = page(spark, ink, 10, 8)
    grown = plane(nb.dilate(px, "v", 5), "v")
    want = np.where(element, windows(np.pad(ink, 0), 2, "constant"), 0).max(axis=(2, 3))
    assert (grown == want).all()
    opened, closed = plane(nb.open_(px, "v", 3), "v"), plane(nb.close(px, "v", 3), "v")
    assert (opened <= ink).all() and (ink <= closed).all()


def test_statistics(spark, gray):
    hist = stats.histogram(page(spark, gray, 10, 8), "v")
    got = stats.percentiles(hist, a=stats.linear(0.18), b=stats.nearest(0.995)).first()
    flat = np.sort(gray.ravel())
    assert got.a == pytest.approx(np.percentile(flat, 18))
    assert got.b == flat[int(len(flat) * 0.995)]


def test_sample_of_sorted_values(spark):
    values = np.random.default_rng(2).integers(150, 256, (90, 61))
    hist = stats.histogram(page(spark, values), "v")
    got = {r.v: r.n for r in tone.quantization_sample(hist, 500, 1000).collect()}
    flat = np.sort(values.ravel())
    dark, bright = flat[flat < 224], flat[flat >= 224]
    most = min(len(bright), max(2 * len(dark), 500))
    spaced = lambda a, n: a[[i * (len(a) - 1) // (n - 1) for i in range(n)]] if len(a) > n else a
    sample = spaced(np.sort(np.concatenate([dark, spaced(bright, most)])), 1000)
    assert got == {int(v): int(n) for v, n in zip(*np.unique(sample, return_counts=True))}


def reference_levels(values, k):
    """Plain k-means on a weighted histogram, with the level rules applied."""
    weights = np.bincount(values.ravel(), minlength=256).astype(float)
    dark, bright = weights[:224].sum(), weights[224:].sum()
    most = min(bright, max(dark * 2, 12_000))
    if bright > most:
        weights[224:] *= most / bright
    cumulative = np.cumsum(weights)
    centers = np.array([float(np.argmax(cumulative >= weights.sum() * (i + 1) / (k + 1))) for i in range(k)])
    for _ in range(32):
        label = np.abs(np.arange(256)[:, None] - centers).argmin(axis=1)
        moved = np.array([
            (weights * np.arange(256))[label == i].sum() / weights[label == i].sum() if weights[label == i].sum() else centers[i]
            for i in range(k)
        ])
        delta, centers = np.abs(moved - centers).max(), moved
        if delta < 0.2:
            break
    levels = []
    for c, (low, high) in zip(sorted(int(np.floor(c + 0.5)) for c in centers), tone.LEVEL_RANGES[k]):
        level = max(low, min(high, c))
        levels.append(min(244, levels[-1] + 8) if levels and level <= levels[-1] else level)
    return levels


@pytest.mark.parametrize("k", [3, 4])
def test_tone_levels(spark, k):
    rng = np.random.default_rng(k)
    values = np.clip(np.concatenate([rng.normal(m, 12, 600) for m in (30, 120, 170, 245)]), 0, 255).astype(int).reshape(60, 40)
    hist = stats.histogram(page(spark, values), "v")
    tones = hist.select("page_id", "h").distinct().withColumn("tones", F.lit(k))
    assert list(tone.tone_levels(hist, tones).first().levels) == reference_levels(values, k)


def test_two_tones_use_otsu(spark):
    values = np.array([[20] * 50 + [230] * 50] * 4)
    hist = stats.histogram(page(spark, values), "v")
    tones = hist.select("page_id", "h").distinct().withColumn("tones", F.lit(2))
    assert stats.otsu(hist).first().threshold == 20
    assert list(tone.tone_levels(hist, tones).first().levels) == [16, 244]


def test_colour_spaces(spark):
    colours = [(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)]
    df = spark.createDataFrame(colours, "r int, g int, b int")
    rgb = [F.col(c) for c in "rgb"]
    lab = [tuple(r.v) for r in df.select(point.rgb_to_lab(*rgb).alias("v")).collect()]
    known = [(255, 128, 128), (0, 128, 128), (136, 208, 195), (224, 42, 211), (82, 207, 20), (137, 128, 128)]
    assert np.abs(np.array(lab) - np.array(known)).max() <= 1
    hsv = [tuple(r.v) for r in df.select(point.rgb_to_hsv(*rgb).alias("v")).collect()]
    assert hsv == [(0, 0, 255), (0, 0, 0), (0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 128)]


def test_brightness_and_contrast(spark):
    v = np.arange(256, dtype=np.float32)
    df = spark.range(256).select(F.col("id").cast("int").alias("v"))
    got = df.select(point.brightness(F.col("v"), 1.05).alias("a"), point.contrast(F.col("v"), 1.4).alias("b")).collect()
    clip = lambda x: np.clip(x, 0, 255).astype(np.uint8).tolist()
    assert [r.a for r in got] == clip(v + 255.0 * (1.05 - 1.0))
    assert [r.b for r in got] == clip(v * 1.4 + 128.0 * (1.0 - 1.4))
    wide = df.select(point.contrast(F.col("v"), 2.0).alias("c"), point.contrast(F.col("v"), 1.0).alias("d")).collect()
    assert [r.c for r in wide] == clip(v * 2 - 128) and [r.d for r in wide] == list(range(256))


def test_four_turns_are_identity(spark, gray):
    px = page(spark, gray)
    for _ in range(4):
        px = warp.rotate(px.withColumn("rotation_degrees", F.lit(90)), ["v"])
    assert (plane(px, "v") == gray).all()
    turned = warp.rotate(page(spark, gray).withColumn("rotation_degrees", F.lit(90)), ["v"])
    assert (plane(turned, "v") == np.rot90(gray, -1)).all()


def test_warp_of_the_whole_page_is_identity(spark, gray):
    h, w = gray.shape
    corners = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    quads = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in corners])], "page_id long, corners array<struct<x int, y int>>")
    warped = plane(warp.warp(page(spark, gray), quads, ["v"], "nearest"), "v")
    assert warped.shape == (h - 1, w - 1)
    assert (warped[0, 0], warped[-1, -1]) == (gray[0, 0], gray[-1, -1])


def test_filters_keep_shape_and_range(spark):
    yy, xx = np.mgrid[0:40, 0:30]
    paper = 200 + (xx + yy) // 4
    paper[10:12, 5:25] = 30
    px = page(spark, paper, name="r").withColumns({"g": F.col("r"), "b": F.col("r")})
    for name in ("magic", "bw", "whiteboard"):
        out = plane(presets.FILTERS[name](px), "r")
        assert out.shape == paper.shape and out.min() >= 0 and out.max() <= 255
        assert out[10:12, 8:22].mean() < out[20:35, 5:25].mean(), name


def test_masks_are_ordered(spark, gray):
    px = masks.sauvola(page(spark, gray), "v", size=15)
    assert (plane(px, "strong") <= plane(px, "soft")).all()


def closed_and_blurred(image, element, sigma):
    """Closing under an ellipse and a Gaussian blur at full size, with plain numpy."""
    r = element // 2
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    inside = (xx / (r + 0.5)) ** 2 + (yy / (r + 0.5)) ** 2 <= 1

    def extreme(a, pick, outside):
        padded = np.pad(a, r, constant_values=outside)
        out = a
        for dy, dx in zip(yy[inside], xx[inside]):
            out = pick(out, padded[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]])
        return out

    grey = extreme(extreme(image.astype(float), np.maximum, -1.0), np.minimum, 999.0)
    n = int(4 * sigma)
    kernel = np.array(nb.gaussian_kernel(2 * n + 1, sigma))
    for _ in range(2):
        padded = np.pad(grey, ((n, n), (0, 0)), mode="reflect")
        grey = sum(w * padded[k : k + grey.shape[0]] for k, w in enumerate(kernel)).T
    return grey


@pytest.mark.parametrize("h,w,element,sigma", [(90, 70, 15, 12.0), (320, 300, 15, 300 / 18), (600, 430, 19, 430 / 18)])
def test_illumination_follows_the_page_size(spark, h, w, element, sigma):
    yy, xx = np.mgrid[0:h, 0:w]
    image = (215 - yy * 50 // h - xx * 20 // w).astype(int)
    image[h // 4 : h // 4 + 4, w // 8 : -w // 8] = 30  # a stroke, closed
    image[h // 2 : h // 2 + h // 6, w // 3 : w // 3 + w // 4] = 40  # a picture, kept
    got = plane(nb.illumination(page(spark, image), "v", "s"), "s")
    want = closed_and_blurred(image, element, sigma)
    assert np.abs(got - want).mean() < 3.5 and np.abs(got - want).max() < 25
    # A surface of the smallest element and blur is far from this one on large pages.
    if h > 500:
        assert np.abs(closed_and_blurred(image, 15, 12.0) - want).max() > 2 * np.abs(got - want).max()


def test_tone_fit_says_whether_it_converged(spark):
    values = np.random.default_rng(3).integers(0, 256, (40, 40))
    hist = stats.histogram(page(spark, values), "v")
    tones = hist.select(*stats.PAGE).distinct().withColumn("tones", F.lit(4))
    assert tone.tone_levels(hist, tones).first().converged
    assert not tone.tone_levels(hist, tones, rounds=1).first().converged


def test_samples_are_whole_without_limits(spark):
    values = np.full((200, 200), 250)
    values[:2] = 20
    hist = stats.histogram(page(spark, values), "v")
    whole = {r.v: r.n for r in tone.quantization_sample(hist).collect()}
    assert whole == {250: 39_600, 20: 400}
    assert {r.v: r.n for r in tone.quantization_sample(hist, bright_minimum=500).collect()} == {250: 800, 20: 400}
    assert {r.v: r.weight for r in tone.weighted_bins(hist).collect()} == {250: 39_600.0, 20: 400.0}


def test_bw_at_twice_the_size_keeps_the_shape(spark):
    paper = np.full((24, 20), 210)
    paper[10:12, 4:16] = 30
    px = page(spark, paper, name="r").withColumns({"g": F.col("r"), "b": F.col("r")})
    out = plane(presets.document_bw(px, upscale=2), "r")
    assert out.shape == paper.shape and out[10:12, 6:14].mean() < out[16:22].mean()


@pytest.mark.parametrize("w", [7, 59, 60, 61, 130])
@pytest.mark.parametrize("size", [3, 5, 9])
def test_packed_masks_equal_pixel_steps(spark, w, size):
    mask = (np.random.default_rng(w).random((23, w)) > 0.6).astype(int)
    px = page(spark, mask, 10, 9)
    assert (plane(nb.unpack_mask(nb.pack_mask(px, "v"), "v"), "v") == mask).all()
    for steps, pixels in (
        ([("dilate", size)], nb.dilate(px, "v", size)),
        ([("erode", size)], nb.erode(px, "v", size)),
    ):
        assert (plane(nb.mask_steps(px, "v", steps), "v") == plane(pixels, "v")).all()


def test_settled_scanlines_are_the_same(spark):
    image = np.random.default_rng(5).integers(0, 256, (37, 11))
    px = page(spark, image, 10, 3).withColumn("tag", F.lit(7))
    key = lambda df: sorted(map(str, df.collect()))
    settled = grid.settle(px, ["tag"])
    assert key(settled.select(px.columns)) == key(px)
    total = F.aggregate("v", F.lit(0), lambda s, v: s + v)
    summed = grid.settle(px.drop("tag"), totals={"all": (total, "sum"), "top": (F.array_max("v"), "max")}, band_rows=10)
    assert {(r["all"], r["top"]) for r in summed.collect()} == {(int(image.sum()), int(image.max()))}
    assert key(summed.select(px.drop("tag").columns)) == key(px.drop("tag"))
    marks = spark.createDataFrame([(1, b, y, f"m{y}") for b in range(4) for y in range(0, 37, 5)], "page_id int, band int, y int, value string")
    marks = marks.withColumn("page_id", F.lit(px.first().page_id))
    assert all(r["_beside"] == f"m{r.y // 5 * 5}" for r in grid.settle(px.drop("tag"), beside=marks).collect())


def test_filters_read_once_and_run_nothing_early(spark, tmp_path):
    image = np.full((24, 20), 210)
    image[10:12, 4:16] = 30
    px = page(spark, image, name="r").withColumns({"g": F.col("r"), "b": F.col("r")})
    px.write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    pages = px.select(F.col("page_id").alias("id"), F.lit("whiteboard").alias("filter_name")).distinct()
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    context = spark.sparkContext
    context.setJobGroup("building", "building a filter")
    try:
        done = presets.apply_filters(pages, px, ["sharpen", "whiteboard"])
        assert len(context.statusTracker().getJobIdsForGroup("building")) == 0
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(done.collect()) == 24
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 4


def brute_split(values, weights, k):
    """Best split of ascending values into k runs, by trying all."""
    import itertools

    best = None
    for cut in itertools.combinations(range(1, len(values)), k - 1):
        runs = list(zip((0, *cut), (*cut, len(values))))
        means = [np.average(values[a:b], weights=weights[a:b]) for a, b in runs]
        cost = sum((weights[a:b] * (values[a:b] - m) ** 2).sum() for (a, b), m in zip(runs, means))
        if best is None or cost < best[0] - 1e-9:
            best = (cost, means)
    return best[1]


@pytest.mark.parametrize("k", [3, 4])
def test_exact_tones_are_the_best_split(spark, k):
    rng = np.random.default_rng(20 + k)
    for size in (5, 9, 14):
        values = np.sort(rng.choice(256, size, replace=False))
        weights = rng.integers(1, 60, size)
        hist = spark.createDataFrame([(1, 8, int(v), int(n)) for v, n in zip(values, weights)], "page_id int, h int, v int, n long")
        found = tone.page_bins(hist).select(tone.exact_centers(F.col("bins"), k).alias("c")).first().c
        assert found == pytest.approx(brute_split(values, weights, k))


def test_exact_tones_of_few_values(spark):
    hist = spark.createDataFrame([(1, 8, 90, 5)], "page_id int, h int, v int, n long")
    assert tone.page_bins(hist).select(tone.exact_centers(F.col("bins"), 4).alias("c")).first().c == [90.0] * 4
    two = spark.createDataFrame([(1, 8, 90, 5), (1, 8, 200, 1)], "page_id int, h int, v int, n long")
    assert set(tone.page_bins(two).select(tone.exact_centers(F.col("bins"), 3).alias("c")).first().c) == {90.0, 200.0}


@pytest.mark.parametrize("seed", range(3))
def test_page_fits_equal_their_table_forms(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(*((0, 256), (180, 256), (230, 244))[seed], (20, 30))
    hist = stats.histogram(page(spark, values), "v")
    whole = tone.fitted_tones(hist).first()
    counted = stats.tone_count(hist)
    assert whole.tones == counted.first().tones
    assert list(whole.levels) == list(tone.tone_levels(hist, counted).first().levels)
