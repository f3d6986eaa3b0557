"""The page filters: sharpen, vivid, magic, bw and whiteboard, as chains of raster operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.operators.catalog import preset_key
from scanloom.raster import masks, neighbourhood as nb, point, stats, tone
from scanloom.raster.grid import (
    POSITION, attach, by_size, map_bands, map_planes, only, rows_in_order, settle, to_bands, whole, without,
)
from scanloom.raster.warp import resize_nearest

RGB = ["r", "g", "b"]


def light_preset(px: DataFrame, name: str, mode: str = "docs") -> DataFrame:
    """``sharpen`` or ``vivid``. ``docs`` clamps after each operator, ``app`` once, after one matrix."""
    ops = point.PRESET_OPS[name]
    if mode == "app":
        rows = point.preset_matrix(ops)
        return map_planes(px, RGB, lambda r, g, b: point.affine_matrix(r, g, b, rows), RGB)
    for op, k in ops:
        # The steps run when the loop is over, so each holds its own operator.
        px = map_planes(px, RGB, lambda r, g, b, op=op, k=k: point.OPERATORS[op]({"r": r, "g": g, "b": b}, k), RGB)
    return px


def to_lab(px: DataFrame) -> DataFrame:
    return map_planes(px, RGB, point.rgb_to_lab, ["l", "a", "bb"])


def flatten(px: DataFrame, plane: str = "l", name: str = "l") -> DataFrame:
    """Divide out uneven lighting."""
    return by_size(px, lambda own: _flattened(own, plane, name))


def _flattened(px: DataFrame, plane: str, name: str) -> DataFrame:
    lit = nb.illumination(px, plane, "_surface")
    if whole(lit):
        evened = lambda v, s: point.flat_field(v, s, stats.mean_of(s))
        return without(map_bands(lit, [plane, "_surface"], evened, [name]), "_surface")
    lit = settle(lit, totals=stats.mean_parts(lit, "_surface")).withColumn("_mean", F.col("_total") / F.col("_size")).drop("_total", "_size")
    return without(map_planes(lit, [plane, "_surface"], point.flat_field, [name], ["_mean"]), "_surface", "_mean")


def auto_stretch(px: DataFrame, plane: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Spread a plane between its dark and bright percentiles."""
    ends = stats.percentiles(stats.histogram(px, plane), _black=stats.nearest(low), _white=stats.nearest(high))
    ends = ends.withColumn("_white", F.greatest(F.col("_black") + 1, F.col("_white")))
    return without(map_planes(attach(px, ends), [plane], point.stretch, [plane], ["_black", "_white"]), "_black", "_white")


def _even_light(px: DataFrame) -> DataFrame:
    """``flatten`` and ``auto_stretch`` with one statistic: both need only how often each lightness lies
    under each level of the surface, at most 65,536 pairs a page."""
    if whole(px):
        return without(map_bands(px, ["l", "_surface"], _evened_and_stretched, ["l"]), "_surface")
    pairs = stats.pair_histogram(px, "l", "_surface")
    page = Window.partitionBy(*stats.PAGE)
    mean = F.sum(F.col("_surface") * F.col("n")).over(page) / F.sum("n").over(page)
    evened = pairs.withColumn("_mean", mean).withColumn("v", point.flat_field(F.col("l"), F.col("_surface"), F.col("_mean")))
    hist = evened.groupBy(*stats.PAGE, "_mean", "v").agg(F.sum("n").alias("n"))
    ends = stats.percentiles(hist, _mean=F.max("_mean"), _black=stats.nearest(0.005), _white=stats.nearest(0.995))
    ends = ends.withColumn("_white", F.greatest(F.col("_black") + 1, F.col("_white")))
    stretched = lambda v, s, mean, black, white: point.stretch(point.flat_field(v, s, mean), black, white)
    page = ["_mean", "_black", "_white"]
    return without(map_planes(attach(px, ends), ["l", "_surface"], stretched, ["l"], page), "_surface", *page)


def _evened_and_stretched(l: np.ndarray, surface: np.ndarray) -> np.ndarray:  # noqa: E741
    """``_even_light`` of whole pages."""
    flat = point.flat_field(l, surface, stats.mean_of(surface))
    values = stats.ranked(flat)
    black = stats.nearest_of(values, 0.005)
    return point.stretch(flat, black, np.fmax(black + 1, stats.nearest_of(values, 0.995)))


def clean_lightness(px: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Colour planes with even, stretched and denoised lightness: the start of the three large filters.

    Settled after the lighting and at the end, so that each page statistic and the scanlines it goes
    back to share what leads there. ``carry`` as in ``grid.settle``.
    """
    lit = settle(nb.illumination(without(to_lab(px), *RGB), "l", "_surface", carry), carry)
    return settle(nb.median3(_even_light(lit), "l", "l"), carry)


def _without(px: DataFrame, mask: str, *others: str) -> DataFrame:
    """Remove other masks from a mask."""
    return map_planes(px, [mask, *others], lambda m, *o: point.least(m, *[masks.negate(x) for x in o]), [mask])


def settle_neutral(px: DataFrame, mask: str) -> DataFrame:
    """The scanlines settled, with colour planes ``na``, ``nb`` moved so that the paper is neutral in
    place of ``a``, ``bb``."""
    if whole(px):
        moved = lambda a, b, m: {
            "na": point.shift(a, stats.masked_mean_of(a, m)), "nb": point.shift(b, stats.masked_mean_of(b, m))
        }
        return without(map_bands(px, ["a", "bb", mask], moved, ["na", "nb"]), "a", "bb")
    settled = settle(px, totals=stats.masked_parts(px, ["a", "bb"], mask)).withColumns(stats.masked_means(["a", "bb"]))
    return map_planes(
        settled,
        ["a", "bb"],
        lambda a, b, mean_a, mean_b: {"na": point.shift(a, mean_a), "nb": point.shift(b, mean_b)},
        ["na", "nb"],
        ["mean_a", "mean_bb"],
    ).select(*[c for c in px.columns if c not in ("a", "bb")], "na", "nb")


def _saturation(l, a, b):  # noqa: E741
    def of(s):
        return point.rgb_to_hsv(s["rgb"]["r"], s["rgb"]["g"], s["rgb"]["b"])["sat"]

    return point.let({"rgb": point.lab_to_rgb(l, a, b)}, of)


def with_richness(px: DataFrame, sat: str, l: str, paper: str) -> DataFrame:  # noqa: E741
    """The scanlines settled, with their page's ``richness`` and ``top_sat``."""
    seen = map_planes(px, [l], lambda v: masks.visible(v), ["_seen"])
    if whole(px):
        taken = lambda s, v, p: {
            "top_sat": np.broadcast_to(stats.top_saturation_of(s, v, p), s.shape),
            "richness": np.broadcast_to(stats.richness_of(s, v), s.shape),
        }
        found = map_bands(seen, [sat, "_seen", paper], taken, ["top_sat", "richness"], {"richness": "double"})
        return without(found, "_seen")
    settled = settle(seen, totals=stats.richness_parts(seen, sat, "_seen", paper), unused=["_seen"])
    return settled.withColumn("richness", stats.richness()).drop("_seen_n", "_vivid_n")


def restore_saturation(px: DataFrame) -> DataFrame:
    """Lift the saturation of content towards the reference.

    Needs planes r, g, b, l, ref_sat, paper, accent, paper_color and the ``richness`` column.
    """

    def lifted(r, g, b, l, ref, paper, accent, colored, rich):  # noqa: E741
        weight = point.least(point.greatest((ref - 10.0) / 34.0, 0.0), 1.0)
        floor = point.greatest(
            ref * (0.40 + weight * 0.24 + rich * 0.24),
            point.choose(accent > 0, ref * (0.74 + rich * 0.18), 0.0),
            point.choose(colored > 0, ref * (0.50 + rich * 0.18), 0.0),
        )
        lift = ((paper == 0) | (colored > 0)) & (l > 48) & (ref > 10)
        hsv = point.rgb_to_hsv(r, g, b)
        sat = point.to_byte(point.greatest(point.double(hsv["sat"]), point.choose(lift, floor, 0.0)))
        return {"hue": hsv["hue"], "sat": sat, "val": hsv["val"]}

    toned = map_planes(
        px, ["r", "g", "b", "l", "ref_sat", "paper", "accent", "paper_color"], lifted, ["hue", "sat", "val"], ["richness"]
    )
    return without(map_planes(toned, ["hue", "sat", "val"], point.hsv_to_rgb, RGB), "hue", "sat", "val")


def magic_step1(px: DataFrame) -> DataFrame:
    """Only the lighting corrected, in colour."""
    colored = lambda flat: only(map_planes(flat, ["l", "a", "bb"], point.lab_to_rgb, RGB), [*POSITION, *RGB])
    return by_size(px, lambda own: colored(flatten(without(to_lab(own), *RGB))))


def magic(px: DataFrame) -> DataFrame:
    """Even lighting, white paper, kept and restored content colour."""
    return by_size(only(px, [*POSITION, *RGB]), lambda own: _magic(clean_lightness(own)))


def _magic(px: DataFrame) -> DataFrame:
    px = masks.with_limits(px, "l", ["paper", "structure"])
    px = masks.structure_mask(masks.paper_mask(px, "l", "paper"), "l", "structure")
    px = nb.mask_steps(without(_without(px, "paper", "structure"), "structure"), "paper", nb.close_steps(5, 2))
    px = without(masks.accent_mask(px, "l", "accent"), "limit_paper", "limit_structure")
    px = map_planes(settle_neutral(px, "paper"), ["l", "na", "nb"], _saturation, ["ref_sat"])
    px = with_richness(px, "ref_sat", "l", "paper")
    px = masks.paper_color_mask(px, "ref_sat", "l", "paper", "accent", "paper_color")

    def compose(l, na, nb_, paper, accent, color, rich):  # noqa: E741
        muted, colored = 0.18 + rich * 0.18, 0.42 + rich * 0.30
        accented, keep = point.least(0.86 + rich * 0.10, 1.0), 0.24 + rich * 0.18
        light = point.weighted_blend(point.blend_toward(l, paper, 244.0, 0.34), l, 0.58)
        light = point.masked_blend(light, l, color, keep)
        factor = point.choose(accent > 0, accented, point.choose(color > 0, colored, muted))
        neutral = (paper > 0) & (color == 0) & (accent == 0)

        def channel(v):
            return point.choose(neutral, 128, point.compress_chroma(v, factor))

        return {"ol": light, "oa": channel(na), "ob": channel(nb_)}

    px = map_planes(px, ["l", "na", "nb", "paper", "accent", "paper_color"], compose, ["ol", "oa", "ob"], ["richness"])
    px = without(map_planes(px, ["ol", "oa", "ob"], point.lab_to_rgb, RGB), "ol", "oa", "ob", "na", "nb")
    return only(restore_saturation(px), [*POSITION, *RGB])


def _bw(px: DataFrame) -> DataFrame:
    px = masks.with_limits(px, "l", ["paper", "dark"])
    px = map_planes(px, ["l"], lambda v: point.contrast(v, 1.48), ["strong_l"])
    px = without(masks.sauvola(masks.paper_mask(px, "l", "paper"), "strong_l"), "a", "bb")
    px = without(map_planes(
        px, ["strong", "l"], lambda s, v, dark: masks.either(s, masks.at_most(v, dark)), ["strong"], ["limit_dark"]
    ), "limit_dark", "limit_paper")
    px = nb.dilate(nb.dilate(px, "soft", 3), "strong", 3)
    px = nb.median3_mask(map_planes(px, ["soft", "strong"], masks.either, ["structure"]), "structure", "structure")
    px = nb.mask_steps(without(_without(px, "paper", "structure"), "soft", "strong"), "paper", nb.close_steps(5, 2))

    def toned(strong, paper, structure):
        v = point.blend_toward(strong, paper, 246.0, 0.44)
        v = point.masked_min_scaled(v, strong, structure, 0.92)
        bright = masks.both(masks.above(v, 182), masks.negate(structure))
        return point.blend_toward(v, bright, 236.0, 0.32)

    px = without(map_planes(px, ["strong_l", "paper", "structure"], toned, ["v"]), "strong_l", "structure", "l")
    px = settle(nb.gaussian(px, "v", nb.BLUR3, "v"))
    if whole(px):
        return only(map_bands(px, ["v", "paper"], tone.to_page_levels, ["v"]), [*POSITION, "v"])
    levels = tone.fitted_tones(stats.histogram(px, "v")).withColumn("_cuts", tone.cuts(F.col("levels")))
    px = attach(px, levels)
    px = map_planes(px, ["v"], tone.quantize, ["v"], ["levels", "_cuts"])
    px = map_planes(px, ["v", "paper"], tone.paper_floor, ["v"], ["levels"])
    return only(px, [*POSITION, "v"])


def document_bw(px: DataFrame, upscale: int = 1) -> DataFrame:
    """A few gray tones. With ``upscale=2`` every page of the call is worked on at twice its size
    (nearest instead of cubic); pages under 1400 pixels gain most from it."""
    px = only(px, [*POSITION, *RGB])
    if upscale not in (1, 2):
        raise ValueError("upscale is 1 or 2")
    toned = lambda px: by_size(px, lambda own: _bw(clean_lightness(own)))
    if upscale == 1:
        return _gray(toned(px))
    return _gray(halve(toned(resize_nearest(px, RGB, F.col("h") * 2, F.col("w") * 2)), "v"))


def _gray(px: DataFrame) -> DataFrame:
    return px.select(*POSITION, *[F.col("v").alias(c) for c in RGB])


def halve(px: DataFrame, plane: str) -> DataFrame:
    """Mean of 2 x 2 blocks, for pages of even size."""
    following = F.lead(plane).over(rows_in_order())
    pairs = px.withColumn("_below", following).filter(F.col("core") & (F.col("y") % 2 == 0))

    def block(x: Column) -> Column:
        corners = [F.get(F.col(line), x * 2 + d) for line in (plane, "_below") for d in (0, 1)]
        return F.floor((corners[0] + corners[1] + corners[2] + corners[3]) / 4 + 0.5).cast("int")

    mean = F.transform(F.sequence(F.lit(0), (F.col("w") / 2).cast("int") - 1), block)
    return to_bands(
        pairs.withColumn("_mean", mean).select(
            "page_id", (F.col("y") / 2).cast("int").alias("y"), (F.col("h") / 2).cast("int").alias("h"),
            (F.col("w") / 2).cast("int").alias("w"), F.col("_mean").alias(plane),
        )
    )


def whiteboard(px: DataFrame) -> DataFrame:
    """White board, kept and boosted marker colours."""
    return by_size(only(px, [*POSITION, *RGB]), lambda own: _whiteboard(clean_lightness(own)))


def _whiteboard(px: DataFrame) -> DataFrame:
    px = masks.with_limits(px, "l", ["paper", "structure", "board"])
    px = masks.accent_mask(px, "l", "accent", whiteboard=True)
    px = nb.dilate(map_planes(px, ["accent"], lambda m: m, ["protect"]), "protect", 3)
    px = masks.structure_mask(px, "l", "structure")
    px = without(masks.sauvola(map_planes(px, ["l"], lambda v: point.contrast(v, 1.22), ["_c"]), "_c", 0.16, 35), "_c", "soft")
    px = map_planes(px, ["structure", "strong", "protect"], lambda s, t, p: point.greatest(s, t, p), ["structure"])
    px = nb.dilate(nb.median3_mask(px, "structure", "structure"), "structure", 3)
    px = map_planes(
        masks.paper_mask(px, "l", "paper"),
        ["paper", "l"], lambda p, v, board: masks.either(p, masks.above(v, board)), ["paper"], ["limit_board"],
    )
    px = without(_without(px, "paper", "structure", "protect"), "structure", "limit_paper", "limit_structure", "limit_board")
    px = settle_neutral(nb.mask_steps(px, "paper", nb.close_steps(5, 2)), "paper")

    def compose(l, na, nb_, paper, accent, protect, strong):  # noqa: E741
        light = point.weighted_blend(point.blend_toward(l, paper, 250.0, 0.50), l, 0.68)
        light = point.masked_min_scaled(light, l, strong, 0.84)
        light = point.masked_min_scaled(light, l, protect, 0.92)

        def channel(v):
            squeezed = point.choose(accent > 0, point.compress_chroma(v, 1.32), point.compress_chroma(v, 0.42))
            return point.choose(paper > 0, 128, squeezed)

        return {"ol": light, "oa": channel(na), "ob": channel(nb_)}

    px = map_planes(px, ["l", "na", "nb", "paper", "accent", "protect", "strong"], compose, ["ol", "oa", "ob"])
    px = map_planes(px, ["ol", "oa", "ob"], point.lab_to_rgb, RGB)
    px = map_planes(px, RGB, point.rgb_to_hsv, ["hue", "sat", "val"])
    px = map_planes(px, ["hue", "sat", "val", "accent"], point.accent_boost, ["hue", "sat", "val"])
    return only(map_planes(px, ["hue", "sat", "val"], point.hsv_to_rgb, RGB), [*POSITION, *RGB])


FILTERS = {
    "sharpen": lambda px: light_preset(px, "sharpen"),
    "vivid": lambda px: light_preset(px, "vivid"),
    "magic": magic,
    "bw": document_bw,
    "whiteboard": whiteboard,
}

# What the large filters do after the cleaned lightness that they share.
AFTER_LIGHTNESS = {"magic": _magic, "bw": lambda px: _gray(_bw(px)), "whiteboard": _whiteboard}


def apply_filters(pages: DataFrame, px: DataFrame, presets: list[str] | None = None) -> DataFrame:
    """Render each page with its own filter: ``pages(id, filter_name)`` with ``px`` planes r, g, b.

    The scanlines are read once, dealt by page for the join with the number of their filter, and settled; every
    filter takes its pages from there. The large filters' pages go through the cleaning of lightness
    together. Pages of unknown or default filters pass unchanged. ``presets`` names the filters
    present, when known, so that others are not planned.
    """
    wanted = list(FILTERS) if presets is None else [p for p in FILTERS if p in presets]
    number = F.array_position(F.lit(wanted), preset_key(F.col("filter_name"))) if wanted else F.lit(0)
    numbered = pages.select(F.col("id").alias("page_id"), number.cast("int").alias("_preset"))
    keyed = px.hint("merge").join(numbered.hint("merge"), "page_id")
    columns = [*POSITION, *RGB]
    shared = settle(keyed.select(*columns, "_preset"), ["_preset"], dealt=True)
    large = [n for n in wanted if n in AFTER_LIGHTNESS]
    numbers = {n: i + 1 for i, n in enumerate(wanted)}
    of = lambda rows, name: rows.filter(F.col("_preset") == numbers[name]).drop("_preset")
    done = shared.filter(F.coalesce(F.col("_preset"), F.lit(0)) == 0).select(*columns)
    for name in wanted:
        if name not in large:
            done = done.unionByName(FILTERS[name](of(shared, name)).select(*columns))
    if large:
        dark = shared.filter(F.col("_preset").isin([numbers[n] for n in large]))
        done = done.unionByName(by_size(dark, lambda own: _after_lightness(own, large, of)).select(*columns))
    return done


def _after_lightness(px: DataFrame, names: list[str], of) -> DataFrame:
    """The large filters, each on ``of(px, name)``. Pages of one band need no shuffle for their lightness, so
    each filter cleans its own."""
    columns = [*POSITION, *RGB]
    if whole(px):
        done = []
        for name in names:
            own = of(px, name)
            own._whole = True
            done.append(AFTER_LIGHTNESS[name](clean_lightness(own)).select(*columns))
    else:
        clean = clean_lightness(px, ["_preset"])
        done = [AFTER_LIGHTNESS[name](of(clean, name)).select(*columns) for name in names]
    return reduce(DataFrame.unionByName, done)
