"""Raster queries with their SQL checks.

Planes are compared whole: each image row becomes the text of its values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scanloom.plans import fixtures as fx
from scanloom.plans.fixtures import SQL_PIXELS
from scanloom.raster import masks, point, stats
from scanloom.raster.grid import as_text, map_planes
from scanloom.raster.presets import RGB, light_preset, to_lab
from scanloom.registry import query

P = f"WITH {SQL_PIXELS}"


def rasters(spark, sf):
    return fx.page_rasters(spark, sf)


def text_sql(source: str, *planes: str) -> str:
    lines = ", ".join(f"string_agg({p}::varchar, ',' ORDER BY x) AS {p}" for p in planes)
    return f"SELECT page_id, y, {lines} FROM {source} GROUP BY page_id, y"


def sf32(value: float) -> str:
    return f"({float(np.float32(value))!r}::FLOAT)"


def clamp_sql(value: str) -> str:
    return f"greatest(0, least(255, cast(trunc({value}) AS int)))"


def round_sql(value: str) -> str:
    return f"greatest(0, least(255, cast(floor({value} + 0.5) AS int)))"


def bright_sql(v: str, k: float) -> str:
    return clamp_sql(f"{v}::FLOAT + {sf32(255.0 * (k - 1.0))}")


def contrast_sql(v: str, k: float) -> str:
    return clamp_sql(f"{v}::FLOAT * {sf32(k)} + {sf32(128.0 * (1.0 - k))}")


def saturate_sql(k: float) -> dict[str, str]:
    w = point.SATURATION_WEIGHTS
    return {
        c: clamp_sql(" + ".join(
            f"{sf32(w[i] * (1.0 - k) + (k if i == own else 0.0))} * {d}::FLOAT" for i, d in enumerate("rgb")))
        for own, c in enumerate("rgb")
    }


GRAY_SQL = clamp_sql(" + ".join(f"{c}::FLOAT * {sf32(w)}" for c, w in zip("rgb", point.SATURATION_WEIGHTS)))
LUMA_SQL = round_sql("(r * 0.299::double + g * 0.587::double + b * 0.114::double)")
GRAY_PX = f"gray AS (SELECT page_id, y, x, {LUMA_SQL} AS v FROM px)"


def with_luma(spark, sf):
    return map_planes(rasters(spark, sf), RGB, point.luma, ["v"])


# --- statistics ------------------------------------------------------------------------------------

HIST_SQL = P + f", {GRAY_PX}, hist AS (SELECT page_id, v, count(*) AS n FROM gray GROUP BY 1, 2)"


@query("pixel_histogram", HIST_SQL + " SELECT page_id, v, n FROM hist")
def pixel_histogram(spark, sf):
    return stats.histogram(with_luma(spark, sf), "v").select("page_id", "v", "n")


SORTED_SQL = P + f""", {GRAY_PX}, srt AS (SELECT page_id, v, row_number() OVER (PARTITION BY page_id ORDER BY v) - 1 AS k,
  count(*) OVER (PARTITION BY page_id) AS n FROM gray)"""


def nearest_sql(p: float) -> str:
    return f"min(v) FILTER (k = greatest(0, least(n - 1, trunc(n * {p}::double))))"


@query("percentile_nearest", SORTED_SQL + f"""
SELECT page_id, {nearest_sql(0.005)} AS p005, {nearest_sql(0.18)} AS p18, {nearest_sql(0.995)} AS p995 FROM srt GROUP BY page_id""")
def percentile_nearest(spark, sf):
    h = stats.histogram(with_luma(spark, sf), "v")
    found = stats.percentiles(h, p005=stats.nearest(0.005), p18=stats.nearest(0.18), p995=stats.nearest(0.995))
    return found.drop("h")


@query("percentile_linear", P + f""", {GRAY_PX}
SELECT page_id, round(quantile_cont(v, 0.10), 6) AS p10, round(quantile_cont(v, 0.55), 6) AS p55,
  round(quantile_cont(v, 0.90), 6) AS p90 FROM gray GROUP BY page_id""")
def percentile_linear(spark, sf):
    h = stats.histogram(with_luma(spark, sf), "v")
    found = stats.percentiles(h, p10=stats.linear(0.10), p55=stats.linear(0.55), p90=stats.linear(0.90))
    return found.select("page_id", *[F.round(c, 6).alias(c) for c in ("p10", "p55", "p90")])


@query("otsu_threshold", HIST_SQL + """, c AS (SELECT page_id, v, sum(n) OVER w AS bw, sum(n * v) OVER w AS bs,
  sum(n) OVER (PARTITION BY page_id) AS tw, sum(n * v) OVER (PARTITION BY page_id) AS ts FROM hist
  WINDOW w AS (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, bw::double * (tw - bw)::double * pow(bs::double / bw - (ts - bs)::double / (tw - bw), 2) AS var FROM c WHERE tw > bw)
SELECT page_id, coalesce(arg_max(v, [var, -v]), 127) AS threshold FROM s GROUP BY page_id""")
def otsu_threshold(spark, sf):
    return stats.otsu(stats.histogram(with_luma(spark, sf), "v")).select("page_id", "threshold")


@query("tone_count", P + f""", {GRAY_PX}, q AS (SELECT page_id, quantile_cont(v, 0.10) AS q10, quantile_cont(v, 0.50) AS q50,
  count(*) FILTER (v >= 96 AND v < 220) / count(*)::double AS mid FROM gray GROUP BY 1)
SELECT page_id, round(q10, 6) AS q10, round(q50, 6) AS q50, round(mid, 6) AS mid_ratio,
  CASE WHEN q10 >= 232 AND q50 - q10 < 12 THEN 2 WHEN q10 >= 185 AND q50 - q10 < 60 AND mid < 0.12 THEN 3 ELSE 4 END AS tones FROM q""")
def tone_count(spark, sf):
    t = stats.tone_count(stats.histogram(with_luma(spark, sf), "v"))
    return t.select("page_id", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "mid_ratio")], "tones")


@query("masked_mean", P + f""", {GRAY_PX}, m AS (SELECT p.page_id, p.r, p.b, g.v FROM px p JOIN gray g USING (page_id, y, x))
SELECT page_id, count(*) FILTER (v > 200) AS masked, round(coalesce(avg(r) FILTER (v > 200), 128), 6) AS mean_r,
  round(coalesce(avg(b) FILTER (v > 200), 128), 6) AS mean_b FROM m GROUP BY 1""")
def masked_mean(spark, sf):
    marked = map_planes(with_luma(spark, sf), ["v"], lambda v: masks.above(v, 200), ["m"])
    found = stats.masked_mean(marked, ["r", "b"], "m")
    return found.select("page_id", "masked", *[F.round(c, 6).alias(c) for c in ("mean_r", "mean_b")])


@query("line_bright_ratio", P + f""", {GRAY_PX}
SELECT page_id, 'y' AS axis, y AS at, round(count(*) FILTER (v > 190) / count(*)::double, 6) AS ratio FROM gray GROUP BY 1, 3
UNION ALL SELECT page_id, 'x', x, round(count(*) FILTER (v > 190) / count(*)::double, 6) FROM gray GROUP BY 1, 3""")
def line_bright_ratio(spark, sf):
    px = with_luma(spark, sf)
    sides = [
        stats.line_bright_ratio(px, "v", a, 190).select("page_id", F.lit(a).alias("axis"), "at", F.round("ratio", 6).alias("ratio"))
        for a in "yx"
    ]
    return sides[0].unionByName(sides[1])


@query("trim_bounds", P + f""", {GRAY_PX}, ry AS (SELECT page_id, y, count(*) FILTER (v > 18) / count(*)::double AS q FROM gray GROUP BY 1, 2),
rx AS (SELECT page_id, x, count(*) FILTER (v > 18) / count(*)::double AS q FROM gray GROUP BY 1, 2),
ey AS (SELECT page_id, coalesce(min(y) FILTER (q > 0.65), 0) AS t, coalesce(max(y) FILTER (q > 0.65) + 1, 32) AS bo FROM ry GROUP BY 1),
ex AS (SELECT page_id, coalesce(min(x) FILTER (q > 0.65), 0) AS l, coalesce(max(x) FILTER (q > 0.65) + 1, 24) AS r FROM rx GROUP BY 1),
e AS (SELECT *, bo - t < 16 OR r - l < 12 AS small FROM ey JOIN ex USING (page_id))
SELECT page_id, CASE WHEN small THEN 0 ELSE t END AS top, CASE WHEN small THEN 32 ELSE bo END AS bottom,
  CASE WHEN small THEN 0 ELSE l END AS "left", CASE WHEN small THEN 24 ELSE r END AS "right" FROM e""")
def trim_bounds(spark, sf):
    return stats.trim_bounds(with_luma(spark, sf), "v")


@query("center_border_mean", P + f""", {GRAY_PX}, w AS (SELECT *, (y < 1)::int + (y >= 31)::int + (x < 1)::int + (x >= 23)::int AS k FROM gray)
SELECT page_id, round(avg(v) FILTER (y >= 5 AND y < 26 AND x >= 4 AND x < 20), 6) AS center_mean,
  round(sum(v * k) / sum(k)::double, 6) AS border_mean FROM w GROUP BY 1""")
def center_border_mean(spark, sf):
    found = stats.center_border_mean(with_luma(spark, sf), "v")
    return found.select("page_id", *[F.round(c, 6).alias(c) for c in ("center_mean", "border_mean")])


# --- pointwise --------------------------------------------------------------------------------------


@query("adjusted_pixels", P + f""", t AS (SELECT page_id, y, x, {bright_sql('r', 1.05)} AS bright, {contrast_sql('g', 1.4)} AS hard,
  {GRAY_SQL} AS gray, {LUMA_SQL} AS luma FROM px) """ + text_sql("t", "bright", "hard", "gray", "luma"))
def adjusted_pixels(spark, sf):
    px = map_planes(rasters(spark, sf), RGB, lambda r, g, b: {
        "bright": point.brightness(r, 1.05), "hard": point.contrast(g, 1.4),
        "gray": point.grayscale(r, g, b), "luma": point.luma(r, g, b)}, ["bright", "hard", "gray", "luma"])
    return as_text(px, "bright", "hard", "gray", "luma")


_SAT = saturate_sql(2.0)


@query("saturated_pixels", P + f", t AS (SELECT page_id, y, x, {', '.join(f'{_SAT[c]} AS {c}' for c in 'rgb')} FROM px) " + text_sql("t", *RGB))
def saturated_pixels(spark, sf):
    return as_text(map_planes(rasters(spark, sf), RGB, lambda r, g, b: point.saturate(r, g, b, 2.0), RGB), *RGB)


def steps_sql(out: str) -> str:
    """CTE of both light presets of every pixel: sr, sg, sb and vr, vg, vb."""
    sharpen = ", ".join(f"{bright_sql('(' + contrast_sql(c, 1.4) + ')', 1.05)} AS s{c}" for c in "rgb")
    vivid = ", ".join(f"{contrast_sql('(' + _SAT[c] + ')', 1.2)} AS v{c}" for c in "rgb")
    return f"{out} AS (SELECT page_id, y, x, {sharpen}, {vivid} FROM px)"


@query("light_presets", P + f", {steps_sql('t')} " + text_sql("t", "sr", "sg", "sb", "vr", "vg", "vb"))
def light_presets(spark, sf):
    px = rasters(spark, sf)
    both = px.withColumns({f"_{c}": F.col(c) for c in RGB})
    sharp = light_preset(both, "sharpen").withColumns({f"s{c}": F.col(c) for c in RGB}).withColumns({c: F.col(f"_{c}") for c in RGB})
    vivid = light_preset(sharp, "vivid").withColumns({f"v{c}": F.col(c) for c in RGB})
    return as_text(vivid, "sr", "sg", "sb", "vr", "vg", "vb")


def _matrix_sql(name: str, tag: str) -> str:
    rows = point.preset_matrix(point.PRESET_OPS[name])
    return ", ".join(
        f"{round_sql(f'(r * {m[0]!r}::double + g * {m[1]!r}::double + b * {m[2]!r}::double + {m[3]!r}::double)')} AS {tag}{c}"
        for c, m in zip("rgb", rows)
    )


@query("light_presets_one_matrix", P + f", t AS (SELECT page_id, y, x, {_matrix_sql('sharpen', 's')}, {_matrix_sql('vivid', 'v')} FROM px) "
       + text_sql("t", "sr", "sg", "sb", "vr", "vg", "vb"))
def light_presets_one_matrix(spark, sf):
    px = rasters(spark, sf)
    for tag, name in (("s", "sharpen"), ("v", "vivid")):
        rows = point.preset_matrix(point.PRESET_OPS[name])
        outs = [f"{tag}{c}" for c in RGB]
        # The steps run when the loop is over, so each holds its own matrix and name.
        px = map_planes(px, RGB, lambda r, g, b, rows=rows, tag=tag: {
            f"{tag}{c}": v for c, v in point.affine_matrix(r, g, b, rows).items()}, outs)
    return as_text(px, "sr", "sg", "sb", "vr", "vg", "vb")


# --- colour spaces ------------------------------------------------------------------------------------


def _lin(c: str) -> str:
    return f"(CASE WHEN {c}/255.0::double <= 0.04045 THEN {c}/255.0::double/12.92 ELSE pow(({c}/255.0::double + 0.055)/1.055, 2.4) END)"


def _labf(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t}*7.787::double + 16.0::double/116.0 END)"


def _row(m, *names) -> str:
    return "(" + " + ".join(f"({k!r})::double*{n}" for k, n in zip(m, names)) + ")"


LAB_SQL = f"""lin AS (SELECT page_id, y, x, {', '.join(f'{_lin(c)} AS l{c}' for c in 'rgb')} FROM px),
xyz AS (SELECT page_id, y, x, {', '.join(f"{_row(m, 'lr', 'lg', 'lb')} AS {n}" for m, n in zip(point.RGB_TO_XYZ, ('cx', 'cy', 'cz')))} FROM lin),
lab AS (SELECT page_id, y, x, {round_sql("(CASE WHEN cy > 0.008856 THEN cbrt(cy)*116.0 - 16.0 ELSE cy*903.3::double END * 255.0 / 100.0)")} AS l,
  {round_sql(f"(({_labf('(cx/0.950456::double)')} - {_labf('cy')})*500.0 + 128.0)")} AS a,
  {round_sql(f"(({_labf('cy')} - {_labf('(cz/1.088754::double)')})*200.0 + 128.0)")} AS bb FROM xyz)"""


def lab_back_sql(source: str, out: str, l: str = "l", a: str = "a", bb: str = "bb", keep: str = "") -> str:  # noqa: E741
    inv = lambda f: f"(CASE WHEN {f} > 0.206893 THEN pow({f}, 3) ELSE ({f} - 16.0::double/116.0)/7.787 END)"
    gam = lambda v: round_sql(f"(CASE WHEN {v} <= 0.0031308 THEN {v}*12.92 ELSE pow(greatest({v}, 0), 1.0::double/2.4)*1.055 - 0.055 END * 255.0)")
    return f"""{out}_1 AS (SELECT *, {l}*(100.0::double/255.0) AS li_ FROM {source}),
{out}_2 AS (SELECT *, CASE WHEN li_ <= 8 THEN li_/903.3 ELSE pow((li_+16)/116.0, 3) END AS y_,
  CASE WHEN li_ <= 8 THEN li_/903.3*7.787 + 16.0::double/116.0 ELSE (li_+16)/116.0 END AS fy_ FROM {out}_1),
{out}_3 AS (SELECT *, ({a}-128)/500.0::double + fy_ AS fx_, fy_ - ({bb}-128)/200.0::double AS fz_ FROM {out}_2),
{out}_4 AS (SELECT *, {inv('fx_')}*0.950456::double AS x_, {inv('fz_')}*1.088754::double AS z_ FROM {out}_3),
{out}_5 AS (SELECT *, {', '.join(f"{_row(m, 'x_', 'y_', 'z_')} AS q{c}_" for m, c in zip(point.XYZ_TO_RGB, 'rgb'))} FROM {out}_4),
{out} AS (SELECT page_id, y, x{keep}, {', '.join(f"{gam(f'q{c}_')} AS {c}" for c in 'rgb')} FROM {out}_5)"""


@query("lab_planes", P + f", {LAB_SQL} " + text_sql("lab", "l", "a", "bb"))
def lab_planes(spark, sf):
    return as_text(to_lab(rasters(spark, sf)), "l", "a", "bb")


@query("lab_round_trip", P + f", {LAB_SQL}, {lab_back_sql('lab', 'rgb2')} " + text_sql("rgb2", *RGB))
def lab_round_trip(spark, sf):
    return as_text(map_planes(to_lab(rasters(spark, sf)), ["l", "a", "bb"], point.lab_to_rgb, RGB), *RGB)


def hsv_sql(source: str, out: str, keep: str = "") -> str:
    return f"""{out}_0 AS (SELECT *, greatest(r, g, b) AS mx_, greatest(r, g, b) - least(r, g, b) AS dl_ FROM {source}),
{out}_1 AS (SELECT *, CASE WHEN dl_ = 0 THEN 0.0::double WHEN mx_ = r THEN 30.0::double*(g-b)/dl_ WHEN mx_ = g THEN 30.0::double*(b-r)/dl_ + 60.0
  ELSE 30.0::double*(r-g)/dl_ + 120.0 END AS tn_ FROM {out}_0),
{out} AS (SELECT page_id, y, x{keep}, cast(floor(CASE WHEN tn_ < 0 THEN tn_ + 180 ELSE tn_ END + 0.5) AS int) % 180 AS hue,
  CASE WHEN mx_ = 0 THEN 0 ELSE cast(floor(255.0::double*dl_/mx_ + 0.5) AS int) END AS sat, mx_ AS val FROM {out}_1)"""


def hsv_back_sql(source: str, out: str) -> str:
    def pick(order) -> str:
        cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(order))
        return round_sql(f"(CASE s_ {cases} END)")

    return f"""{out}_1 AS (SELECT *, cast(floor(hue/30.0::double) AS int) % 6 AS s_, hue/30.0::double - floor(hue/30.0::double) AS f_, sat/255.0::double AS k_,
  val::double AS v_ FROM {source}),
{out}_2 AS (SELECT *, val*(1-k_) AS p_, val*(1-f_*k_) AS q_, val*(1-(1-f_)*k_) AS t_ FROM {out}_1),
{out} AS (SELECT page_id, y, x, {pick(('v_', 'q_', 'p_', 'p_', 't_', 'v_'))} AS r, {pick(('t_', 'v_', 'v_', 'q_', 'p_', 'p_'))} AS g,
  {pick(('p_', 'p_', 't_', 'v_', 'v_', 'q_'))} AS b FROM {out}_2)"""


@query("hsv_planes", P + f", {hsv_sql('px', 'hsv')} " + text_sql("hsv", "hue", "sat", "val"))
def hsv_planes(spark, sf):
    return as_text(map_planes(rasters(spark, sf), RGB, point.rgb_to_hsv, ["hue", "sat", "val"]), "hue", "sat", "val")


@query("hsv_round_trip", P + f", {hsv_sql('px', 'hsv')}, {hsv_back_sql('hsv', 'rgb2')} " + text_sql("rgb2", *RGB))
def hsv_round_trip(spark, sf):
    px = map_planes(rasters(spark, sf), RGB, point.rgb_to_hsv, ["hue", "sat", "val"])
    return as_text(map_planes(px, ["hue", "sat", "val"], point.hsv_to_rgb, RGB), *RGB)


CHROMA_SQL = clamp_sql("sqrt(((a::FLOAT-128.0::FLOAT)*(a::FLOAT-128.0::FLOAT) + (bb::FLOAT-128.0::FLOAT)*(bb::FLOAT-128.0::FLOAT))::double)")


@query("chroma_plane", P + f", {LAB_SQL}, t AS (SELECT page_id, y, x, {CHROMA_SQL} AS c FROM lab) " + text_sql("t", "c"))
def chroma_plane(spark, sf):
    return as_text(map_planes(to_lab(rasters(spark, sf)), ["a", "bb"], point.chroma, ["c"]), "c")


@query("color_richness", P + f""", {LAB_SQL}, {hsv_sql('px', 'hsv')}, d AS (SELECT h.page_id, count(*) FILTER (l > 48) AS n,
  count(*) FILTER (l > 48 AND sat > 18) AS c FROM hsv h JOIN lab USING (page_id, y, x) GROUP BY 1)
SELECT page_id, round(CASE WHEN n = 0 THEN 0 ELSE least(1.0, greatest(0.0, (c::double/n - 0.025)/0.14)) END, 6) AS richness FROM d""")
def color_richness(spark, sf):
    px = map_planes(to_lab(rasters(spark, sf)), RGB, lambda r, g, b: point.rgb_to_hsv(r, g, b)["sat"], ["sat"])
    seen = map_planes(px, ["l"], masks.visible, ["seen"])
    return stats.color_richness(seen, "sat", "seen").select("page_id", F.round("richness", 6).alias("richness"))


# --- masks and channel operators ------------------------------------------------------------------------


@query("threshold_masks", P + f""", {LAB_SQL}, t AS (SELECT page_id, y, x, (l > 150)::int AS hi, (l <= 150)::int AS lo,
  (l > 150 AND bb > 130)::int AS both_, (l > 150 OR bb > 130)::int AS any_, (NOT l > 150)::int AS not_, (l > 48)::int AS seen, (l > 42)::int AS seen42
  FROM lab) """ + text_sql("t", "hi", "lo", "both_", "any_", "not_", "seen", "seen42"))
def threshold_masks(spark, sf):
    names = ["hi", "lo", "both_", "any_", "not_", "seen", "seen42"]
    px = map_planes(to_lab(rasters(spark, sf)), ["l", "bb"], lambda v, b: {
        "hi": masks.above(v, 150), "lo": masks.at_most(v, 150),
        "both_": masks.both(masks.above(v, 150), masks.above(b, 130)),
        "any_": masks.either(masks.above(v, 150), masks.above(b, 130)),
        "not_": masks.negate(masks.above(v, 150)), "seen": masks.visible(v), "seen42": masks.visible(v, 42)}, names)
    return as_text(px, *names)


def blend_sql(v: str, mask: str, target: float, strength: float) -> str:
    share = np.float32(255.0) * np.float32(strength / 255.0)
    moved = clamp_sql(f"{v}::FLOAT * {sf32(np.float32(1.0) - share)} + {sf32(np.float32(target) * share)}")
    return f"CASE WHEN {mask} > 0 THEN {moved} ELSE {v} END"


@query("channel_operators", P + f""", {LAB_SQL}, m AS (SELECT *, (l > 150)::int AS m FROM lab), t AS (SELECT page_id, y, x,
  {clamp_sql(f'(a::FLOAT - {sf32(128)}) * {sf32(0.42)} + {sf32(128)}')} AS squeezed, {contrast_sql('l', 1.48)} AS hard,
  {clamp_sql(f'bb::FLOAT - {sf32(12.5)}')} AS shifted, {blend_sql('l', 'm', 244.0, 0.34)} AS toward,
  greatest(0, least(255, cast(round_even(l*0.58::double + a*0.42::double, 0) AS int))) AS blended,
  CASE WHEN m > 0 THEN {clamp_sql(f'l::FLOAT * ({sf32(1)} - {sf32(0.3)}) + bb::FLOAT * {sf32(0.3)}')} ELSE l END AS mixed,
  CASE WHEN m > 0 THEN least(l, {clamp_sql(f'bb::FLOAT * {sf32(0.92)}')}) ELSE l END AS capped FROM m) """
       + text_sql("t", "squeezed", "hard", "shifted", "toward", "blended", "mixed", "capped"))
def channel_operators(spark, sf):
    names = ["squeezed", "hard", "shifted", "toward", "blended", "mixed", "capped"]
    px = map_planes(to_lab(rasters(spark, sf)), ["l"], lambda v: masks.above(v, 150), ["m"])
    px = map_planes(px, ["l", "a", "bb", "m"], lambda v, a, b, m: {
        "squeezed": point.compress_chroma(a, 0.42), "hard": point.contrast(v, 1.48),
        "shifted": point.shift(b, np.float64(140.5)), "toward": point.blend_toward(v, m, 244.0, 0.34),
        "blended": point.weighted_blend(v, a, 0.58), "mixed": point.masked_blend(v, b, m, 0.3),
        "capped": point.masked_min_scaled(v, b, m, 0.92)}, names)
    return as_text(px, *names)


@query("accent_boost", P + f""", {hsv_sql('px', 'hsv')}, t AS (SELECT page_id, y, x, hue,
  CASE WHEN sat > 40 THEN {clamp_sql(f'sat::FLOAT*{sf32(1.38)} + {sf32(8)}')} ELSE sat END AS sat,
  CASE WHEN sat > 40 THEN {clamp_sql(f'val::FLOAT*{sf32(1.05)} + {sf32(2)}')} ELSE val END AS val FROM hsv) """ + text_sql("t", "hue", "sat", "val"))
def accent_boost(spark, sf):
    px = map_planes(rasters(spark, sf), RGB, point.rgb_to_hsv, ["hue", "sat", "val"])
    px = map_planes(px, ["sat"], lambda s: masks.above(s, 40), ["accent"])
    return as_text(map_planes(px, ["hue", "sat", "val", "accent"], point.accent_boost, ["hue", "sat", "val"]), "hue", "sat", "val")
