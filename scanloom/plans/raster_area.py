"""Raster queries that look at neighbours or move pixels, and the page filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.plans import fixtures as fx
from scanloom.plans.fixtures import SQL_PAGE_QUADS
from scanloom.plans.raster import (
    CHROMA_SQL, GRAY_PX, HIST_SQL, LAB_SQL, P, as_text, bright_sql, clamp_sql, contrast_sql, hsv_back_sql, hsv_sql,  # noqa: F401
    rasters, sf32, text_sql, with_luma,
)
from scanloom.raster import grid, masks, neighbourhood as nb, point, presets, stats, tone, warp
from scanloom.raster.grid import POSITION, attach, by_size, map_planes, only, without
from scanloom.raster.presets import RGB, to_lab
from scanloom.registry import query

BY_LINE = "PARTITION BY page_id, y ORDER BY x"
BY_COLUMN = "PARTITION BY page_id, x ORDER BY y"


def morph_sql(src: str, col: str, steps: list[tuple[str, int]], out: str) -> str:
    """Chain of elliptic max/min filters as CTEs, written with windows over pixel rows."""
    ctes, at = [], src
    for i, (op, size) in enumerate(steps):
        pick = {"max": "greatest", "min": "least"}[op]
        shape = nb.ellipse(size)
        wide = ", ".join(
            f"{op}({col}) OVER ({BY_LINE} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS w{r}" for r in sorted(set(shape.values()))
        )
        ctes.append(f"{out}_{i}w AS (SELECT page_id, y, x, {wide} FROM {at})")
        terms = [f"w{shape[0]}"] + [
            f"lag(w{r}, {-dy}) OVER v" if dy < 0 else f"lead(w{r}, {dy}) OVER v" for dy, r in shape.items() if dy
        ]
        at = out if i == len(steps) - 1 else f"{out}_{i}"
        ctes.append(f"{at} AS (SELECT page_id, y, x, {pick}({', '.join(terms)}) AS {col} FROM {out}_{i}w WINDOW v AS ({BY_COLUMN}))")
    return ", ".join(ctes)


def close_steps(size: int, times: int = 1):
    return [("max", size)] * times + [("min", size)] * times


def open_steps(size: int, times: int = 1):
    return [("min", size)] * times + [("max", size)] * times


def blur_sql(
    src: str, col: str, weights: list[float], out: str, border: str, name: str = "v", cols: int = 24, rows: int = 32
) -> str:
    """Separable weighted sums over lists, one line and then one column at a time."""
    r = len(weights) // 2

    def taps(n: int) -> str:
        def at(d: int) -> str:
            i = f"(i + {d})"
            if border == "replicate":
                return f"greatest(0, least({n - 1}, {i}))"
            return f"({n - 1} - abs({n - 1} - abs{i}))"

        return " + ".join(f"vs[{at(k - r)} + 1] * ({w!r})::double" for k, w in enumerate(weights))

    return f"""{out}_a AS (SELECT page_id, y, list({col} ORDER BY x) AS vs FROM {src} GROUP BY 1, 2),
{out}_b AS (SELECT page_id, y, unnest(range({cols})) AS x, unnest(list_transform(range({cols}), lambda i: {taps(cols)})) AS t FROM {out}_a),
{out}_c AS (SELECT page_id, x, list(t ORDER BY y) AS vs FROM {out}_b GROUP BY 1, 2),
{out} AS (SELECT page_id, x, unnest(range({rows})) AS y, unnest(list_transform(range({rows}), lambda i: {taps(rows)})) AS {name} FROM {out}_c)"""


def box_sql(src: str, col: str, k: int, out: str) -> str:
    r = k // 2

    def sums(v: str, axis: str, n: int, over: str) -> str:
        return (f"sum({v}) OVER ({over} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + first_value({v}) OVER ({over}) * greatest(0, {r} - {axis})"
                f" + last_value({v}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * greatest(0, {r} - ({n - 1} - {axis}))")

    return f"""{out}_l AS (SELECT page_id, y, x, {col}, {sums(col, 'x', 24, BY_LINE)} AS s1, {sums(f'({col}*{col})', 'x', 24, BY_LINE)} AS s2 FROM {src}),
{out} AS (SELECT page_id, y, x, {col}, cast({sums('s1', 'y', 32, BY_COLUMN)} AS bigint) AS box_sum, cast({sums('s2', 'y', 32, BY_COLUMN)} AS bigint) AS box_sum2 FROM {out}_l)"""


# --- neighbourhoods ----------------------------------------------------------------------------------

INK_PX = GRAY_PX + ", ink AS (SELECT page_id, y, x, (v < 150)::int AS m FROM gray)"


def ink(spark, sf):
    return map_planes(with_luma(spark, sf), ["v"], lambda v: masks.negate(masks.above(v, 149)), ["m"])


@query("box_sums", P + f", {GRAY_PX}, {box_sql('gray', 'v', 31, 'bx')} " + text_sql("bx", "box_sum", "box_sum2"))
def box_sums(spark, sf):
    return as_text(nb.box_sums(with_luma(spark, sf), "v", 31), "box_sum", "box_sum2")


@query("dilate_erode", P + f""", {INK_PX}, {morph_sql('ink', 'm', [('max', 3)] * 2, 'd3')}, {morph_sql('ink', 'm', [('max', 5)], 'd5')},
{morph_sql('ink', 'm', [('min', 3)], 'e3')}, t AS (SELECT page_id, y, x, d3.m AS wide, d5.m AS wider, e3.m AS thin
  FROM d3 JOIN d5 USING (page_id, y, x) JOIN e3 USING (page_id, y, x)) """ + text_sql("t", "wide", "wider", "thin"))
def dilate_erode(spark, sf):
    px = ink(spark, sf).withColumns({n: F.col("m") for n in ("wide", "wider", "thin")})
    return as_text(nb.erode(nb.dilate(nb.dilate(px, "wide", 3, 2), "wider", 5), "thin", 3), "wide", "wider", "thin")


@query("close_open", P + f""", {INK_PX}, {morph_sql('ink', 'm', close_steps(3, 2), 'c3')}, {morph_sql('ink', 'm', open_steps(3), 'o3')},
{morph_sql('ink', 'm', close_steps(3) * 2, 'r3')}, t AS (SELECT page_id, y, x, c3.m AS closed, o3.m AS opened, r3.m AS repeated
  FROM c3 JOIN o3 USING (page_id, y, x) JOIN r3 USING (page_id, y, x)) """ + text_sql("t", "closed", "opened", "repeated"))
def close_open(spark, sf):
    px = ink(spark, sf).withColumns({n: F.col("m") for n in ("closed", "opened", "repeated")})
    px = nb.open_(nb.close(px, "closed", 3, 2), "opened", 3)
    return as_text(nb.close(px, "repeated", 3, 2, mode="repeated"), "closed", "opened", "repeated")


@query("median3", P + f""", {INK_PX}, n AS (SELECT g.page_id, g.y, g.x, median(h.v) AS v, (sum(k.m) >= 5)::int AS m FROM gray g,
  range(-1, 2) dy(dy), range(-1, 2) dx(dx), gray h, ink k WHERE h.page_id = g.page_id AND h.y = greatest(0, least(31, g.y + dy.dy))
  AND h.x = greatest(0, least(23, g.x + dx.dx)) AND k.page_id = h.page_id AND k.y = h.y AND k.x = h.x GROUP BY 1, 2, 3),
t AS (SELECT page_id, y, x, cast(v AS int) AS v, m FROM n) """ + text_sql("t", "v", "m"))
def median3(spark, sf):
    return as_text(nb.median3_mask(nb.median3(ink(spark, sf), "v", "v"), "m", "m"), "v", "m")


@query("gaussian_blur", P + f""", {GRAY_PX}, {blur_sql('gray', 'v', nb.BLUR3, 'b3', 'reflect')}, {blur_sql('gray', 'v', nb.BLUR5, 'b5', 'reflect')},
t AS (SELECT page_id, y, x, cast(floor(b3.v + 0.5) AS int) AS v3, cast(floor(b5.v + 0.5) AS int) AS v5 FROM b3 JOIN b5 USING (page_id, y, x)) """
       + text_sql("t", "v3", "v5"))
def gaussian_blur(spark, sf):
    px = nb.gaussian(with_luma(spark, sf), "v", nb.BLUR3, "v3")
    return as_text(nb.gaussian(px, "v", nb.BLUR5, "v5"), "v3", "v5")


KERNEL31 = nb.gaussian_kernel(31, 5.0)


def adaptive_sql(src: str, col: str, out: str) -> str:
    return f"""{blur_sql(src, col, KERNEL31, out + '_g', 'replicate', 'mean')},
{out} AS (SELECT s.page_id, s.y, s.x, s.{col}, (s.{col} <= cast(floor(q.mean + 0.5) AS int) - 9)::int AS m FROM {src} s JOIN {out}_g q USING (page_id, y, x))"""


@query("adaptive_threshold", P + f", {GRAY_PX}, {adaptive_sql('gray', 'v', 'ad')} " + text_sql("ad", "m"))
def adaptive_threshold(spark, sf):
    return as_text(nb.adaptive_inverse(with_luma(spark, sf), "v", "m"), "m")


SOBEL = f"""nu AS (SELECT page_id, y, x, v, coalesce(lag(v) OVER c, lead(v) OVER c) AS up, coalesce(lead(v) OVER c, lag(v) OVER c) AS dn FROM gray
  WINDOW c AS ({BY_COLUMN})),
nl AS (SELECT page_id, y, x, {', '.join(f'coalesce(lag({c}) OVER l, lead({c}) OVER l) AS {c}l, coalesce(lead({c}) OVER l, lag({c}) OVER l) AS {c}r, {c}' for c in ('up', 'v', 'dn'))}
  FROM nu WINDOW l AS ({BY_LINE})),
ng AS (SELECT page_id, y, x, upr - upl + 2*(vr - vl) + dnr - dnl AS gx, dnl + 2*dn + dnr - upl - 2*up - upr AS gy FROM nl),
nm AS (SELECT page_id, y, x, sqrt((gx*gx + gy*gy)::double) AS mag FROM ng),
sob AS (SELECT page_id, y, x, cast(CASE WHEN max(mag) OVER p > min(mag) OVER p
  THEN floor((mag - min(mag) OVER p) * (255.0::double / (max(mag) OVER p - min(mag) OVER p))) ELSE 0 END AS int) AS edge FROM nm
  WINDOW p AS (PARTITION BY page_id))"""


def edges(spark, sf):
    def edge(px):
        magnitude = only(nb.sobel_magnitude(px, "v", "_mag"), [*POSITION, "_mag"])
        return without(nb.min_max_normalise(magnitude, "_mag", "edge"), "_mag")

    return by_size(only(with_luma(spark, sf), [*POSITION, "v"]), edge, pages_only=False)


@query("sobel_edges", P + f", {GRAY_PX}, {SOBEL} " + text_sql("sob", "edge"))
def sobel_edges(spark, sf):
    return as_text(edges(spark, sf), "edge")


def _near_sql() -> str:
    tests = []
    for i in range(4):
        j = (i + 1) % 4
        dx, dy = f"(x{j}-x{i})::double", f"(y{j}-y{i})::double"
        t = f"greatest(0.0, least(1.0, ((x-x{i})*{dx} + (y-y{i})*{dy}) / ({dx}*{dx} + {dy}*{dy})))"
        tests.append(f"pow(x - (x{i} + {t}*{dx}), 2) + pow(y - (y{i} + {t}*{dy}), 2) <= 2.25")
    return " OR ".join(tests)


@query("edge_support", P + f""", {GRAY_PX}, {SOBEL}, {SQL_PAGE_QUADS}
SELECT s.page_id, 0 AS cand_id, round(coalesce(avg(edge) FILTER ({_near_sql()}) / 255.0, 0), 6) AS support FROM sob s JOIN pq USING (page_id) GROUP BY 1""")
def edge_support(spark, sf):
    found = warp.edge_support(edges(spark, sf), "edge", fx.page_quads(spark, sf))
    return found.select("page_id", "cand_id", F.round("support", 6).alias("support"))


# --- lightness ------------------------------------------------------------------------------------------


@query("flat_field", P + f""", {LAB_SQL}, s AS (SELECT l.page_id, l.y, l.x, l.l, p.r, avg(p.r) OVER (PARTITION BY l.page_id) AS mean FROM lab l JOIN px p USING (page_id, y, x)),
t AS (SELECT page_id, y, x, {clamp_sql('(l::FLOAT + 1::FLOAT) / (r::FLOAT + 1::FLOAT) * mean::FLOAT')} AS v FROM s) """ + text_sql("t", "v"))
def flat_field(spark, sf):
    px = to_lab(rasters(spark, sf))
    px = attach(px, stats.plane_mean(px, "r", "mean"))
    return as_text(map_planes(px, ["l", "r"], point.flat_field, ["v"], ["mean"]), "v")


STRETCH = f"""sk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM gray),
se AS (SELECT page_id, min(v) FILTER (k = trunc(n * 0.005::double)) AS bk, min(v) FILTER (k = trunc(n * 0.995::double)) AS wh FROM sk GROUP BY 1),
st AS (SELECT g.page_id, g.y, g.x, g.v, bk, greatest(bk + 1, wh) AS wh FROM gray g JOIN se USING (page_id))"""


@query("auto_stretch", P + f""", {GRAY_PX}, {STRETCH}, t AS (SELECT page_id, y, x,
  {clamp_sql('(least(v, wh)::FLOAT - bk::FLOAT) * (255.0::double / (wh - bk))::FLOAT')} AS v FROM st) """ + text_sql("t", "v"))
def auto_stretch(spark, sf):
    return as_text(presets.auto_stretch(with_luma(spark, sf), "v"), "v")


# --- page masks -----------------------------------------------------------------------------------------


def plain_sql(floor: int, p: float, most: int, out: str) -> str:
    return f"""{out}_q AS (SELECT page_id, greatest({floor}, floor(quantile_cont(l, {p}))) AS lim FROM lab GROUP BY 1),
{out} AS (SELECT page_id, y, x, (l > lim AND {CHROMA_SQL} <= {most})::int AS m FROM lab JOIN {out}_q USING (page_id))"""


def lab_only(spark, sf):
    return without(to_lab(rasters(spark, sf)), *RGB)


@query("paper_mask", P + f", {LAB_SQL}, {plain_sql(96, 0.18, 34, 'raw')}, {morph_sql('raw', 'm', close_steps(5, 2) + open_steps(5), 'pm')} " + text_sql("pm", "m"))
def paper_mask(spark, sf):
    return as_text(masks.paper_mask(lab_only(spark, sf), "l", "m"), "m")


@query("paper_candidate_mask", P + f", {LAB_SQL}, {plain_sql(110, 0.55, 42, 'raw')}, {morph_sql('raw', 'm', close_steps(9, 2) + open_steps(9), 'pm')} " + text_sql("pm", "m"))
def paper_candidate_mask(spark, sf):
    return as_text(masks.paper_candidate_mask(lab_only(spark, sf), "l", "m"), "m")


@query("structure_mask", P + f""", {LAB_SQL}, {adaptive_sql('lab', 'l', 'ad')}, sq AS (SELECT page_id, greatest(72, floor(quantile_cont(l, 0.10))) AS lim FROM lab GROUP BY 1),
raw AS (SELECT page_id, y, x, (m = 1 OR l <= lim)::int AS m FROM ad JOIN sq USING (page_id)), {morph_sql('raw', 'm', open_steps(3) + [('max', 3)] * 2, 'sm')} """ + text_sql("sm", "m"))
def structure_mask(spark, sf):
    return as_text(masks.structure_mask(to_lab(rasters(spark, sf)), "l", "m"), "m")


@query("accent_mask", P + f""", {LAB_SQL}, raw AS (SELECT page_id, y, x, ({CHROMA_SQL} > 28 AND l > 48)::int AS m FROM lab), {morph_sql('raw', 'm', open_steps(3), 'am')},
raw2 AS (SELECT l.page_id, l.y, l.x, greatest(m, ({CHROMA_SQL} > 18 AND l > 42)::int) AS m FROM lab l JOIN am USING (page_id, y, x)), {morph_sql('raw2', 'm', open_steps(3), 'wm')},
t AS (SELECT page_id, y, x, am.m AS plain, wm.m AS board FROM am JOIN wm USING (page_id, y, x)) """ + text_sql("t", "plain", "board"))
def accent_mask(spark, sf):
    px = masks.accent_mask(to_lab(rasters(spark, sf)), "l", "plain")
    return as_text(masks.accent_mask(px, "l", "board", whiteboard=True), "plain", "board")


def sauvola_sql(src: str, col: str, k: float, size: int, out: str = "sv") -> str:
    n = f"{size * size}.0::double"
    return f"""{box_sql(src, col, size, f'{out}_x')}, {out}_m AS (SELECT page_id, y, x, {col} AS v, box_sum/{n} AS mean,
  sqrt(greatest(0.0::double, box_sum2/{n} - (box_sum/{n})*(box_sum/{n}))) AS sd FROM {out}_x),
{out} AS MATERIALIZED (SELECT page_id, y, x, (v <= mean*(1.0::double + {k}::double*(sd/128.0::double - 1.0)) AND mean - v >= greatest(10.0::double, sd*0.22::double))::int AS soft,
  (v <= mean*(1.0::double + {k}::double*(sd/128.0::double - 1.0)) AND mean - v >= greatest(22.0::double, sd*0.40::double))::int AS strong FROM {out}_m)"""


@query("sauvola_masks", P + f", {GRAY_PX}, {sauvola_sql('gray', 'v', 0.18, 31)} " + text_sql("sv", "soft", "strong"))
def sauvola_masks(spark, sf):
    return as_text(masks.sauvola(with_luma(spark, sf), "v"), "soft", "strong")


MARKED = f"""{LAB_SQL}, {hsv_sql('px', 'hsv')}, mk AS (SELECT page_id, y, x, l, sat, hue, val, (l > 120)::int AS paper, (bb < 120)::int AS accent
  FROM lab JOIN hsv USING (page_id, y, x)),
rich AS (SELECT page_id, CASE WHEN count(*) FILTER (l > 48) = 0 THEN 0.0::double ELSE least(1.0::double, greatest(0.0::double,
  (count(*) FILTER (l > 48 AND sat > 18)::double / count(*) FILTER (l > 48) - 0.025::double)/0.14::double)) END AS richness FROM mk GROUP BY 1)"""


def marked(spark, sf):
    px = map_planes(to_lab(rasters(spark, sf)), RGB, point.rgb_to_hsv, ["hue", "sat", "val"])
    px = map_planes(px, ["l", "bb"], lambda v, b: {"paper": masks.above(v, 120), "accent": point.flag(b < 120)}, ["paper", "accent"])
    return presets.with_richness(without(px, "a", "bb", "hue", "val"), "sat", "l", "paper")


@query("paper_color_mask", P + f""", {MARKED}, md AS (SELECT page_id, y, x, accent, (paper = 1 AND l > 48 AND sat >= 22.0::double - richness*8.0::double)::int AS md FROM mk JOIN rich USING (page_id)),
un AS (SELECT page_id, y, x, greatest(md, accent) AS m FROM md), {morph_sql('un', 'm', open_steps(3), 'op')},
so AS (SELECT page_id, max(md) AS anyc FROM md GROUP BY 1), t AS (SELECT page_id, y, x, CASE WHEN anyc > 0 THEN m ELSE accent END AS m
  FROM op JOIN md USING (page_id, y, x) JOIN so USING (page_id)) """ + text_sql("t", "m"))
def paper_color_mask(spark, sf):
    return as_text(masks.paper_color_mask(marked(spark, sf), "sat", "l", "paper", "accent", "m"), "m")


@query("restored_saturation", P + f""", {MARKED}, k AS (SELECT *, least(255, sat + 40) AS ref, (sat > 60)::int AS color FROM mk JOIN rich USING (page_id)),
f AS (SELECT *, greatest(ref*(0.40::double + least(1.0::double, greatest(0.0::double, (ref-10.0::double)/34.0::double))*0.24::double + richness*0.24::double),
  CASE WHEN accent > 0 THEN ref*(0.74::double + richness*0.18::double) ELSE 0 END, CASE WHEN color > 0 THEN ref*(0.50::double + richness*0.18::double) ELSE 0 END) AS fl FROM k),
up AS (SELECT page_id, y, x, hue, val, {clamp_sql('CASE WHEN (paper = 0 OR color > 0) AND l > 48 AND ref > 10 THEN greatest(sat::double, fl) ELSE sat::double END')} AS sat FROM f),
{hsv_back_sql('up', 'bk')} """ + text_sql("bk", *RGB))
def restored_saturation(spark, sf):
    px = map_planes(marked(spark, sf), ["sat"], lambda s: {"ref_sat": point.least(s + 40, 255), "paper_color": masks.above(s, 60)}, ["ref_sat", "paper_color"])
    return as_text(presets.restore_saturation(px), *RGB)


# --- tones ------------------------------------------------------------------------------------------------

SAMPLE_BRIGHT, SAMPLE_CAP = 100, 300


@query("quantization_sample", P + f""", {GRAY_PX}, t AS (SELECT page_id, v, v >= 224 AS br, count(*) FILTER (v < 224) OVER (PARTITION BY page_id) AS dk FROM gray),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id, br ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY page_id, br) AS n FROM t),
w AS (SELECT *, CASE WHEN br AND dk > 0 THEN least(n, greatest(dk*2, {SAMPLE_BRIGHT})) ELSE n END AS want FROM s),
p AS (SELECT page_id, br, n, want, unnest(range(want)) AS i FROM (SELECT DISTINCT page_id, br, n, want FROM w)),
t1 AS (SELECT w.page_id, w.v FROM p JOIN w ON w.page_id = p.page_id AND w.br = p.br
  AND w.k = CASE WHEN p.want >= p.n THEN p.i WHEN p.want = 1 THEN 0 ELSE (p.i * (p.n - 1)) // (p.want - 1) END),
s2 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM t1),
p2 AS (SELECT page_id, n, least(n, {SAMPLE_CAP}) AS want, unnest(range(least(n, {SAMPLE_CAP}))) AS i FROM (SELECT DISTINCT page_id, n FROM s2))
SELECT s2.page_id, s2.v, count(*) AS n FROM p2 JOIN s2 ON s2.page_id = p2.page_id AND s2.k = CASE WHEN p2.want >= p2.n THEN p2.i ELSE (p2.i * (p2.n - 1)) // (p2.want - 1) END
GROUP BY 1, 2""")
def quantization_sample(spark, sf):
    hist = stats.histogram(with_luma(spark, sf), "v")
    return tone.quantization_sample(hist, SAMPLE_BRIGHT, SAMPLE_CAP).select("page_id", "v", "n")


@query("whole_quantization_sample", P + f""", {GRAY_PX} SELECT page_id, v, count(*) AS n FROM gray GROUP BY 1, 2""")
def whole_quantization_sample(spark, sf):
    return tone.quantization_sample(stats.histogram(with_luma(spark, sf), "v")).select("page_id", "v", "n")


@query("quantized_pixels", P + f""", {LAB_SQL}, t AS (SELECT page_id, y, x, (l > 120)::int AS paper, CASE WHEN l < 75 THEN 30 WHEN l < 145 THEN 120 WHEN l < 205 THEN 171 ELSE 240 END AS q,
  CASE WHEN l < 75 THEN 30 WHEN l < 146 THEN 120 WHEN l < 206 THEN 171 ELSE 240 END AS q2 FROM lab),
u AS (SELECT page_id, y, x, q, CASE WHEN paper = 1 THEN greatest(q, 171) ELSE q END AS floored FROM t) """ + text_sql("u", "q", "floored"))
def quantized_pixels(spark, sf):
    px = to_lab(rasters(spark, sf)).withColumn("levels", F.lit([30, 120, 171, 240]))
    px = px.withColumn("cuts", tone.cuts(F.col("levels"), "truncate"))
    px = map_planes(px, ["l"], lambda v, levels, at: {"q": tone.quantize(v, levels, at), "paper": masks.above(v, 120)}, ["q", "paper"], ["levels", "cuts"])
    return as_text(map_planes(px, ["q", "paper"], tone.paper_floor, ["floored"], ["levels"]), "q", "floored")


# --- moving pixels ------------------------------------------------------------------------------------------


@query("rotated_pages", P + """, t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 31 - y ELSE 23 - x END AS y,
  CASE page_id % 4 WHEN 0 THEN x WHEN 1 THEN 31 - y WHEN 2 THEN 23 - x ELSE y END AS x, r, g FROM px) """ + text_sql("t", "r", "g"))
def rotated_pages(spark, sf):
    px = rasters(spark, sf).withColumn("rotation_degrees", (F.col("page_id") % 4 * 90).cast("int"))
    return as_text(warp.rotate(px, ["r", "g"]), "r", "g")


@query("cropped_pages", P + """, t AS (SELECT page_id, cast(y - page_id % 7 AS int) AS y, x - page_id % 5 AS x, r, g FROM px
  WHERE y >= page_id % 7 AND y < 32 - page_id % 4 AND x >= page_id % 5 AND x < 24 - page_id % 3) """ + text_sql("t", "r", "g"))
def cropped_pages(spark, sf):
    k = F.col("p_partkey")
    boxes = fx.table(spark, sf, "part").select(
        k.alias("page_id"), (k % 5).cast("int").alias("left"), (k % 7).cast("int").alias("top"),
        (24 - k % 3).cast("int").alias("right"), (32 - k % 4).cast("int").alias("bottom"),
    )
    return as_text(warp.crop(rasters(spark, sf), boxes, ["r", "g"]), "r", "g")


@query("square_pages", P + ", t AS (SELECT page_id, y - 4 AS y, x, r, g FROM px WHERE y >= 4 AND y < 28) " + text_sql("t", "r", "g"))
def square_pages(spark, sf):
    return as_text(warp.center_square(rasters(spark, sf), ["r", "g"]), "r", "g")


@query("downscaled_pages", P + f""", {GRAY_PX} SELECT page_id, y // 5 AS y, x // 5 AS x, round(avg(v), 6) AS v FROM gray GROUP BY 1, 2, 3""")
def downscaled_pages(spark, sf):
    found = nb.downscale(with_luma(spark, sf), "v", 5, "v")
    return found.select("page_id", "y", "x", F.round("v", 6).alias("v"))


@query("resized_pages", P + """, t AS (SELECT page_id, ty AS y, tx AS x, r, g FROM px, range(20) a(ty), range(30) b(tx)
  WHERE px.y = ty * 32 // 20 AND px.x = tx * 24 // 30) """ + text_sql("t", "r", "g"))
def resized_pages(spark, sf):
    return as_text(warp.resize_nearest(rasters(spark, sf), ["r", "g"], F.lit(20), F.lit(30)), "r", "g")


def _warp_sql(docs: bool) -> str:
    size = "cast(floor({v} + 0.5) AS int)" if docs else "cast(floor({v}) AS int)"
    d = lambda a, b: f"sqrt(pow((x{a}-x{b})::double, 2) + pow((y{a}-y{b})::double, 2))"
    tw, th = f"greatest({d(0, 1)}, {d(3, 2)})", f"greatest({d(0, 3)}, {d(1, 2)})"
    return f"""{SQL_PAGE_QUADS}, ws AS (SELECT *, {tw} AS tw, {th} AS th FROM pq),
wz AS (SELECT *, {size.format(v='tw')} AS ow, {size.format(v='th')} AS oh, x1-x2 AS dx1, x3-x2 AS dx2, x0-x1+x2-x3 AS sx, y1-y2 AS dy1, y3-y2 AS dy2, y0-y1+y2-y3 AS sy FROM ws),
wk AS (SELECT *, {'(ow - 1)::double' if docs else 'tw'} AS pw, {'(oh - 1)::double' if docs else 'th'} AS ph,
  (sx*dy2 - dx2*sy)::double / (dx1*dy2 - dx2*dy1) AS kg, (dx1*sy - sx*dy1)::double / (dx1*dy2 - dx2*dy1) AS kh FROM wz),
wp AS (SELECT page_id, ty, tx, kg, kh, tx/pw AS u, ty/ph AS v, x1-x0+kg*x1 AS ka, x3-x0+kh*x3 AS kb, x0 AS kc, y1-y0+kg*y1 AS kd, y3-y0+kh*y3 AS ke, y0 AS kf
  FROM (SELECT *, unnest(range(ow)) AS tx FROM (SELECT *, unnest(range(oh)) AS ty FROM wk))),
wt AS (SELECT page_id, ty, tx, (ka*u + kb*v + kc)/(kg*u + kh*v + 1) AS sx, (kd*u + ke*v + kf)/(kg*u + kh*v + 1) AS sy FROM wp)"""


@query("warped_nearest", P + f""", {_warp_sql(True)}, t AS (SELECT w.page_id, ty AS y, tx AS x, coalesce(r, 0) AS r, coalesce(g, 0) AS g FROM wt w LEFT JOIN px p
  ON p.page_id = w.page_id AND p.y = cast(floor(sy + 0.5) AS int) AND p.x = cast(floor(sx + 0.5) AS int)) """ + text_sql("t", "r", "g"))
def warped_nearest(spark, sf):
    return as_text(warp.warp(rasters(spark, sf), fx.page_quads(spark, sf), ["r", "g"], "nearest"), "r", "g")


def _corner(dx: int, dy: int) -> str:
    return f"LEFT JOIN px p{dx}{dy} ON p{dx}{dy}.page_id = w.page_id AND p{dx}{dy}.y = cast(floor(sy) AS int) + {dy} AND p{dx}{dy}.x = cast(floor(sx) AS int) + {dx}"


@query("warped_bilinear", P + f""", {_warp_sql(False)}, t AS (SELECT w.page_id, ty AS y, tx AS x, cast(floor(
  (coalesce(p00.r, 0)*(1-(sx-floor(sx))) + coalesce(p10.r, 0)*(sx-floor(sx)))*(1-(sy-floor(sy)))
  + (coalesce(p01.r, 0)*(1-(sx-floor(sx))) + coalesce(p11.r, 0)*(sx-floor(sx)))*(sy-floor(sy)) + 0.5) AS int) AS r
  FROM wt w {' '.join(_corner(a, b) for b in (0, 1) for a in (0, 1))}) """ + text_sql("t", "r"))
def warped_bilinear(spark, sf):
    return as_text(warp.warp(rasters(spark, sf), fx.page_quads(spark, sf), ["r"], "bilinear", "app"), "r")


# --- whole-page jobs ------------------------------------------------------------------------------------------


@query("straightened_pages")
def straightened_pages(spark, sf):
    """Straighten, trim the dark border, then bring the page to its paper ratio."""
    from scanloom.raster.jobs import straighten_and_normalise

    return as_text(straighten_and_normalise(rasters(spark, sf), fx.page_quads(spark, sf)), *RGB)
