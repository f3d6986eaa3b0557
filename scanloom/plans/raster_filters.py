"""The page filters and the operators that only they need, each with its whole chain of steps in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.plans import fixtures as fx
from scanloom.plans.raster import (
    CHROMA_SQL, GRAY_PX, HIST_SQL, LAB_SQL, P, as_text, blend_sql, clamp_sql, contrast_sql, hsv_back_sql, hsv_sql, lab_back_sql,
    rasters, sf32, steps_sql, text_sql, with_luma,
)
from scanloom.plans.raster_area import adaptive_sql, blur_sql, close_steps, morph_sql, open_steps, sauvola_sql
from scanloom.raster import neighbourhood as nb, presets, stats, tone
from scanloom.raster.presets import RGB, to_lab
from scanloom.registry import query

CELL = nb.SMALLEST_CELL
CELL_ROWS, CELL_COLS = -(-fx.PIXEL_ROWS // CELL), -(-fx.PIXEL_COLS // CELL)


def surface_sql(src: str, out: str) -> str:
    """Illumination of pages of the fixture's size: cells of 3 pixels, the small pages' element of 5 cells."""
    away = lambda at: f"(({at} + 0.5::double) / {CELL} - 0.5::double)"
    right = f"least(cast(floor({away('x')}) AS int) + 1, {CELL_COLS - 1})"
    left = f"greatest(0, cast(floor({away('x')}) AS int))"
    return f"""{out}_c AS MATERIALIZED (SELECT page_id, y // {CELL} AS y, x // {CELL} AS x, cast(floor(sum(l)::double / count(*) + 0.5::double) AS int) AS v
  FROM {src} GROUP BY 1, 2, 3),
{morph_sql(f'{out}_c', 'v', close_steps(5), f'{out}_m')},
{blur_sql(f'{out}_m', 'v', nb.SURFACE_KERNEL, f'{out}_g', 'replicate', 's', CELL_COLS, CELL_ROWS)},
{out}_n AS (SELECT *, coalesce(lag(s) OVER w, s) AS up, coalesce(lead(s) OVER w, s) AS down FROM {out}_g WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
{out}_r AS (SELECT page_id, y * {CELL} + r AS y, x, CASE WHEN {away('r')} < 0 THEN s * (1 + {away('r')}) - up * {away('r')}
  ELSE s * (1 - {away('r')}) + down * {away('r')} END AS m FROM {out}_n, range({CELL}) q(r) WHERE y * {CELL} + r < {fx.PIXEL_ROWS}),
{out}_l AS (SELECT page_id, y, list(m ORDER BY x) AS ms FROM {out}_r GROUP BY 1, 2),
{out} AS MATERIALIZED (SELECT page_id, y, x, cast(floor(ms[{left} + 1] + (ms[{right} + 1] - ms[{left} + 1]) * ({away('x')} - floor({away('x')})) + 0.5::double) AS int) AS s
  FROM {out}_l, range({fx.PIXEL_COLS}) q(x))"""


def flat_sql(src: str, out: str) -> str:
    """Lightness with the illumination divided out."""
    return f"""{surface_sql(src, f'{out}_s')},
{out}_a AS (SELECT c.*, s.s, avg(s.s) OVER (PARTITION BY c.page_id) AS mean FROM {src} c JOIN {out}_s s USING (page_id, y, x)),
{out} AS MATERIALIZED (SELECT page_id, y, x, {clamp_sql('(l::FLOAT + 1::FLOAT) / (s::FLOAT + 1::FLOAT) * mean::FLOAT')} AS l, a, bb FROM {out}_a)"""


def median_sql(src: str, col: str, out: str, pick: str, keep: str = "") -> str:
    """A statistic of the list of the 3 x 3 neighbourhood, edges repeated."""
    beside = [f"coalesce({way}({c}) OVER l, {c})" for c in ("up", col, "down") for way in ("lag", "lead")]
    nine = f"[up, {col}, down, {', '.join(beside)}]"
    return f"""{out}_u AS (SELECT *, coalesce(lag({col}) OVER c, {col}) AS up, coalesce(lead({col}) OVER c, {col}) AS down FROM {src}
  WINDOW c AS (PARTITION BY page_id, x ORDER BY y)),
{out} AS MATERIALIZED (SELECT page_id, y, x, {pick.format(v=nine)} AS {col}{keep} FROM {out}_u WINDOW l AS (PARTITION BY page_id, y ORDER BY x))"""


def clean_sql(src: str, out: str) -> str:
    """Even, stretched and denoised lightness."""
    return f"""{flat_sql(src, f'{out}_f')},
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY l) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM {out}_f),
{out}_e AS (SELECT page_id, min(l) FILTER (k = trunc(n * 0.005::double)) AS bk, min(l) FILTER (k = trunc(n * 0.995::double)) AS wh FROM {out}_k GROUP BY 1),
{out}_t AS (SELECT page_id, y, x, {clamp_sql('(least(l, wh)::FLOAT - bk::FLOAT) * (255.0::double / (wh - bk))::FLOAT')} AS l, a, bb
  FROM {out}_f JOIN (SELECT page_id, bk, greatest(bk + 1, wh) AS wh FROM {out}_e) USING (page_id)),
{median_sql(f'{out}_t', 'l', out, 'list_sort({v})[5]', ', a, bb')}"""


def limit_sql(src: str, lowest: int, p: float, out: str) -> str:
    return f"{out} AS (SELECT page_id, greatest({lowest}, floor(quantile_cont(l, {p}))) AS lim FROM {src} GROUP BY 1)"


def paper_sql(src: str, out: str) -> str:
    return f"""{limit_sql(src, 96, 0.18, f'{out}_q')}, {out}_r AS (SELECT page_id, y, x, (l > lim AND {CHROMA_SQL} <= 34)::int AS m FROM {src} JOIN {out}_q USING (page_id)),
{morph_sql(f'{out}_r', 'm', close_steps(5, 2) + open_steps(5), out)}"""


def structure_sql(src: str, out: str) -> str:
    return f"""{adaptive_sql(src, 'l', f'{out}_a')}, {limit_sql(src, 72, 0.10, f'{out}_q')},
{out}_r AS (SELECT page_id, y, x, (m = 1 OR l <= lim)::int AS m FROM {out}_a JOIN {out}_q USING (page_id)),
{morph_sql(f'{out}_r', 'm', open_steps(3) + [('max', 3)] * 2, out)}"""


def accent_sql(src: str, out: str) -> str:
    return f"""{out}_r AS (SELECT page_id, y, x, ({CHROMA_SQL} > 28 AND l > 48)::int AS m FROM {src}), {morph_sql(f'{out}_r', 'm', open_steps(3), out)}"""


def neutral_sql(src: str, out: str) -> str:
    """``na``, ``nb`` from ``a``, ``bb`` and the mask ``paper``."""
    moved = lambda c: clamp_sql(f"{c}::FLOAT - (mean_{c} - 128.0::double)::FLOAT")
    return f"""{out}_b AS (SELECT page_id, coalesce(avg(a) FILTER (paper = 1), 128.0::double) AS mean_a, coalesce(avg(bb) FILTER (paper = 1), 128.0::double) AS mean_bb
  FROM {src} GROUP BY 1),
{out} AS MATERIALIZED (SELECT * EXCLUDE (a, bb, mean_a, mean_bb), {moved('a')} AS na, {moved('bb')} AS nb FROM {src} JOIN {out}_b USING (page_id))"""


def even_blend_sql(a: str, b: str, share: float) -> str:
    return f"greatest(0, least(255, cast(round_even({a}*{share}::double + {b}*{round(1 - share, 10)}::double, 0) AS int)))"


def squeeze_sql(v: str, k: str) -> str:
    return clamp_sql(f"({v}::FLOAT - {sf32(128)}) * {k} + {sf32(128)}")


def capped_sql(base: str, ref: str, mask: str, k: float) -> str:
    return f"CASE WHEN {mask} > 0 THEN least({base}, {clamp_sql(f'{ref}::FLOAT * {sf32(k)}')}) ELSE {base} END"


def magic_sql(src: str, o: str) -> str:
    """CTEs of the filter for the Lab pixels ``src``; the last, named ``o``, has r, g, b."""
    keep = ", l, paper, accent, na, nb"
    return f"""{clean_sql(src, f'{o}c')}, {paper_sql(f'{o}c', f'{o}p')}, {structure_sql(f'{o}c', f'{o}s')}, {accent_sql(f'{o}c', f'{o}a')},
{o}w AS (SELECT p.page_id, p.y, p.x, least(p.m, 1 - s.m) AS m FROM {o}p p JOIN {o}s s USING (page_id, y, x)), {morph_sql(f'{o}w', 'm', close_steps(5, 2), f'{o}v')},
{o}j AS MATERIALIZED (SELECT c.*, v.m AS paper, a.m AS accent FROM {o}c c JOIN {o}v v USING (page_id, y, x) JOIN {o}a a USING (page_id, y, x)), {neutral_sql(f'{o}j', f'{o}n')},
{lab_back_sql(f'{o}n', f'{o}b', 'l', 'na', 'nb', keep)}, {hsv_sql(f'{o}b', f'{o}h', keep)},
{o}r AS (SELECT page_id, max(CASE WHEN l > 48 AND paper = 1 THEN sat ELSE -1 END) AS top, CASE WHEN count(*) FILTER (l > 48) = 0 THEN 0.0::double ELSE least(1.0::double,
  greatest(0.0::double, (count(*) FILTER (l > 48 AND sat > 18)::double / count(*) FILTER (l > 48) - 0.025::double)/0.14::double)) END AS rich FROM {o}h GROUP BY 1),
{o}i AS MATERIALIZED (SELECT h.*, top, rich, 22.0::double - rich*8.0::double AS lim FROM {o}h h JOIN {o}r USING (page_id)),
{o}u AS (SELECT page_id, y, x, greatest((paper = 1 AND l > 48 AND sat >= lim)::int, accent) AS m FROM {o}i), {morph_sql(f'{o}u', 'm', open_steps(3), f'{o}o')},
{o}d AS (SELECT i.* EXCLUDE (hue, val), i.sat AS ref, CASE WHEN top >= lim THEN m ELSE accent END AS color FROM {o}i i JOIN {o}o USING (page_id, y, x)),
{o}e AS (SELECT *, {even_blend_sql('(' + blend_sql('l', 'paper', 244.0, 0.34) + ')', 'l', 0.58)} AS light, (0.24::double + rich*0.18::double)::FLOAT AS kp,
  (CASE WHEN accent > 0 THEN least(1.0::double, 0.86::double + rich*0.10::double) WHEN color > 0 THEN 0.42::double + rich*0.30::double ELSE 0.18::double + rich*0.18::double END)::FLOAT AS f FROM {o}d),
{o}f AS MATERIALIZED (SELECT *, CASE WHEN color > 0 THEN {clamp_sql(f'light::FLOAT * ({sf32(1)} - kp) + l::FLOAT * kp')} ELSE light END AS ol,
  CASE WHEN paper > 0 AND color = 0 AND accent = 0 THEN 128 ELSE {squeeze_sql('na', 'f')} END AS oa,
  CASE WHEN paper > 0 AND color = 0 AND accent = 0 THEN 128 ELSE {squeeze_sql('nb', 'f')} END AS ob FROM {o}e),
{lab_back_sql(f'{o}f', f'{o}g', 'ol', 'oa', 'ob', ', l, paper, accent, color, ref, rich')}, {hsv_sql(f'{o}g', f'{o}k', ', l, paper, accent, color, ref, rich')},
{o}l AS (SELECT *, greatest(ref*(0.40::double + least(1.0::double, greatest(0.0::double, (ref-10.0::double)/34.0::double))*0.24::double + rich*0.24::double),
  CASE WHEN accent > 0 THEN ref*(0.74::double + rich*0.18::double) ELSE 0 END, CASE WHEN color > 0 THEN ref*(0.50::double + rich*0.18::double) ELSE 0 END) AS fl FROM {o}k),
{o}m AS (SELECT page_id, y, x, hue, val, {clamp_sql('CASE WHEN (paper = 0 OR color > 0) AND l > 48 AND ref > 10 THEN greatest(sat::double, fl) ELSE sat::double END')} AS sat FROM {o}l),
{hsv_back_sql(f'{o}m', o)}"""


def tones_sql(hist: str, o: str) -> str:
    """CTE ``o``: page_id, tones and levels from ``hist(page_id, v, n)``: the best split in runs, by dynamic programming."""
    gain = lambda a, b: f"(CASE WHEN {b}.i > {a}.i THEN ({b}.cs - {a}.cs) * ({b}.cs - {a}.cs) / ({b}.cw - {a}.cw) ELSE 0.0::double END)"
    mean = lambda a, b: f"(CASE WHEN {b}.cw > {a}.cw THEN ({b}.cs - {a}.cs) / ({b}.cw - {a}.cw) ELSE {b}.v::double END)"
    level = lambda c, k, i: f"greatest({tone.LEVEL_RANGES[k][i][0]}, least({tone.LEVEL_RANGES[k][i][1]}, cast(floor({c} + 0.5::double) AS int)))"
    p = lambda q: f"min(v) FILTER (cum > floor((tot - 1) * {q}::double))"
    up = lambda q: f"min(v) FILTER (cum > ceil((tot - 1) * {q}::double))"
    at = lambda q: f"({p(q)} + ({up(q)} - {p(q)}) * (max(tot - 1) * {q}::double - floor(max(tot - 1) * {q}::double)))"
    return f"""{o}_h AS MATERIALIZED (SELECT page_id, v, n, sum(n) OVER w AS cum, sum(n) OVER (PARTITION BY page_id) AS tot, row_number() OVER w AS i, sum(n * v) OVER w AS cs FROM {hist}
  WINDOW w AS (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
{o}_q AS (SELECT page_id, {at(0.10)} AS q10, {at(0.50)} AS q50, sum(n) FILTER (v >= 96 AND v < 220)::double / sum(n) AS mid FROM {o}_h GROUP BY 1),
{o}_c AS (SELECT page_id, CASE WHEN q10 >= 232 AND q50 - q10 < 12 THEN 2 WHEN q10 >= 185 AND q50 - q10 < 60 AND coalesce(mid, 0) < 0.12 THEN 3 ELSE 4 END AS tones FROM {o}_q),
{o}_v AS (SELECT page_id, v, cum::double * (tot - cum)::double * pow(cs::double / cum - (sum(n * v) OVER (PARTITION BY page_id) - cs)::double / (tot - cum), 2) AS var, tot > cum AS ok FROM {o}_h),
{o}_o AS (SELECT page_id, coalesce(arg_max(v, [var, -v]) FILTER (ok), 127) AS otsu FROM {o}_v GROUP BY 1),
{o}_b AS MATERIALIZED (SELECT page_id, i::int AS i, v, cum::double AS cw, cs::double AS cs FROM {o}_h UNION ALL SELECT DISTINCT page_id, 0, (SELECT min(h.v) FROM {o}_h h WHERE h.page_id = z.page_id), 0.0::double, 0.0::double FROM {o}_h z),
{o}_e AS MATERIALIZED (SELECT * FROM {o}_b WHERE i = 0), {o}_z AS MATERIALIZED (SELECT b.* FROM {o}_b b JOIN (SELECT page_id, max(i) AS i FROM {o}_b GROUP BY 1) USING (page_id, i)),
{o}_f AS MATERIALIZED (SELECT b.page_id, b.i, arg_max({{'g': {gain('e', 'a')} + {gain('a', 'b')}, 'at': a.i}}, [{gain('e', 'a')} + {gain('a', 'b')}, -a.i::double]) AS st FROM {o}_b b JOIN {o}_b a ON a.page_id = b.page_id AND a.i <= b.i
  JOIN {o}_e e ON e.page_id = b.page_id GROUP BY 1, 2),
{o}_s AS MATERIALIZED (SELECT b.page_id, b.i, arg_max({{'g': {gain('b', 'a')} + {gain('a', 'z')}, 'at': a.i}}, [{gain('b', 'a')} + {gain('a', 'z')}, -a.i::double]) AS st FROM {o}_b b JOIN {o}_b a ON a.page_id = b.page_id AND a.i >= b.i
  JOIN {o}_z z ON z.page_id = b.page_id GROUP BY 1, 2),
{o}_3 AS (SELECT f.page_id, arg_max({{'c1': f.st.at, 'c2': f.i}}, [f.st.g + {gain('b', 'z')}, -f.i::double]) AS c FROM {o}_f f JOIN {o}_b b USING (page_id, i) JOIN {o}_z z ON z.page_id = f.page_id GROUP BY 1),
{o}_4 AS (SELECT f.page_id, arg_max({{'c1': f.st.at, 'c2': f.i, 'c3': s.st.at}}, [f.st.g + s.st.g, -f.i::double]) AS c FROM {o}_f f JOIN {o}_s s USING (page_id, i) GROUP BY 1),
{o}_l3 AS (SELECT t.page_id, [{level(mean('e', 'a'), 3, 0)}, {level(mean('a', 'b'), 3, 1)}, {level(mean('b', 'z'), 3, 2)}] AS levels FROM {o}_3 t JOIN {o}_e e USING (page_id) JOIN {o}_z z USING (page_id)
  JOIN {o}_b a ON a.page_id = t.page_id AND a.i = t.c.c1 JOIN {o}_b b ON b.page_id = t.page_id AND b.i = t.c.c2),
{o}_l4 AS (SELECT t.page_id, [{level(mean('e', 'a'), 4, 0)}, {level(mean('a', 'b'), 4, 1)}, {level(mean('b', 'd'), 4, 2)}, {level(mean('d', 'z'), 4, 3)}] AS levels FROM {o}_4 t JOIN {o}_e e USING (page_id) JOIN {o}_z z USING (page_id)
  JOIN {o}_b a ON a.page_id = t.page_id AND a.i = t.c.c1 JOIN {o}_b b ON b.page_id = t.page_id AND b.i = t.c.c2 JOIN {o}_b d ON d.page_id = t.page_id AND d.i = t.c.c3),
{o} AS MATERIALIZED (SELECT page_id, tones, CASE tones WHEN 2 THEN [greatest(16, least(48, cast(floor(otsu * 0.30::double + 0.5::double) AS int))), {tone.TOP_LEVEL}] WHEN 3 THEN l3.levels ELSE l4.levels END AS levels
  FROM {o}_c JOIN {o}_o USING (page_id) JOIN {o}_l3 l3 USING (page_id) JOIN {o}_l4 l4 USING (page_id))"""


def bw_sql(src: str, o: str) -> str:
    """CTEs of the filter; the last, named ``o``, has v."""
    return f"""{clean_sql(src, f'{o}c')}, {paper_sql(f'{o}c', f'{o}p')}, {limit_sql(f'{o}c', 70, 0.12, f'{o}q')},
{o}k AS MATERIALIZED (SELECT page_id, y, x, l, {contrast_sql('l', 1.48)} AS hard FROM {o}c), {sauvola_sql(f'{o}k', 'hard', 0.18, 31, f'{o}s')},
{o}a AS (SELECT s.page_id, s.y, s.x, greatest(strong, (l <= lim)::int) AS m FROM {o}s s JOIN {o}k USING (page_id, y, x) JOIN {o}q USING (page_id)),
{o}b AS (SELECT page_id, y, x, soft AS m FROM {o}s), {morph_sql(f'{o}a', 'm', [('max', 3)], f'{o}x')}, {morph_sql(f'{o}b', 'm', [('max', 3)], f'{o}y')},
{o}d AS MATERIALIZED (SELECT page_id, y, x, greatest(s.m, t.m) AS m FROM {o}x s JOIN {o}y t USING (page_id, y, x)), {median_sql(f'{o}d', 'm', f'{o}t', '(list_sum({v}) >= 5)::int')},
{o}w AS (SELECT p.page_id, p.y, p.x, least(p.m, 1 - t.m) AS m FROM {o}p p JOIN {o}t t USING (page_id, y, x)), {morph_sql(f'{o}w', 'm', close_steps(5, 2), f'{o}v')},
{o}j AS MATERIALIZED (SELECT k.page_id, k.y, k.x, hard, v.m AS paper, t.m AS structure, {blend_sql('hard', 'v.m', 246.0, 0.44)} AS v1 FROM {o}k k JOIN {o}v v USING (page_id, y, x) JOIN {o}t t USING (page_id, y, x)),
{o}e AS (SELECT *, {capped_sql('v1', 'hard', 'structure', 0.92)} AS v2 FROM {o}j), {o}f AS (SELECT *, (v2 > 182 AND structure = 0)::int AS bright FROM {o}e),
{o}g AS MATERIALIZED (SELECT page_id, y, x, paper, {blend_sql('v2', 'bright', 236.0, 0.32)} AS v FROM {o}f), {blur_sql(f'{o}g', 'v', nb.BLUR3, f'{o}l', 'reflect', 'bv')},
{o}r AS MATERIALIZED (SELECT page_id, y, x, paper, cast(floor(bv + 0.5::double) AS int) AS v FROM {o}l JOIN {o}g USING (page_id, y, x)),
{o}i AS (SELECT page_id, v, count(*) AS n FROM {o}r GROUP BY 1, 2), {tones_sql(f'{o}i', f'{o}n')},
{o}m AS (SELECT r.page_id, y, x, paper, levels, levels[1 + len(list_filter(range(1, len(levels)), lambda i: v >= round_even((levels[i] + levels[i + 1])/2.0::double, 0)))] AS q
  FROM {o}r r JOIN {o}n USING (page_id)),
{o} AS MATERIALIZED (SELECT page_id, y, x, CASE WHEN paper = 0 THEN q WHEN len(levels) >= 3 THEN greatest(q, levels[len(levels) - 1]) ELSE levels[len(levels)] END AS v FROM {o}m)"""


def whiteboard_sql(src: str, o: str) -> str:
    """CTEs of the filter; the last, named ``o``, has r, g, b."""
    channel = lambda c: f"CASE WHEN paper > 0 THEN 128 WHEN accent > 0 THEN {squeeze_sql(c, sf32(1.32))} ELSE {squeeze_sql(c, sf32(0.42))} END"
    boost = lambda c, k, plus: f"CASE WHEN accent > 0 THEN {clamp_sql(f'{c}::FLOAT*{sf32(k)} + {sf32(plus)}')} ELSE {c} END AS {c}"
    return f"""{clean_sql(src, f'{o}c')}, {paper_sql(f'{o}c', f'{o}p')}, {structure_sql(f'{o}c', f'{o}s')}, {accent_sql(f'{o}c', f'{o}a')}, {limit_sql(f'{o}c', 156, 0.58, f'{o}q')},
{o}b AS (SELECT c.page_id, c.y, c.x, greatest(m, ({CHROMA_SQL} > 18 AND l > 42)::int) AS m FROM {o}c c JOIN {o}a USING (page_id, y, x)), {morph_sql(f'{o}b', 'm', open_steps(3), f'{o}d')},
{morph_sql(f'{o}d', 'm', [('max', 3)], f'{o}e')}, {o}k AS (SELECT page_id, y, x, {contrast_sql('l', 1.22)} AS hard FROM {o}c), {sauvola_sql(f'{o}k', 'hard', 0.16, 35, f'{o}t')},
{o}f AS MATERIALIZED (SELECT s.page_id, s.y, s.x, greatest(s.m, strong, e.m) AS m FROM {o}s s JOIN {o}t USING (page_id, y, x) JOIN {o}e e USING (page_id, y, x)),
{median_sql(f'{o}f', 'm', f'{o}g', '(list_sum({v}) >= 5)::int')}, {morph_sql(f'{o}g', 'm', [('max', 3)], f'{o}h')},
{o}w AS (SELECT c.page_id, c.y, c.x, least(greatest(p.m, (l > lim)::int), 1 - h.m, 1 - e.m) AS m FROM {o}c c JOIN {o}q USING (page_id) JOIN {o}p p USING (page_id, y, x)
  JOIN {o}h h USING (page_id, y, x) JOIN {o}e e USING (page_id, y, x)), {morph_sql(f'{o}w', 'm', close_steps(5, 2), f'{o}v')},
{o}j AS MATERIALIZED (SELECT c.*, v.m AS paper, d.m AS accent, e.m AS protect, strong FROM {o}c c JOIN {o}v v USING (page_id, y, x) JOIN {o}d d USING (page_id, y, x)
  JOIN {o}e e USING (page_id, y, x) JOIN {o}t USING (page_id, y, x)), {neutral_sql(f'{o}j', f'{o}n')},
{o}r AS (SELECT *, {even_blend_sql('(' + blend_sql('l', 'paper', 250.0, 0.50) + ')', 'l', 0.68)} AS l1 FROM {o}n), {o}u AS (SELECT *, {capped_sql('l1', 'l', 'strong', 0.84)} AS l2 FROM {o}r),
{o}x AS MATERIALIZED (SELECT page_id, y, x, accent, {capped_sql('l2', 'l', 'protect', 0.92)} AS ol, {channel('na')} AS oa, {channel('nb')} AS ob FROM {o}u),
{lab_back_sql(f'{o}x', f'{o}y', 'ol', 'oa', 'ob', ', accent')}, {hsv_sql(f'{o}y', f'{o}z', ', accent')},
{o}i AS (SELECT page_id, y, x, hue, {boost('sat', 1.38, 8)}, {boost('val', 1.05, 2)} FROM {o}z), {hsv_back_sql(f'{o}i', o)}"""


@query("illumination_surface", P + f", {LAB_SQL}, {surface_sql('lab', 'lit')}, t AS (SELECT page_id, y, x, s AS surface FROM lit) " + text_sql("t", "surface"))
def illumination_surface(spark, sf):
    return as_text(nb.illumination(to_lab(rasters(spark, sf)), "l", "surface"), "surface")


@query("tone_levels", HIST_SQL + f", {tones_sql('hist', 'tn')} SELECT page_id, tones, array_to_string(levels, ',') AS levels FROM tn")
def tone_levels(spark, sf):
    hist = stats.histogram(with_luma(spark, sf), "v")
    found = tone.tone_levels(hist, stats.tone_count(hist))
    return found.select("page_id", "tones", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


@query("page_tones", P + f", {GRAY_PX}, hist AS (SELECT page_id, v // 3 AS v, count(*) AS n FROM gray GROUP BY 1, 2), {tones_sql('hist', 'tn')} "
       "SELECT page_id, tones, array_to_string(levels, ',') AS levels FROM tn")
def page_tones(spark, sf):
    hist = stats.histogram(with_luma(spark, sf), "v")
    third = hist.groupBy(*stats.PAGE, F.floor(F.col("v") / 3).cast("int").alias("v")).agg(F.sum("n").alias("n"))
    return tone.fitted_tones(third).select("page_id", "tones", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


@query("magic_step1", P + f", {LAB_SQL}, {flat_sql('lab', 'fl')}, {lab_back_sql('fl', 'out')} " + text_sql("out", *RGB))
def magic_step1(spark, sf):
    return as_text(presets.magic_step1(rasters(spark, sf)), *RGB)


@query("magic_filter", P + f", {LAB_SQL}, {magic_sql('lab', 'mg')} " + text_sql("mg", *RGB))
def magic_filter(spark, sf):
    return as_text(presets.magic(rasters(spark, sf)), *RGB)


@query("bw_filter", P + f", {LAB_SQL}, {bw_sql('lab', 'bw')}, t AS (SELECT page_id, y, x, v AS r FROM bw) " + text_sql("t", "r"))
def bw_filter(spark, sf):
    return as_text(presets.document_bw(rasters(spark, sf)), "r")


@query("whiteboard_filter", P + f", {LAB_SQL}, {whiteboard_sql('lab', 'wb')} " + text_sql("wb", *RGB))
def whiteboard_filter(spark, sf):
    return as_text(presets.whiteboard(rasters(spark, sf)), *RGB)


FILTERED_SQL = P + f""", {LAB_SQL}, lab2 AS MATERIALIZED (SELECT * FROM lab WHERE page_id % 7 = 2), lab3 AS MATERIALIZED (SELECT * FROM lab WHERE page_id % 7 = 3),
lab4 AS MATERIALIZED (SELECT * FROM lab WHERE page_id % 7 = 4), {bw_sql('lab2', 'bw')}, {magic_sql('lab3', 'mg')}, {whiteboard_sql('lab4', 'wb')},
{steps_sql('lights')}, t AS (SELECT page_id, y, x, r, g, b FROM px WHERE page_id % 7 IN (0, 6)
  UNION ALL SELECT page_id, y, x, sr, sg, sb FROM lights WHERE page_id % 7 = 1 UNION ALL SELECT page_id, y, x, vr, vg, vb FROM lights WHERE page_id % 7 = 5
  UNION ALL SELECT page_id, y, x, v, v, v FROM bw UNION ALL SELECT page_id, y, x, r, g, b FROM mg UNION ALL SELECT page_id, y, x, r, g, b FROM wb) """ + text_sql("t", *RGB)


@query("filtered_pages", FILTERED_SQL)
def filtered_pages(spark, sf):
    return as_text(presets.apply_filters(fx.raster_pages(spark, sf), rasters(spark, sf)), *RGB)
