"""Outline geometry and ranking queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import quads as qd
from scanloom.plans import fixtures as fx
from scanloom.plans.exports import A4L, A4P
from scanloom.plans.fixtures import SQL_QUADS
from scanloom.plans.scalars import r6, snap_sql
from scanloom.registry import query

Q = f"WITH {SQL_QUADS}, "
# Corners numbered in list order, then picked by extreme sum/difference with the first winning.
AREA = "abs((x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y4-x4*y3)+(x4*y1-x1*y4))/2.0::double"
CONVEX_TURNS = [
    "((x2-x1)*(y3-y2)-(y2-y1)*(x3-x2))", "((x3-x2)*(y4-y3)-(y3-y2)*(x4-x3))",
    "((x4-x3)*(y1-y4)-(y4-y3)*(x1-x4))", "((x1-x4)*(y2-y1)-(y1-y4)*(x2-x1))",
]
CONVEX = f"(({' > 0 AND '.join(CONVEX_TURNS)} > 0) OR ({' < 0 AND '.join(CONVEX_TURNS)} < 0))"
POINTS = """pts AS (SELECT image_id, cand_id, i, x, y FROM (
  SELECT image_id, cand_id, 1 AS i, x1 AS x, y1 AS y FROM quads UNION ALL SELECT image_id, cand_id, 2, x2, y2 FROM quads
  UNION ALL SELECT image_id, cand_id, 3, x3, y3 FROM quads UNION ALL SELECT image_id, cand_id, 4, x4, y4 FROM quads) u),
ordq AS (SELECT cand_id, min(image_id) AS image_id,
  arg_min([x, y], (x + y) * 10 + i) AS tl, arg_min([x, y], -(x - y) * 10 + i) AS tr,
  arg_min([x, y], -(x + y) * 10 + i) AS br, arg_min([x, y], (x - y) * 10 + i) AS bl FROM pts GROUP BY cand_id),
sides AS (SELECT o.*, sqrt((tl[1]-tr[1])**2 + (tl[2]-tr[2])**2) AS top, sqrt((bl[1]-br[1])**2 + (bl[2]-br[2])**2) AS bottom,
  sqrt((tl[1]-bl[1])**2 + (tl[2]-bl[2])**2) AS lft, sqrt((tr[1]-br[1])**2 + (tr[2]-br[2])**2) AS rgt FROM ordq o)"""


def ang(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = f"({a}[1]-{b}[1])", f"({a}[2]-{b}[2])", f"({c}[1]-{b}[1])", f"({c}[2]-{b}[2])"
    u, v = f"sqrt({ux}**2+{uy}**2)", f"sqrt({vx}**2+{vy}**2)"
    return (f"(CASE WHEN {u} = 0 OR {v} = 0 THEN 0.0 ELSE degrees(acos(least(1.0, greatest(-1.0, "
            f"({ux}*{vx}+{uy}*{vy})/nullif({u}*{v}, 0))))) END)")


ANGLES = [ang("tl", "tr", "br"), ang("tr", "br", "bl"), ang("br", "bl", "tl"), ang("bl", "tl", "tr")]
ANGLE_SCORE = "(" + "+".join(f"(1-least(1.0, abs({a}-90)/30))" for a in ANGLES) + ")/4"
SCORE = f"""({ANGLE_SCORE}) * 0.45 + ((least(top,bottom)/greatest(top,bottom)) + (least(lft,rgt)/greatest(lft,rgt)))/2 * 0.35
  + ({AREA}) / (img_w*img_h) * 0.20"""


def _quads(spark, sf):
    return qd.with_area(fx.candidate_quads(spark, sf))


def _scored(spark, sf):
    return qd.scored(_quads(spark, sf))


@query("quad_measures", Q + POINTS + f"""
SELECT q.cand_id, {', '.join(f'o.{n}[1] AS {n}_x, o.{n}[2] AS {n}_y' for n in ('tl', 'tr', 'br', 'bl'))},
  round(top, 6) AS top, round(bottom, 6) AS bottom, round(lft, 6) AS lft, round(rgt, 6) AS rgt,
  round({AREA}, 6) AS area, {CONVEX} AS convex, round({ANGLES[0]}, 5) AS angle
FROM quads q JOIN sides o USING (cand_id)""")
def quad_measures(spark, sf):
    q = _quads(spark, sf).withColumn("o", g.order_corners(F.col("corners")))
    s, p = g.side_lengths(F.col("o")), g.points(F.col("o"))
    corner = [p[i][c].alias(f"{n}_{c}") for i, n in enumerate(("tl", "tr", "br", "bl")) for c in ("x", "y")]
    return q.select(
        "cand_id", *corner, r6(s["top"], "top"), r6(s["bottom"], "bottom"), r6(s["left"], "lft"), r6(s["right"], "rgt"),
        r6(F.col("area"), "area"), g.is_convex(F.col("corners")).alias("convex"),
        F.round(g.angle_deg(p[0], p[1], p[2]), 5).alias("angle"),
    )


@query("quad_scores", Q + POINTS + f"""
SELECT q.image_id, q.cand_id, round({SCORE}, 6) AS score FROM quads q JOIN sides o USING (cand_id) WHERE {CONVEX}""")
def quad_scores(spark, sf):
    return _scored(spark, sf).select("image_id", "cand_id", r6(F.col("score"), "score"))


@query("best_candidate", Q + POINTS + f""", sc AS (
  SELECT q.image_id, q.cand_id, q.source, {SCORE} AS score FROM quads q JOIN sides o USING (cand_id) WHERE {CONVEX})
SELECT image_id, cand_id, source, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, cand_id) AS k FROM sc WHERE score > 0) t WHERE k = 1""")
def best_candidate(spark, sf):
    return qd.best_candidate(_scored(spark, sf)).select("image_id", "cand_id", "source", r6(F.col("score"), "score"))


RANKED = f"SELECT image_id, cand_id, img_w, img_h, {AREA} AS area FROM quads"


@query("top_candidates", Q + f"""r AS ({RANKED}), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, cand_id)
  AS area_rank FROM r WHERE area >= img_w*img_h*0.05)
SELECT image_id, cand_id, area, area_rank FROM k WHERE area_rank <= CASE WHEN greatest(img_w, img_h) <= 500 THEN 20 ELSE 10 END""")
def top_candidates(spark, sf):
    # The app looks at 20 candidates of a small image and at 10 of a large one.
    limit = F.when(F.greatest("img_w", "img_h") <= 500, 20).otherwise(10)
    quads = _quads(spark, sf).withColumn("limit", limit)
    return qd.top_candidates_by_area(quads, 20, limit_col="limit").select("image_id", "cand_id", "area", "area_rank")


@query("top_candidates_docs", Q + f"""r AS ({RANKED}), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, cand_id)
  AS area_rank FROM r)
SELECT image_id, cand_id, area, area_rank FROM k WHERE area_rank <= 40 AND area >= img_w*img_h*0.15""")
def top_candidates_docs(spark, sf):
    return qd.top_candidates_docs(_quads(spark, sf), 40).select("image_id", "cand_id", "area", "area_rank")


GM = "sqrt(greatest(0.0001, {a}) * greatest(0.0001, {b}))"


@query("quad_paper_ratio", Q + POINTS + f""", m AS (SELECT *, greatest(top,bottom) AS xw, greatest(1.0, least(top,bottom)) AS nw,
  greatest(lft,rgt) AS xh, greatest(1.0, least(lft,rgt)) AS nh, {GM.format(a='top', b='bottom')} AS gw, {GM.format(a='lft', b='rgt')} AS gh FROM sides),
e AS (SELECT *, CASE WHEN xw/xh < 1.05 AND xw/nw > 1.20 AND xw/nw >= xh/nh THEN nw/xh ELSE xw/xh END AS est FROM m WHERE xh > 0)
SELECT cand_id, round({snap_sql('est')}, 6) AS by_sides,
  round(CASE WHEN abs((least(gw,gh)/greatest(0.0001,greatest(gw,gh)))/{A4P}-1) <= 0.2 THEN CASE WHEN gw > gh THEN {A4L} ELSE {A4P} END END, 6) AS by_means FROM e""")
def quad_paper_ratio(spark, sf):
    o = fx.candidate_quads(spark, sf).withColumn("o", g.order_corners(F.col("corners")))
    o, s = o.withColumn("s", g.side_lengths(F.col("o"))), F.col("s")
    means = g.sides_paper_ratio(s["top"], s["bottom"], s["left"], s["right"])
    return o.filter(F.greatest(s["left"], s["right"]) > 0).select(
        "cand_id", r6(g.ratio_of_sides(s), "by_sides"), r6(means, "by_means")
    )


XS, YS = ["x1", "x2", "x3", "x4"], ["y1", "y2", "y3", "y4"]

def _touch_sql(margin: str) -> tuple[str, str]:
    tests = [[f"{x} < img_w*{margin}" for x in XS], [f"{x} > img_w-img_w*{margin}" for x in XS],
             [f"{y} < img_h*{margin}" for y in YS], [f"{y} > img_h-img_h*{margin}" for y in YS]]
    sides = " + ".join(f"cast({' OR '.join(t)} AS int)" for t in tests)
    count = " + ".join(f"cast({c} AS int)" for t in tests for c in t)
    return sides, count


SIDES_SQL, COUNT_SQL = _touch_sql("0.02")


@query("candidate_scores", Q + f"""t AS (SELECT *, {SIDES_SQL} AS sides, {COUNT_SQL} AS touches,
  cand_id % 200 AS center, cand_id % 240 AS border, (cand_id % 100) / 100.0::double AS support,
  greatest(x1,x2,x3,x4) - least(x1,x2,x3,x4) AS ww, greatest(y1,y2,y3,y4) - least(y1,y2,y3,y4) AS wh FROM quads),
a AS (SELECT *, (ww*wh)::double/(img_w*img_h) AS ar, greatest(ww,wh)::double/greatest(1, least(ww,wh)) AS asp FROM t),
s AS (SELECT *, CASE WHEN ar < 0.08 THEN -1.0::double ELSE ar*4.0 + center/255.0::double*1.8 - (0.35 - border/255.0::double)*1.2
  - CASE WHEN asp < 2.4 THEN 0 ELSE least(1.0, (asp-2.4)/2) END - least(1.8, touches*0.35) END AS score FROM a)
SELECT cand_id, sides, touches, round(score, 6) AS score, round(CASE WHEN score < 0 THEN score
  WHEN source = 'merged' AND kind = 'quad' THEN score + support*2.2 + 0.15
  WHEN source = 'paper' AND sides >= 3 THEN score + support*2.2 - 1.6 ELSE score + support*2.2 END, 6) AS adjusted FROM s""")
def candidate_scores(spark, sf):
    c, w, h, e = F.col("corners"), F.col("img_w"), F.col("img_h"), F.col("cand_id")

    def extent(axis: str):
        values = F.transform(c, lambda p: p[axis])
        return F.array_max(values) - F.array_min(values)

    q = fx.candidate_quads(spark, sf).withColumns(
        {"sides": g.touched_sides(c, w, h), "touches": g.edge_touches(c, w, h), "ww": extent("x"), "wh": extent("y")}
    )
    score = g.candidate_score(F.col("ww"), F.col("wh"), w, h, e % 200, e % 240, F.col("touches"))
    q = q.withColumn("score", score)
    adjusted = g.adjusted_score(F.col("score"), (e % 100) / 100.0, F.col("source"), F.col("kind"), F.col("sides"))
    return q.select("cand_id", "sides", "touches", r6(F.col("score"), "score"), r6(adjusted, "adjusted"))


@query("trim_decisions", Q + """b AS (SELECT cand_id, 1000 AS w, 1400 AS h, cand_id % 150 AS x, cand_id % 170 AS y,
  1000 - cand_id % 150 - cand_id % 130 AS bw, 1400 - cand_id % 170 - cand_id % 110 AS bh,
  (cand_id % 90)::double AS p10, (cand_id % 90 + cand_id % 160)::double AS p90, (cand_id % 255)::double AS border FROM quads),
c AS (SELECT *, (p90-p10)/255.0::double > 0.45 AND border < 180 AS careful, (p90-p10)/255.0::double < 0.20 AS flat FROM b),
d AS (SELECT *, cast(round_even(bw * CASE WHEN flat THEN 0.04::double ELSE 0.02::double END, 0) AS int) AS px,
  cast(round_even(bh * CASE WHEN flat THEN 0.04::double ELSE 0.02::double END, 0) AS int) AS py FROM c),
e AS (SELECT *, greatest(0, x-px) AS l, greatest(0, y-py) AS t, least(w, x+bw+px) AS r, least(h, y+bh+py) AS bo FROM d),
f AS (SELECT *, (r-l)::double/w AS kw, (bo-t)::double/h AS kh, greatest(l::double/w, (w-r)::double/w, t::double/h, (h-bo)::double/h) AS most FROM e),
g AS (SELECT *, kw < 0.5 OR kh < 0.5 OR (flat AND border > 175 AND most > 0.10)
  OR kw < CASE WHEN careful THEN 0.90::double ELSE 0.82::double END OR kh < CASE WHEN careful THEN 0.90::double ELSE 0.82::double END
  OR most > CASE WHEN careful THEN 0.08::double ELSE 0.15::double END AS refuse FROM f)
SELECT cand_id, NOT refuse AS trimmed, cast(CASE WHEN refuse THEN 0 ELSE l END AS int) AS box_left, cast(CASE WHEN refuse THEN 0 ELSE t END AS int) AS box_top,
  cast(CASE WHEN refuse THEN w ELSE r END AS int) AS box_right, cast(CASE WHEN refuse THEN h ELSE bo END AS int) AS box_bottom FROM g""")
def trim_decisions(spark, sf):
    e = F.col("cand_id")
    box = g.trim_decision(
        e % 150, e % 170, 1000 - e % 150 - e % 130, 1400 - e % 170 - e % 110,
        (e % 90).cast("double"), (e % 90 + e % 160).cast("double"), (e % 255).cast("double"), F.lit(1000), F.lit(1400),
    )
    return fx.candidate_quads(spark, sf).select(
        "cand_id", box["trimmed"].alias("trimmed"), box["left"].alias("box_left"), box["top"].alias("box_top"),
        box["right"].alias("box_right"), box["bottom"].alias("box_bottom"),
    )
