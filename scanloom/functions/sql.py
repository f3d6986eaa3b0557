"""Geometry functions for SQL users, as SQL expressions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

P, L = "(210D/297D)", "(297D/210D)"
SNAP = (
    "CASE WHEN abs(r/{p}-1) <= abs(r/{l}-1) AND abs(r/{p}-1) <= 0.2D THEN {p} "
    "WHEN abs(r/{p}-1) > abs(r/{l}-1) AND abs(r/{l}-1) <= 0.2D THEN {l} END"
).format(p=P, l=L)

QUAD, SIDES = "ARRAY<STRUCT<x: INT, y: INT>>", "top DOUBLE, bottom DOUBLE, lft DOUBLE, rgt DOUBLE"
A, B, C = "element_at(c, i+1)", "element_at(c, (i+1)%4+1)", "element_at(c, (i+2)%4+1)"
TURN = f"({B}.x-{A}.x)*({C}.y-{B}.y)-({B}.y-{A}.y)*({C}.x-{B}.x)"
GW, GH = (f"sqrt(greatest(0.0001D, {p})*greatest(0.0001D, {q}))" for p, q in (("top", "bottom"), ("lft", "rgt")))

FUNCTIONS = {
    "display_ratio(w INT, h INT) RETURNS DOUBLE": (
        f"CASE WHEN w <= 0 OR h <= 0 THEN {P} WHEN abs(w/h-{P})/{P} <= 0.2D THEN {P} "
        f"WHEN abs(w/h-{L})/{L} <= 0.2D THEN {L} ELSE w/h END"
    ),
    "snap_ratio(r DOUBLE) RETURNS DOUBLE": SNAP,
    "normalized_width(w INT, h INT, r DOUBLE) RETURNS INT": "greatest(1, cast(floor(sqrt(cast(w AS DOUBLE)*h*r)) AS INT))",
    "normalized_height(w INT, h INT, r DOUBLE) RETURNS INT": "greatest(1, cast(floor(sqrt(cast(w AS DOUBLE)*h/r)) AS INT))",
    "point_distance(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": "sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2))",
    "quarter_left(d INT) RETURNS INT": "(d - 90 + 360) % 360",
    "norm_rotation(d INT) RETURNS INT": "pmod(d, 360)",
    "placement_scale(w DOUBLE, h DOUBLE, page_w DOUBLE, page_h DOUBLE) RETURNS DOUBLE": "least(page_w/w, page_h/h)",
    # Page sizes: whole PDF units, and points.
    "pdf_width(w INT, h INT) RETURNS INT": (
        f"CASE WHEN abs(display_ratio(w, h)-{P}) <= 0.0001D THEN 595 WHEN display_ratio(w, h) >= 1 THEN 842 "
        "ELSE greatest(1, cast(floor(842*display_ratio(w, h)+0.5D) AS INT)) END"
    ),
    "pdf_height(w INT, h INT) RETURNS INT": (
        f"CASE WHEN abs(display_ratio(w, h)-{P}) <= 0.0001D THEN 842 WHEN abs(display_ratio(w, h)-{L}) <= 0.0001D THEN 595 "
        "WHEN display_ratio(w, h) >= 1 THEN greatest(1, cast(floor(842/display_ratio(w, h)+0.5D) AS INT)) ELSE 842 END"
    ),
    "pdf_rect_width(w DOUBLE, h DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN w <= 0 OR h <= 0 OR abs(w/h-595.28D/841.89D)/(595.28D/841.89D) <= 0.2D THEN 595.28D "
        "WHEN abs(w/h-841.89D/595.28D)/(841.89D/595.28D) <= 0.2D OR w/h >= 1 THEN 841.89D ELSE 841.89D*(w/h) END"
    ),
    "pdf_rect_height(w DOUBLE, h DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN w <= 0 OR h <= 0 OR abs(w/h-595.28D/841.89D)/(595.28D/841.89D) <= 0.2D THEN 841.89D "
        "WHEN abs(w/h-841.89D/595.28D)/(841.89D/595.28D) <= 0.2D THEN 595.28D WHEN w/h >= 1 THEN 841.89D/(w/h) ELSE 841.89D END"
    ),
    # Outlines: four corners, ``array<struct<x, y>>``.
    f"order_corners(c {QUAD}) RETURNS {QUAD}": (
        "array(array_min(transform(c, (p, i) -> struct(p.x+p.y, i, p))).p, array_min(transform(c, (p, i) -> struct(p.y-p.x, i, p))).p, "
        "array_min(transform(c, (p, i) -> struct(-p.x-p.y, i, p))).p, array_min(transform(c, (p, i) -> struct(p.x-p.y, i, p))).p)"
    ),
    f"is_convex_quad(c {QUAD}) RETURNS BOOLEAN": (
        f"forall(transform(sequence(0, 3), i -> {TURN}), t -> t > 0) OR forall(transform(sequence(0, 3), i -> {TURN}), t -> t < 0)"
    ),
    "corner_angle(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE, cx DOUBLE, cy DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN point_distance(ax, ay, bx, by) = 0 OR point_distance(cx, cy, bx, by) = 0 THEN 0D ELSE "
        "degrees(acos(least(1D, greatest(-1D, ((ax-bx)*(cx-bx)+(ay-by)*(cy-by))/(point_distance(ax, ay, bx, by)*point_distance(cx, cy, bx, by)))))) END"
    ),
    "shape_score(a1 DOUBLE, a2 DOUBLE, a3 DOUBLE, a4 DOUBLE, top DOUBLE, bottom DOUBLE, lft DOUBLE, rgt DOUBLE, area_ratio DOUBLE) RETURNS DOUBLE": (
        "(4 - least(1D, abs(a1-90)/30) - least(1D, abs(a2-90)/30) - least(1D, abs(a3-90)/30) - least(1D, abs(a4-90)/30))/4*0.45D "
        "+ (least(top, bottom)/greatest(top, bottom) + least(lft, rgt)/greatest(lft, rgt))/2*0.35D + area_ratio*0.20D"
    ),
    f"sides_ratio({SIDES}) RETURNS DOUBLE": (
        "snap_ratio(CASE WHEN greatest(top, bottom)/greatest(lft, rgt) < 1.05D AND greatest(top, bottom)/greatest(1D, least(top, bottom)) > 1.20D "
        "AND greatest(top, bottom)/greatest(1D, least(top, bottom)) >= greatest(lft, rgt)/greatest(1D, least(lft, rgt)) "
        "THEN greatest(1D, least(top, bottom))/greatest(lft, rgt) ELSE greatest(top, bottom)/greatest(lft, rgt) END)"
    ),
    f"mean_sides_ratio({SIDES}) RETURNS DOUBLE": (
        f"CASE WHEN abs(least({GW}, {GH})/greatest(0.0001D, greatest({GW}, {GH}))/{P}-1) <= 0.2D THEN CASE WHEN {GW} > {GH} THEN {L} ELSE {P} END END"
    ),
}

def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions in this session and return their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
