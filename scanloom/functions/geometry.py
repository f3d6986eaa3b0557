"""Page, preview and outline geometry as Column expressions.

An outline ("quad") is ``array<struct<x, y>>`` of four corners; ordered quads run top-left,
top-right, bottom-right, bottom-left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# A4 ratios, tolerances and page sizes.
A4_PORTRAIT = 210.0 / 297.0
A4_LANDSCAPE = 297.0 / 210.0
A4_TOLERANCE = 0.20
PDF_SHORT, PDF_LONG = 595, 842
POINTS_SHORT, POINTS_LONG = 595.28, 841.89


def _d(value: Column | int | float) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def half_up(value: Column) -> Column:
    """Round half up to an int, as done for positive pixel sizes."""
    return F.floor(value + 0.5).cast("int")


# --- rotation ----------------------------------------------------------------------------------


def norm_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360)).cast("int")


def quarter_left(degrees: Column) -> Column:
    """Turn by one quarter to the left; the remainder keeps the sign of its operand."""
    return ((degrees - 90 + 360) % 360).cast("int")


def rotated_dims(w: Column, h: Column, degrees: Column) -> Column:
    swap = norm_rotation(degrees).isin(90, 270)
    return F.struct(F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"))


# --- preview sizes -----------------------------------------------------------------------------


def sample_size(w: Column, h: Column, limit: Column) -> Column:
    """Smallest power of two that brings the long side (integer division) to at most twice the limit."""
    longest = F.greatest(w, h)
    powers = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda e: F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), e).cast("long"))
    fits = F.filter(powers, lambda p: F.floor(longest / p) <= limit * 2)
    return F.array_min(fits).cast("int")


def fit_dims(w: Column, h: Column, limit: int, mode: str = "round") -> Column:
    """Scale to fit without enlarging. ``round``: integer sides, at least 1; ``exact``: fractional."""
    longest = F.greatest(w, h)
    scale = F.when(longest <= limit, F.lit(1.0)).otherwise(F.lit(float(limit)) / longest)
    if mode == "exact":
        return F.struct((w * scale).alias("w"), (h * scale).alias("h"))
    return F.struct(
        F.greatest(F.lit(1), half_up(w * scale)).alias("w"), F.greatest(F.lit(1), half_up(h * scale)).alias("h")
    )


def center_square(w: Column, h: Column) -> Column:
    side = F.least(w, h)
    return F.struct(
        side.cast("int").alias("side"),
        F.floor((w - side) / 2).cast("int").alias("left"),
        F.floor((h - side) / 2).cast("int").alias("top"),
    )


# --- page sizes --------------------------------------------------------------------------------


def _relative(actual: Column, expected: float) -> Column:
    return F.abs(actual - F.lit(expected)) / F.lit(expected)


def display_ratio(w: Column, h: Column) -> Column:
    ratio = _d(w) / _d(h)
    return (
        F.when((w <= 0) | (h <= 0), F.lit(A4_PORTRAIT))
        .when(_relative(ratio, A4_PORTRAIT) <= A4_TOLERANCE, F.lit(A4_PORTRAIT))
        .when(_relative(ratio, A4_LANDSCAPE) <= A4_TOLERANCE, F.lit(A4_LANDSCAPE))
        .otherwise(ratio)
    )


def pdf_size(w: Column, h: Column) -> Column:
    """Integer page size: A4 when the ratio snaps, else the long edge fixed."""
    ratio = display_ratio(w, h)
    portrait = F.abs(ratio - A4_PORTRAIT) <= 0.0001
    landscape = F.abs(ratio - A4_LANDSCAPE) <= 0.0001
    wide = ratio >= 1
    width = (
        F.when(portrait, PDF_SHORT)
        .when(landscape | wide, PDF_LONG)
        .otherwise(F.greatest(F.lit(1), half_up(PDF_LONG * ratio)))
    )
    height = (
        F.when(portrait, PDF_LONG)
        .when(landscape, PDF_SHORT)
        .when(wide, F.greatest(F.lit(1), half_up(PDF_LONG / ratio)))
        .otherwise(PDF_LONG)
    )
    return F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))


def pdf_rect(w: Column, h: Column) -> Column:
    """Page size in points; the tolerance is taken against the ratios of the point sizes."""
    ratio = _d(w) / _d(h)
    bad = (w <= 0) | (h <= 0)
    portrait = bad | (_relative(ratio, POINTS_SHORT / POINTS_LONG) <= A4_TOLERANCE)
    landscape = _relative(ratio, POINTS_LONG / POINTS_SHORT) <= A4_TOLERANCE
    width = (
        F.when(portrait, POINTS_SHORT).when(landscape | (ratio >= 1), POINTS_LONG).otherwise(POINTS_LONG * ratio)
    )
    height = (
        F.when(portrait, POINTS_LONG)
        .when(landscape, POINTS_SHORT)
        .when(ratio >= 1, POINTS_LONG / ratio)
        .otherwise(POINTS_LONG)
    )
    return F.struct(width.alias("w"), height.alias("h"))


def placement(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Scale and offsets that centre an image on its page."""
    scale = F.least(_d(page_w) / _d(w), _d(page_h) / _d(h))
    return F.struct(
        scale.alias("scale"),
        ((_d(page_w) - w * scale) / 2).alias("dx"),
        ((_d(page_h) - h * scale) / 2).alias("dy"),
    )


# --- outlines ----------------------------------------------------------------------------------


def points(corners: Column) -> list[Column]:
    return [F.element_at(corners, i + 1) for i in range(4)]


def order_corners(corners: Column) -> Column:
    """Corners by sum and difference of coordinates; among equals the first listed wins."""

    def extreme(key, largest: bool) -> Column:
        tagged = F.transform(
            corners,
            lambda p, i: F.struct((-key(p) if largest else key(p)).alias("k"), i.alias("i"), p.alias("p")),
        )
        return F.array_min(tagged)["p"]

    def total(p: Column) -> Column:
        return p["x"] + p["y"]

    def difference(p: Column) -> Column:
        return p["x"] - p["y"]

    return F.array(
        extreme(total, False), extreme(difference, True), extreme(total, True), extreme(difference, False)
    )


def distance(p: Column, q: Column) -> Column:
    dx, dy = _d(p["x"]) - _d(q["x"]), _d(p["y"]) - _d(q["y"])
    return F.sqrt(dx * dx + dy * dy)


def side_lengths(ordered: Column) -> Column:
    tl, tr, br, bl = points(ordered)
    return F.struct(
        distance(tl, tr).alias("top"),
        distance(bl, br).alias("bottom"),
        distance(tl, bl).alias("left"),
        distance(tr, br).alias("right"),
    )


def quad_area(corners: Column) -> Column:
    """Area enclosed by the corners in the given order."""
    p = points(corners)
    twice = sum(
        (_d(p[i]["x"]) * _d(p[(i + 1) % 4]["y"]) - _d(p[(i + 1) % 4]["x"]) * _d(p[i]["y"]) for i in range(4)),
        F.lit(0.0),
    )
    return F.abs(twice) / 2


def angle_deg(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b`` in degrees; 0 when an arm has no length."""
    ux, uy = _d(a["x"]) - _d(b["x"]), _d(a["y"]) - _d(b["y"])
    vx, vy = _d(c["x"]) - _d(b["x"]), _d(c["y"]) - _d(b["y"])
    u, v = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ux * vx + uy * vy) / (u * v)))
    return F.when((u == 0) | (v == 0), F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def is_convex(corners: Column) -> Column:
    """All turns go the same way."""
    p = points(corners)
    turns = []
    for i in range(4):
        a, b, c = p[i], p[(i + 1) % 4], p[(i + 2) % 4]
        turns.append((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    left = reduce(lambda s, t: s & t, [t > 0 for t in turns])
    right = reduce(lambda s, t: s & t, [t < 0 for t in turns])
    return left | right


def corner_angles(ordered: Column) -> Column:
    """Angles at the second, third, fourth and first corner."""
    p = points(ordered)
    return F.array(*[angle_deg(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)])


def shape_score(angles: Column, sides: Column, area_ratio: Column) -> Column:
    """How page-like an outline is: right angles, equal opposite sides, share of the image."""
    right = sum(
        (1 - F.least(F.lit(1.0), F.abs(F.element_at(angles, i + 1) - 90) / 30) for i in range(4)), F.lit(0.0)
    ) / 4
    parallel = (
        F.least(sides["top"], sides["bottom"]) / F.greatest(sides["top"], sides["bottom"])
        + F.least(sides["left"], sides["right"]) / F.greatest(sides["left"], sides["right"])
    ) / 2
    return right * 0.45 + parallel * 0.35 + area_ratio * 0.20


def quad_score(ordered: Column, area: Column, image_area: Column) -> Column:
    return shape_score(corner_angles(ordered), side_lengths(ordered), area / image_area)


def snap_ratio(ratio: Column, tolerance: float = A4_TOLERANCE) -> Column:
    """The nearer A4 ratio when within tolerance, else NULL; a tie goes to portrait."""
    portrait, landscape = F.abs(ratio / A4_PORTRAIT - 1), F.abs(ratio / A4_LANDSCAPE - 1)
    return F.when((portrait <= landscape) & (portrait <= tolerance), F.lit(A4_PORTRAIT)).when(
        (portrait > landscape) & (landscape <= tolerance), F.lit(A4_LANDSCAPE)
    )


def ratio_of_sides(s: Column) -> Column:
    """Paper ratio from the longest sides, corrected for a strongly foreshortened portrait page."""
    max_w, max_h = F.greatest(s["top"], s["bottom"]), F.greatest(s["left"], s["right"])
    min_w = F.greatest(F.lit(1.0), F.least(s["top"], s["bottom"]))
    min_h = F.greatest(F.lit(1.0), F.least(s["left"], s["right"]))
    seen = max_w / max_h
    w_skew, h_skew = max_w / min_w, max_h / min_h
    foreshortened = (seen < 1.05) & (w_skew > 1.20) & (w_skew >= h_skew)
    return snap_ratio(F.when(foreshortened, min_w / max_h).otherwise(seen))


def quad_paper_ratio(ordered: Column) -> Column:
    return ratio_of_sides(side_lengths(ordered))


def sides_paper_ratio(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """Paper ratio from geometric means of opposite sides."""

    def mean(a: Column, b: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0001), _d(a)) * F.greatest(F.lit(0.0001), _d(b)))

    w, h = mean(top, bottom), mean(left, right)
    ratio = F.least(w, h) / F.greatest(F.lit(0.0001), F.greatest(w, h))
    return F.when(
        F.abs(ratio / A4_PORTRAIT - 1) <= A4_TOLERANCE,
        F.when(w > h, F.lit(A4_LANDSCAPE)).otherwise(F.lit(A4_PORTRAIT)),
    )


def quad_paper_ratio_gm(ordered: Column) -> Column:
    s = side_lengths(ordered)
    return sides_paper_ratio(s["top"], s["bottom"], s["left"], s["right"])


def normalized_size(w: Column, h: Column, ratio: Column, mode: str = "truncate") -> Column:
    """Size with the given ratio and the same area. Modes: ``truncate``, ``round``, ``exact``."""
    area = _d(w) * _d(h)
    tw, th = F.sqrt(area * ratio), F.sqrt(area / ratio)
    if mode == "exact":
        return F.struct(tw.alias("w"), th.alias("h"))
    whole = half_up if mode == "round" else (lambda v: F.floor(v).cast("int"))
    return F.struct(F.greatest(F.lit(1), whole(tw)).alias("w"), F.greatest(F.lit(1), whole(th)).alias("h"))


def normalize_mode(w: Column, h: Column, ratio: Column) -> Column:
    """What normalising a page of this size to ``ratio`` (or its own snapped ratio) does."""
    own = F.when((w <= 0) | (h <= 0), F.lit(A4_PORTRAIT)).otherwise(snap_ratio(_d(w) / _d(h)))
    target = F.coalesce(ratio, own)
    size = normalized_size(w, h, target, "round")
    return (
        F.when(target.isNull(), "keep_original_ratio")
        .when((size["w"] == w) & (size["h"] == h), "already_close_to_a4")
        .when(target == A4_PORTRAIT, "a4_portrait")
        .otherwise("a4_landscape")
    )


def detection_scale(w: Column, h: Column, mode: str = "height", limit: int = 500) -> Column:
    """Scale to the detection size: by height, or by the long side."""
    side = h if mode == "height" else F.greatest(w, h)
    return F.when(side > limit, F.lit(float(limit)) / side).otherwise(F.lit(1.0))


def detection_ratio(w: Column, h: Column, mode: str = "height", limit: int = 500) -> Column:
    """Factor from detection coordinates back to the image."""
    return h / half_up(h * detection_scale(w, h, mode, limit))


def _margins(corners: Column, w: Column, h: Column):
    mx, my = w * 0.02, h * 0.02
    return [
        lambda p: p["x"] < mx,
        lambda p: p["x"] > w - mx,
        lambda p: p["y"] < my,
        lambda p: p["y"] > h - my,
    ]


def touched_sides(corners: Column, w: Column, h: Column) -> Column:
    """How many image sides at least one corner touches (0 to 4)."""
    return sum((F.exists(corners, t).cast("int") for t in _margins(corners, w, h)), F.lit(0))


def edge_touches(corners: Column, w: Column, h: Column) -> Column:
    """Corner-by-corner count of touched sides."""
    return sum((F.size(F.filter(corners, t)) for t in _margins(corners, w, h)), F.lit(0))


def candidate_score(
    warped_w: Column, warped_h: Column, w: Column, h: Column, center: Column, border: Column, touches: Column
) -> Column:
    """Score of a straightened candidate from its size and its centre and border brightness (0..255)."""
    area = _d(warped_w * warped_h) / _d(w * h)
    aspect = F.greatest(warped_w, warped_h) / F.greatest(F.lit(1), F.least(warped_w, warped_h))
    aspect_penalty = F.when(aspect < 2.4, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (aspect - 2.4) / 2))
    edge_penalty = F.least(F.lit(1.8), touches * 0.35)
    score = area * 4.0 + center / 255 * 1.8 - (0.35 - border / 255) * 1.2 - aspect_penalty - edge_penalty
    return F.when(area < 0.08, F.lit(-1.0)).otherwise(score)


def adjusted_score(score: Column, support: Column, source: Column, kind: Column, sides: Column) -> Column:
    """Candidate score with edge support, and bonus or malus by where the candidate came from."""
    supported = score + support * 2.2
    return (
        F.when(score < 0, score)
        .when((source == "merged") & (kind == "quad"), supported + 0.15)
        .when((source == "paper") & (sides >= 3), supported - 1.6)
        .otherwise(supported)
    )


def trim_decision(
    x: Column, y: Column, bw: Column, bh: Column, p10: Column, p90: Column, border: Column, w: Column, h: Column
) -> Column:
    """Box to trim a page to, given the paper's bounding box and page statistics.

    Returns the padded box, or the whole page when trimming would take too much.
    """
    spread = (p90 - p10) / 255.0
    careful = (spread > 0.45) & (border < 180)
    flat = spread < 0.20
    pad = F.when(flat, 0.04).otherwise(0.02)
    pad_x, pad_y = F.rint(bw * pad).cast("int"), F.rint(bh * pad).cast("int")
    left, top = F.greatest(F.lit(0), x - pad_x), F.greatest(F.lit(0), y - pad_y)
    right, bottom = F.least(w, x + bw + pad_x), F.least(h, y + bh + pad_y)
    kept_w, kept_h = (right - left) / w, (bottom - top) / h
    most = F.greatest(left / w, (w - right) / w, top / h, (h - bottom) / h)
    min_keep = F.when(careful, 0.90).otherwise(0.82)
    max_side = F.when(careful, 0.08).otherwise(0.15)
    refuse = (
        (kept_w < 0.5)
        | (kept_h < 0.5)
        | (flat & (border > 175) & (most > 0.10))
        | (kept_w < min_keep)
        | (kept_h < min_keep)
        | (most > max_side)
    )

    def pick(whole: Column, box: Column) -> Column:
        return F.when(refuse, whole).otherwise(box).cast("int")

    return F.struct(
        (~refuse).alias("trimmed"),
        pick(F.lit(0), left).alias("left"),
        pick(F.lit(0), top).alias("top"),
        pick(w, right).alias("right"),
        pick(h, bottom).alias("bottom"),
    )


def placeholder_ratio(ratio: Column) -> Column:
    return F.coalesce(ratio, F.lit(A4_PORTRAIT))
