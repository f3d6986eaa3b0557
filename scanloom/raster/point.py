"""Pointwise colour operators, on Columns of pixel rows and on numpy arrays of pixels alike.

Values are 0..255 ints. Arithmetic is single precision where the results depend on it. Missing pixels are
NULL in Columns and NaN in arrays, and both skip them in ``least`` and ``greatest``.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, functions as F

# Luma weights, colour-space matrices and white point.
SATURATION_WEIGHTS = (0.2127, 0.7151, 0.0722)
LUMA_WEIGHTS = (0.299, 0.587, 0.114)
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.537150, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE_X, WHITE_Z = 0.950456, 1.088754


def _columns(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def choose(condition, chosen, otherwise):
    return F.when(condition, chosen).otherwise(otherwise) if _columns(condition) else np.where(condition, chosen, otherwise)


def least(first, *others):
    if _columns(first, *others):
        return F.least(*[v if isinstance(v, Column) else F.lit(v) for v in (first, *others)])
    return reduce(np.fmin, others, first)


def greatest(first, *others):
    if _columns(first, *others):
        return F.greatest(*[v if isinstance(v, Column) else F.lit(v) for v in (first, *others)])
    return reduce(np.fmax, others, first)


def floor(v):
    return F.floor(v) if _columns(v) else np.floor(v)


def whole(v):
    """As an int, cut toward zero; missing values of an array stay NaN."""
    if _columns(v):
        return v.cast("int")
    if v.dtype.kind != "f":
        return v.astype(np.int32)
    return np.trunc(v) if np.isnan(v).any() else v.astype(np.int32)


def double(v):
    return v.cast("double") if _columns(v) else np.asarray(v, dtype=np.float64)


def f32(value, like=None):
    """In single precision; a plain number beside a Column ``like`` becomes a literal."""
    if _columns(value):
        return value.cast("float")
    if _columns(like):
        return F.lit(float(np.float32(value))).cast("float")
    return value.astype(np.float32) if isinstance(value, np.ndarray) else np.float32(value)


def let(values: dict, fn):
    """``fn`` of named intermediate values, each computed once per pixel."""
    if not _columns(*values.values()):
        return fn(values)
    bound = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.transform(F.array(bound), fn)[0]


def struct(**values):
    return F.struct(*[v.alias(n) for n, v in values.items()]) if _columns(*values.values()) else values


def to_byte(value, rounding: str = "truncate"):
    """Clamp to 0..255 and make it an int. Roundings: ``truncate``, ``half_up``, ``half_even``."""
    if rounding == "half_up":
        value = floor(value + 0.5)
    elif rounding == "half_even":
        value = F.rint(value.cast("double")) if _columns(value) else np.rint(double(value))
    elif rounding != "truncate":
        raise ValueError(rounding)
    if _columns(value):
        return F.greatest(F.lit(0), F.least(F.lit(255), value.cast("int")))
    # What is missing is 255, as NULL is to least.
    return np.fmax(0, np.fmin(255, np.trunc(value))).astype(np.int32)


def brightness(v, k: float):
    return to_byte(f32(v) + f32(255.0 * (k - 1.0), v))


def contrast(v, k: float):
    return to_byte(f32(v) * f32(k, v) + f32(128.0 * (1.0 - k), v))


def grayscale(r, g, b):
    wr, wg, wb = SATURATION_WEIGHTS
    return to_byte(f32(r) * f32(wr, r) + f32(g) * f32(wg, g) + f32(b) * f32(wb, b))


def saturate(r, g, b, k: float):
    """Saturation matrix; ``k=0`` is grayscale."""
    if k == 0.0:
        gray = grayscale(r, g, b)
        return {"r": gray, "g": gray, "b": gray}
    weights, inverse, channels = SATURATION_WEIGHTS, 1.0 - k, (r, g, b)

    def out(own: int):
        terms = [
            f32(weights[c] * inverse + (k if c == own else 0.0), r) * f32(channels[c]) for c in range(3)
        ]
        return to_byte(terms[0] + terms[1] + terms[2])

    return {"r": out(0), "g": out(1), "b": out(2)}


def affine_matrix(r, g, b, rows, rounding: str = "half_up"):
    """One 3x4 colour matrix applied at once, clamped once."""

    def out(row):
        return to_byte(r * float(row[0]) + g * float(row[1]) + b * float(row[2]) + float(row[3]), rounding)

    return {c: out(row) for c, row in zip("rgb", rows)}


def luma(r, g, b):
    wr, wg, wb = LUMA_WEIGHTS
    return to_byte(r * wr + g * wg + b * wb, "half_up")


# --- colour spaces -------------------------------------------------------------------------------


@cache
def _linear_levels() -> tuple[float, ...]:
    """Linear light of each 8-bit level."""
    s = np.arange(256) / 255.0
    return tuple(float(v) for v in np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4))


def _linear(v):
    if _columns(v):
        return F.get(F.lit(list(_linear_levels())), v)
    levels = np.array(_linear_levels())
    if v.dtype.kind != "f" and (not len(v) or (v.min() >= 0 and v.max() <= 255)):
        return levels[v]
    known = (v >= 0) & (v <= 255)
    return np.where(known, levels[np.where(known, v, 0).astype(int)], np.nan)


def _lab_f(t):
    return choose(t > 0.008856, F.cbrt(t) if _columns(t) else np.cbrt(t), t * 7.787 + 16.0 / 116.0)


def _power(v, exponent: float):
    return F.pow(v, F.lit(exponent)) if _columns(v) else np.power(v, exponent)


def rgb_to_lab(r, g, b):
    """8-bit Lab: lightness scaled to 0..255, a and b shifted by 128. A struct of l, a, bb."""

    def xyz(s):
        rows = [m[0] * s["r"] + m[1] * s["g"] + m[2] * s["b"] for m in RGB_TO_XYZ]
        return {"x": rows[0] / WHITE_X, "y": rows[1], "z": rows[2] / WHITE_Z}

    def roots(t):
        return {"y": t["y"], "fx": _lab_f(t["x"]), "fy": _lab_f(t["y"]), "fz": _lab_f(t["z"])}

    def lab(f):
        light = choose(f["y"] > 0.008856, f["fy"] * 116.0 - 16.0, f["y"] * 903.3)
        return struct(
            l=to_byte(light * 255.0 / 100.0, "half_up"),
            a=to_byte((f["fx"] - f["fy"]) * 500.0 + 128.0, "half_up"),
            bb=to_byte((f["fy"] - f["fz"]) * 200.0 + 128.0, "half_up"),
        )

    linear = {"r": _linear(r), "g": _linear(g), "b": _linear(b)}
    return let(linear, lambda s: let(xyz(s), lambda t: let(roots(t), lab)))


def lab_to_rgb(l, a, bb):  # noqa: E741
    """Back from 8-bit Lab. A struct of r, g, b."""

    def heights(s):
        low = s["light"] <= 8.0
        return {
            "y": choose(low, s["light"] / 903.3, _power((s["light"] + 16.0) / 116.0, 3.0)),
            "fy": choose(low, s["light"] / 903.3 * 7.787 + 16.0 / 116.0, (s["light"] + 16.0) / 116.0),
            "da": s["da"],
            "db": s["db"],
        }

    def sides(t):
        return {"y": t["y"], "fx": t["da"] / 500.0 + t["fy"], "fz": t["fy"] - t["db"] / 200.0}

    def back(f):
        return choose(f > 0.206893, _power(f, 3.0), (f - 16.0 / 116.0) / 7.787)

    def xyz(u):
        return {"x": back(u["fx"]) * WHITE_X, "y": u["y"], "z": back(u["fz"]) * WHITE_Z}

    def linear(v):
        return {c: v["x"] * m[0] + v["y"] * m[1] + v["z"] * m[2] for c, m in zip("rgb", XYZ_TO_RGB)}

    def gamma(v):
        curved = choose(v <= 0.0031308, v * 12.92, _power(greatest(v, 0.0), 1.0 / 2.4) * 1.055 - 0.055)
        return to_byte(curved * 255.0, "half_up")

    def rgb(w):
        return struct(**{c: gamma(w[c]) for c in "rgb"})

    start = {"light": l * (100.0 / 255.0), "da": a - 128, "db": bb - 128}
    return let(
        start,
        lambda s: let(heights(s), lambda t: let(sides(t), lambda u: let(xyz(u), lambda v: let(linear(v), rgb)))),
    )


def rgb_to_hsv(r, g, b):
    """8-bit HSV: hue in half degrees, saturation and value 0..255. A struct of hue, sat, val."""

    def turn(s):
        sides = choose(
            s["top"] == s["g"], 30.0 * (s["b"] - s["r"]) / s["delta"] + 60.0, 30.0 * (s["r"] - s["g"]) / s["delta"] + 120.0
        )
        around = choose(s["delta"] == 0, 0.0, choose(s["top"] == s["r"], 30.0 * (s["g"] - s["b"]) / s["delta"], sides))
        return {"turn": around, "top": s["top"], "delta": s["delta"]}

    def hsv(t):
        hue = whole(floor(choose(t["turn"] < 0, t["turn"] + 180.0, t["turn"]) + 0.5)) % 180
        sat = whole(choose(t["top"] == 0, 0.0, floor(255.0 * t["delta"] / t["top"] + 0.5)))
        return struct(hue=hue, sat=sat, val=t["top"])

    start = {"r": r, "g": g, "b": b, "top": greatest(r, g, b), "delta": greatest(r, g, b) - least(r, g, b)}
    return let(start, lambda s: let(turn(s), hsv))


def hsv_to_rgb(hue, sat, val):
    """Back from 8-bit HSV. A struct of r, g, b."""

    def mixes(s):
        v, k, part = s["val"], s["k"], s["turn"] - floor(s["turn"])
        return {
            "sector": whole(floor(s["turn"])) % 6,
            "v": double(v), "p": v * (1 - k), "q": v * (1 - part * k), "t": v * (1 - (1 - part) * k),
        }

    def rgb(m):
        def pick(order: str):
            chosen = m[order[5]]
            for i in range(4, -1, -1):
                chosen = choose(m["sector"] == i, m[order[i]], chosen)
            return to_byte(chosen, "half_up")

        return struct(r=pick("vqpptv"), g=pick("tvvqpp"), b=pick("pptvvq"))

    return let({"turn": hue / 30.0, "k": sat / 255.0, "val": val}, lambda s: let(mixes(s), rgb))


# --- single-channel operators --------------------------------------------------------------------


def chroma(a, bb):
    da, db = f32(a) - f32(128.0, a), f32(bb) - f32(128.0, bb)
    squared = double(da * da + db * db)
    return to_byte(F.sqrt(squared) if _columns(squared) else np.sqrt(squared))


def compress_chroma(v, factor):
    return to_byte((f32(v) - f32(128.0, v)) * f32(factor, v) + f32(128.0, v))


def shift(v, bias):
    """Move a colour channel so that ``bias`` becomes neutral."""
    return to_byte(f32(v) - f32(bias - 128.0))


def blend_toward(v, mask, target: float, strength: float):
    """Move masked values toward a target."""
    share = np.float32(255.0) * np.float32(strength / 255.0)
    moved = f32(v) * f32(np.float32(1.0) - share, v) + f32(np.float32(target) * share, v)
    return choose(mask > 0, to_byte(moved), v)


def weighted_blend(a, b, share: float):
    """``share`` of the first and the rest of the second, rounded."""
    return to_byte(a * share + b * round(1.0 - share, 10), "half_even")


def masked_blend(base, reference, mask, weight):
    w = f32(weight, base)
    mixed = f32(base) * (f32(1.0, base) - w) + f32(reference) * w
    return choose(mask > 0, to_byte(mixed), base)


def masked_min_scaled(base, reference, mask, scale: float):
    return choose(mask > 0, least(base, to_byte(f32(reference) * f32(scale, reference))), base)


def flat_field(l, surface, mean):  # noqa: E741
    """Divide out the illumination surface, keeping its mean."""
    # Division of Columns yields a double; rounding it back is the same as dividing in single precision.
    return to_byte(f32((f32(l) + f32(1.0, l)) / (f32(surface) + f32(1.0, l))) * f32(mean))


def stretch(v, black, white):
    gain = f32(255.0 / (white - black))
    return to_byte((f32(least(v, white)) - f32(black)) * gain)


def flag(condition):
    return condition.cast("int") if _columns(condition) else condition.astype(np.int32)


def accent_boost(hue, sat, val, accent):
    """Stronger, slightly brighter colour where the accent mask is set."""
    s = to_byte(f32(sat) * f32(1.38, sat) + f32(8.0, sat))
    v = to_byte(f32(val) * f32(1.05, val) + f32(2.0, val))
    return {
        "hue": hue,
        "sat": choose(accent > 0, s, sat),
        "val": choose(accent > 0, v, val),
    }


# --- presets made of pointwise operators -----------------------------------------------------------

# Operators of the light presets, in order.
PRESET_OPS = {
    "sharpen": (("contrast", 1.4), ("brightness", 1.05)),
    "vivid": (("saturate", 2.0), ("contrast", 1.2)),
}


def _each(fn):
    return lambda p, k: {c: fn(v, k) for c, v in p.items()}


def _gray(p, _k):
    gray = grayscale(p["r"], p["g"], p["b"])
    return {c: gray for c in "rgb"}


OPERATORS = {
    "brightness": _each(brightness),
    "contrast": _each(contrast),
    "grayscale": _gray,
    "saturate": lambda p, k: saturate(p["r"], p["g"], p["b"], k),
}


def preset_matrix(ops) -> list[list[float]]:
    """The operators of a preset multiplied into one 3x4 matrix."""
    total = np.hstack([np.eye(3), np.zeros((3, 1))])
    for name, k in ops:
        if name == "contrast":
            step, offset = np.eye(3) * k, np.full(3, 128.0 * (1.0 - k))
        elif name == "brightness":
            step, offset = np.eye(3), np.full(3, 255.0 * (k - 1.0))
        else:
            weights = np.array(SATURATION_WEIGHTS)
            share = 0.0 if name == "grayscale" else k
            step, offset = np.tile(weights * (1.0 - share), (3, 1)) + np.eye(3) * share, np.zeros(3)
        total = np.hstack([step @ total[:, :3], (step @ total[:, 3] + offset)[:, None]])
    return [[float(v) for v in row] for row in total]
