"""Masks (0/1 planes): thresholds, algebra (on Columns and arrays), and the page-content masks built from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.raster import neighbourhood as nb, point, stats
from scanloom.raster.grid import attach, map_bands, map_planes, shared, whole, without

# --- single-pixel masks ----------------------------------------------------------------------------


def above(v, t):
    return point.flag(v > t)


def at_most(v, t):
    return point.flag(v <= t)


def both(a, b):
    return point.least(a, b)


def either(a, b):
    return point.greatest(a, b)


def negate(a):
    return 1 - a


def visible(l, t: int = 48):  # noqa: E741
    return above(l, t)


# --- page masks --------------------------------------------------------------------------------------


def _percentile(mode: str, p: float) -> Column:
    """Interpolated and cut to an int in docs mode, nearest rank in app mode."""
    return F.floor(stats.linear(p)) if mode == "docs" else stats.nearest(p)


# Lowest limit and page percentile behind each mask.
LIMITS = {
    "paper": (96, 0.18),
    "structure": (72, 0.10),
    "dark": (70, 0.12),
    "board": (156, 0.58),
    "candidate": (110, 0.55),
}


def with_limits(px: DataFrame, l: str, wanted: list[str], mode: str = "docs") -> DataFrame:  # noqa: E741
    """Attach the brightness limits of several masks, ``limit_<name>``, from one histogram."""
    if whole(px):
        return _limits_beside(px, l, wanted, mode)
    px = shared(px)
    limits = {
        f"limit_{n}": F.greatest(F.lit(LIMITS[n][0]), _percentile(mode, LIMITS[n][1])).cast("int") for n in wanted
    }
    return attach(px, stats.percentiles(stats.histogram(px, l), **limits))


def _limits_beside(px: DataFrame, l: str, wanted: list[str], mode: str) -> DataFrame:  # noqa: E741
    """``with_limits`` of pages of one band: their limits as planes beside the others."""
    pick = (lambda v, p: np.floor(stats.linear_of(v, p))) if mode == "docs" else stats.nearest_of

    def limits(v):
        values = stats.ranked(v)
        found = [np.fmax(LIMITS[n][0], pick(values, LIMITS[n][1])) for n in wanted]
        return {f"limit_{n}": np.broadcast_to(f.astype(np.int32), v.shape) for n, f in zip(wanted, found)}

    return map_bands(px, [l], limits, [f"limit_{n}" for n in wanted])


def _limited(px: DataFrame, l: str, name: str, mode: str) -> DataFrame:  # noqa: E741
    return px if f"limit_{name}" in px.columns else with_limits(px, l, [name], mode)


def _bright_and_plain(px: DataFrame, l: str, limit: str, most: int, name: str, mode: str) -> DataFrame:  # noqa: E741
    """Brighter than the page's limit and with little colour."""
    return map_planes(
        _limited(px, l, limit, mode),
        [l, "a", "bb"],
        lambda v, a, b, lowest: both(above(v, lowest), at_most(point.chroma(a, b), most)),
        [name],
        [f"limit_{limit}"],
    )


def paper_mask(px: DataFrame, l: str, name: str, mode: str = "docs") -> DataFrame:  # noqa: E741
    raw = _bright_and_plain(px, l, "paper", 34, name, mode)
    repeat = "grouped" if mode == "docs" else "repeated"
    return nb.mask_steps(raw, name, nb.close_steps(5, 2, repeat) + nb.open_steps(5))


def paper_candidate_mask(px: DataFrame, l: str, name: str) -> DataFrame:  # noqa: E741
    raw = _bright_and_plain(px, l, "candidate", 42, name, "docs")
    return nb.mask_steps(raw, name, nb.close_steps(9, 2) + nb.open_steps(9))


def structure_mask(px: DataFrame, l: str, name: str, mode: str = "docs") -> DataFrame:  # noqa: E741
    """Strokes: darker than their surroundings, or among the darkest of the page."""
    adaptive = nb.adaptive_inverse(_limited(px, l, "structure", mode), l, "_adaptive", mode=mode)
    raw = without(map_planes(
        adaptive, [l, "_adaptive"], lambda v, m, lowest: either(m, at_most(v, lowest)), [name], ["limit_structure"]
    ), "_adaptive")
    return nb.mask_steps(raw, name, nb.open_steps(3) + [("dilate", 3)] * 2)


def accent_mask(px: DataFrame, l: str, name: str, whiteboard: bool = False) -> DataFrame:  # noqa: E741
    """Clearly coloured and visible; the whiteboard variant also takes fainter colour."""
    raw = map_planes(
        px, [l, "a", "bb"], lambda v, a, b: both(above(point.chroma(a, b), 28), visible(v)), [name]
    )
    opened = nb.open_(raw, name, 3)
    if not whiteboard:
        return opened
    wider = map_planes(
        opened,
        [l, "a", "bb", name],
        lambda v, a, b, m: either(m, both(above(point.chroma(a, b), 18), visible(v, 42))),
        [name],
    )
    return nb.open_(wider, name, 3)


def sauvola(px: DataFrame, plane: str, k: float = 0.18, size: int = 31, dynamic: float = 128.0) -> DataFrame:
    """Adds ``soft`` and ``strong`` stroke masks from local mean and deviation."""
    def marks(v):
        mean, std = nb.local_mean_std(v, size)
        below = v <= mean * (1.0 + k * (std / dynamic - 1.0))
        depth = mean - v
        return {
            "soft": point.flag(below & (depth >= point.greatest(std * 0.22, 10.0))),
            "strong": point.flag(below & (depth >= point.greatest(std * 0.40, 22.0))),
        }

    return map_bands(px, [plane], marks, ["soft", "strong"])


def paper_color_mask(px: DataFrame, sat: str, l: str, paper: str, accent: str, name: str, mode: str = "docs") -> DataFrame:  # noqa: E741
    """Coloured content on paper, joined with the accents.

    Needs the page's ``richness`` and ``top_sat`` (strongest visible colour on paper). In docs mode a
    page without such content keeps its accent mask as it is.
    """
    limit = lambda rich: 22.0 - rich * 8.0

    def colored(s, v, p, m, rich):
        strong = s >= limit(rich) if mode == "docs" else s > point.floor(limit(rich))
        return either(point.flag((p > 0) & (v > 48) & strong), m)

    opened = nb.open_(map_planes(px, [sat, l, paper, accent], colored, [name], ["richness"]), name, 3)
    if mode == "docs":
        kept = lambda m, a, top, rich: point.choose(top >= limit(rich), m, a)
        opened = map_planes(opened, [name, accent], kept, [name], ["top_sat", "richness"])
    return opened
