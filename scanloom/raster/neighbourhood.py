"""Operators that look at neighbouring pixels: morphology, median, blur, box statistics, gradients."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm.common import ship
from scanloom.raster import grid
from scanloom.raster.grid import map_bands, map_planes, padded


def ellipse(size: int) -> dict[int, int]:
    """Half-width of an elliptic element of the given size at each row offset."""
    r = size // 2
    return {dy: round(math.sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)}


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma**2))
    return [float(v) for v in weights / weights.sum()]


# The small blur kernels.
BLUR3 = [0.25, 0.5, 0.25]
BLUR5 = [0.0625, 0.25, 0.375, 0.25, 0.0625]


def extremum(stack: np.ndarray, size: int, pick) -> np.ndarray:
    """Largest (``np.fmax``) or smallest (``np.fmin``) value under the element; values outside the page are ignored."""
    shape, n = ellipse(size), stack.shape[1]
    wide, out = {0: stack}, stack.copy()
    for d in range(1, max(shape.values()) + 1):
        out = out.copy()
        pick(out[:, :, d:], stack[:, :, :-d], out=out[:, :, d:])
        pick(out[:, :, :-d], stack[:, :, d:], out=out[:, :, :-d])
        wide[d] = out
    result = wide[shape[0]].copy()
    for dy, r in shape.items():
        if 0 < dy < n:
            pick(result[:, :-dy], wide[r][:, dy:], out=result[:, :-dy])
        elif 0 < -dy < n:
            pick(result[:, -dy:], wide[r][:, :dy], out=result[:, -dy:])
    return result


def _small(stack: np.ndarray) -> np.ndarray:
    """The same values as bytes, where they fit."""
    fits = stack.dtype.kind != "f" and stack.size and stack.min() >= 0 and stack.max() <= 255
    return stack.astype(np.uint8) if fits else stack


def morphed(stack: np.ndarray, steps: list[tuple[str, int]]) -> np.ndarray:
    """``dilate`` and ``erode`` steps, each with its element size."""
    stack = _small(stack)
    for kind, size in steps:
        stack = extremum(stack, size, np.fmax if kind == "dilate" else np.fmin)
    return stack


def _morph(px: DataFrame, plane: str, steps: list[tuple[str, int]]) -> DataFrame:
    return map_bands(px, [plane], lambda v: morphed(v, steps), [plane])


def dilate(px: DataFrame, plane: str, size: int = 3, times: int = 1) -> DataFrame:
    return _morph(px, plane, [("dilate", size)] * times)


def erode(px: DataFrame, plane: str, size: int = 3, times: int = 1) -> DataFrame:
    return _morph(px, plane, [("erode", size)] * times)


# Pixels of a mask in one word when its lines are packed; the sign bit and two more stay free.
WORD_PIXELS = 60


def pack_mask(px: DataFrame, plane: str) -> DataFrame:
    """A plane of 0 and 1 as words of ``WORD_PIXELS`` pixels, the first pixel in the lowest bit."""
    words = F.sequence(F.lit(0), F.ceil(F.size(plane) / WORD_PIXELS).cast("int") - 1)
    value = lambda j: F.aggregate(
        F.reverse(F.slice(plane, j * WORD_PIXELS + 1, F.lit(WORD_PIXELS))),
        F.lit(0).cast("long"),
        lambda word, v: word * 2 + v.cast("long"),
    )
    return px.withColumn(plane, F.transform(words, value))


def unpack_mask(px: DataFrame, plane: str) -> DataFrame:
    """Words back to one 0 or 1 per pixel."""
    bit = lambda x: F.call_function(
        "shiftright", F.get(F.col(plane), F.floor(x / WORD_PIXELS).cast("int")), x % WORD_PIXELS
    )
    pixels = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: bit(x).bitwiseAND(F.lit(1)).cast("int"))
    return px.withColumn(plane, pixels)


def mask_steps(px: DataFrame, plane: str, steps: list[tuple[str, int]]) -> DataFrame:
    """``dilate`` and ``erode`` steps, each with its element size, on a plane of 0 and 1."""
    return _morph(px, plane, steps)


def close_steps(size: int, times: int = 1, mode: str = "grouped") -> list[tuple[str, int]]:
    if mode == "repeated":
        return [("dilate", size), ("erode", size)] * times
    return [("dilate", size)] * times + [("erode", size)] * times


def open_steps(size: int, times: int = 1, mode: str = "grouped") -> list[tuple[str, int]]:
    if mode == "repeated":
        return [("erode", size), ("dilate", size)] * times
    return [("erode", size)] * times + [("dilate", size)] * times


def close(px: DataFrame, plane: str, size: int, times: int = 1, mode: str = "grouped") -> DataFrame:
    """Dilate then erode. ``grouped``: all dilations first; ``repeated``: the pair, ``times`` times."""
    return _morph(px, plane, close_steps(size, times, mode))


def open_(px: DataFrame, plane: str, size: int, times: int = 1, mode: str = "grouped") -> DataFrame:
    """Erode then dilate; modes as in ``close``."""
    return _morph(px, plane, open_steps(size, times, mode))


def _nine(stack: np.ndarray) -> list[np.ndarray]:
    """The 3x3 neighbours of every pixel, edges repeated."""
    _, n, w = stack.shape
    wide = padded(stack, 1, 1)
    return [wide[:, dy : dy + n, dx : dx + w] for dy in range(3) for dx in range(3)]


def median3(px: DataFrame, plane: str, name: str) -> DataFrame:
    """Median of the 3x3 neighbourhood, edges repeated."""

    def middle(stack: np.ndarray) -> np.ndarray:
        # NaN sorts to the end; NULL comes last in Spark too.
        return np.sort(np.stack(_nine(_small(stack))), axis=0)[4]

    return map_bands(px, [plane], middle, [name])


def median3_mask(px: DataFrame, plane: str, name: str) -> DataFrame:
    """Median of a 0/1 mask: set when at least five of the nine are."""
    return map_bands(px, [plane], lambda v: (sum(_nine(_small(v))) >= 5).astype(np.int32), [name])


def gaussian(px: DataFrame, plane: str, kernel: list[float], name: str, border: str = "reflect", whole: bool = True) -> DataFrame:
    """Separable blur; ``whole`` rounds the result to ints."""

    def blurred(stack: np.ndarray) -> np.ndarray:
        mean = grid.weighted(stack, kernel, border)
        return np.floor(mean + 0.5) if whole else mean

    return map_bands(px, [plane], blurred, [name], {} if whole else {name: "double"})


def adaptive_inverse(px: DataFrame, plane: str, name: str, size: int = 31, c: int = 9, mode: str = "docs") -> DataFrame:
    """1 where a pixel is at least ``c`` darker than its Gaussian-weighted surroundings."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8 if mode == "docs" else 5.0
    kernel = gaussian_kernel(size, sigma)

    def darker(stack: np.ndarray) -> np.ndarray:
        limit = np.floor(grid.weighted(stack, kernel) + 0.5) - c
        return (stack <= (limit if mode == "docs" else np.fmax(limit, 0))).astype(np.int32)

    return map_bands(px, [plane], darker, [name])


def box_sums(px: DataFrame, plane: str, k: int) -> DataFrame:
    """Exact sums of values (``box_sum``) and squares (``box_sum2``) over k x k, edges repeated."""
    kinds = {"box_sum": "long", "box_sum2": "long"}
    return map_bands(px, [plane], lambda v: dict(zip(kinds, _two_sums(v, k))), list(kinds), kinds)


def _two_sums(stack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values = stack if stack.dtype.kind == "f" else stack.astype(np.int64)
    return grid.box_total(values, k // 2), grid.box_total(values * values, k // 2)


def local_mean_std(stack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over k x k around every pixel."""
    n = float(k * k)
    total, squares = _two_sums(stack, k)
    mean = total / n
    return mean, np.sqrt(np.fmax(squares / n - mean * mean, 0.0))


def box_mean_std(px: DataFrame, plane: str, k: int) -> DataFrame:
    """Local ``mean`` and ``std`` over k x k."""
    kinds = {"mean": "double", "std": "double"}
    return map_bands(px, [plane], lambda v: dict(zip(kinds, local_mean_std(v, k))), list(kinds), kinds)


def sobel_magnitude(px: DataFrame, plane: str, name: str) -> DataFrame:
    """Gradient magnitude with a 3x3 kernel, mirrored borders (not yet normalised)."""

    def magnitude(stack: np.ndarray) -> np.ndarray:
        _, n, w = stack.shape
        if n == 1 or w == 1:  # nothing to mirror
            return np.full(stack.shape, np.nan)
        wide = padded(stack, 1, 1, "reflect")
        at = lambda dy, dx: wide[:, 1 + dy : 1 + dy + n, 1 + dx : 1 + dx + w]
        gx = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
        gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
        return np.sqrt((gx * gx + gy * gy).astype(np.float64))

    return map_bands(px, [plane], magnitude, [name], {name: "double"})


def min_max_normalise(px: DataFrame, plane: str, name: str) -> DataFrame:
    """Stretch a plane so its page minimum becomes 0 and its maximum 255 (truncated to ints).

    The ends of each scanline travel with the planes in one shuffle; other planes than ints and doubles
    meet their page's ends in a join.
    """
    if grid.whole(px):
        return map_bands(px, [plane], _stretched_between_ends, [name])
    kinds = {f.name: f.dataType.simpleString() for f in px.schema.fields if f.name not in grid.POSITION}
    if set(kinds.values()) <= {"array<int>", "array<double>"}:
        known, kind = F.col("page_id").isNotNull(), kinds[plane][6:-1]
        totals = {n: (F.when(known, end(plane)), how, kind) for n, end, how in (("_lo", F.array_min, "min"), ("_hi", F.array_max, "max"))}
        met = grid.settle(px, totals=totals, pages_only=False)
    else:
        ends = px.filter("core").groupBy("page_id", "h").agg(
            F.min(F.array_min(plane)).alias("_lo"), F.max(F.array_max(plane)).alias("_hi")
        )
        met = grid.attach(px, ends)

    def scaled(v, low, high):
        return np.where(high > low, np.floor((v - low) * (255.0 / (high - low))), 0)

    return grid.without(map_planes(met, [plane], scaled, [name], ["_lo", "_hi"]), "_lo", "_hi")


def _stretched_between_ends(stack: np.ndarray) -> np.ndarray:
    """``min_max_normalise`` of whole pages."""
    low, high = (end.reduce(stack, axis=(1, 2), keepdims=True) for end in (np.fmin, np.fmax))
    return np.where(high > low, np.floor((stack - low) * (255.0 / (high - low))), 0)


# --- illumination --------------------------------------------------------------------------------

# The closing element is a 24th of the shorter side (15 at least), the blur an 18th of
# it (12 at least). Both are taken on a grid of cells a quarter of the blur wide, where the blur is
# always the same and the element spans 5 cells on small pages and 3 on others.
SURFACE_KERNEL = gaussian_kernel(25, 4.0)
SMALLEST_CELL, CELLS_PER_SIDE = 3, 72
SMALL_SIDE = 270


def surface_cell(h: Column, w: Column) -> Column:
    """Width in pixels of the illumination cells of a page."""
    side = F.least(h, w)
    return F.greatest(F.lit(SMALLEST_CELL), F.floor(side / CELLS_PER_SIDE + 0.5).cast("int"))


def downscale(px: DataFrame, plane: str, k: int, name: str) -> DataFrame:
    """Mean of k x k blocks per page; edge blocks average what they have. Columns: page_id, h, w, y, x, name."""
    cells = grid.pixels(px, plane)
    return (
        cells.groupBy(
            "page_id",
            F.ceil(F.col("h") / k).cast("int").alias("h"),
            F.ceil(F.col("w") / k).cast("int").alias("w"),
            F.floor(F.col("y") / k).cast("int").alias("y"),
            F.floor(F.col("x") / k).cast("int").alias("x"),
        )
        .agg(F.avg(plane).alias(name))
    )


def _cell_sums(lines: pa.Array, k: pa.Array) -> pa.Array:
    """Sums of every ``k`` values along each line."""
    lengths = grid.lengths_of(lines)
    values, k = grid.numbers_of(lines.flatten()), k.to_numpy(zero_copy_only=False)
    cells = -(-lengths // k)
    within = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    starts = np.repeat(np.cumsum(lengths) - lengths, cells) + within * np.repeat(k, cells)
    kept = values if values.dtype.kind == "f" else values.astype(np.int64)
    return grid.listed(grid.typed(np.add.reduceat(kept, starts) if len(starts) else kept, "long"), cells, lines)


def _between(lines: pa.Array, cells: pa.Array, k: pa.Array) -> pa.Array:
    """The cells of each scanline interpolated between their centres, for each of its pixels."""
    lengths, sizes = grid.lengths_of(lines), grid.lengths_of(cells)
    lengths = np.where(sizes > 0, lengths, 0)
    s, first = grid.numbers_of(cells.flatten()), np.repeat(np.cumsum(sizes) - sizes, lengths)
    x = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = (x + 0.5) / np.repeat(grid.numbers_of(k), lengths) - 0.5
    left = np.floor(at).astype(np.int64)
    a, b = s[first + np.maximum(left, 0)], s[first + np.minimum(left + 1, np.repeat(sizes, lengths) - 1)]
    return grid.listed(grid.typed(np.floor(a + (b - a) * (at - left) + 0.5), "int"), lengths, cells)


def _cell_lines(px: DataFrame, plane: str) -> DataFrame:
    """Block means as scanlines of the cell grid, built line by line without exploding pixels.

    Columns: page_id, y, h, w (in cells), ``cell``, and per page ``_k`` (pixels per cell), ``_h`` (in
    pixels), ``_small``.
    """
    sized = px.filter("core").select(
        "page_id", "y", plane, F.col("h").alias("_h"), F.col("w").alias("_w"), surface_cell(F.col("h"), F.col("w")).alias("_k")
    )
    k = F.col("_k")
    line = F.arrow_udf(_cell_sums, "array<bigint>")(plane, "_k")
    sums = (
        sized.select("page_id", "_k", "_h", "_w", F.floor(F.col("y") / k).cast("int").alias("y"), line.alias("_line"))
        .groupBy("page_id", "_k", "_h", "_w", "y")
        .agg(F.collect_list("_line").alias("_lines"))
    )

    def mean(total: Column, c: Column) -> Column:
        rest = F.aggregate(F.slice("_lines", F.lit(2), k), F.lit(0).cast("long"), lambda s, line: s + F.get(line, c))
        width = F.least(k, F.col("_w") - c * k)
        return F.floor((total + rest) / (width * F.size("_lines")) + 0.5).cast("int")

    return sums.select(
        "page_id", "y",
        F.ceil(F.col("_h") / k).cast("int").alias("h"),
        F.ceil(F.col("_w") / k).cast("int").alias("w"),
        F.transform(F.element_at("_lines", 1), mean).alias("cell"),
        "_k",
        "_h",
        (F.least("_h", "_w") <= SMALL_SIDE).cast("int").alias("_small"),
    )


def illumination(px: DataFrame, plane: str, name: str, carry: list[str] | None = None) -> DataFrame:
    """Smooth brightness surface of the paper: close dark strokes, blur, spread back over the page.

    Element and blur follow the page's size. Computed on cells and interpolated between cell centres;
    an approximation of closing and blurring at full size. The cells' rows travel beside the scanlines,
    each into the bands that it touches, so the surface comes back without a join. ``carry`` as in
    ``grid.settle``. Pages of one band take their surface in a Python step.
    """
    ship(px.sparkSession)
    return grid.by_size(px, lambda own: _page_surface(own, plane, name) if grid.whole(own) else _band_surface(own, plane, name, carry))


def _page_surface(px: DataFrame, plane: str, name: str) -> DataFrame:
    return map_bands(px, [plane], lit_pages, [name], page=["y", "h"])


def lit_pages(stack: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The brightness surface of whole pages (page, row, x) of equal size, ``y`` and ``h`` by row."""
    out = np.empty(stack.shape)
    # Rows may be there more than once or not at all; pages with the same rows go together.
    _, same = np.unique(np.concatenate([y, h], axis=1), axis=0, return_inverse=True)
    for group in range(int(same.max(initial=-1)) + 1):
        own = np.flatnonzero(same.ravel() == group)
        out[own] = _lit_alike(stack[own], y[own[0]].astype(np.int64), int(h[own[0], 0]))
    return out


def _lit_alike(stack: np.ndarray, y: np.ndarray, h: int) -> np.ndarray:
    w = stack.shape[2]
    side = min(h, w)
    k = max(SMALLEST_CELL, int(np.floor(side / CELLS_PER_SIDE + 0.5)))
    lined = np.add.reduceat(stack if stack.dtype.kind == "f" else stack.astype(np.int64), np.arange(0, w, k), axis=2)
    at, first, row, lines = np.unique(y // k, return_index=True, return_inverse=True, return_counts=True)
    # The lines of a cell, of which no more than k + 1 are summed, as ``_cell_lines`` does.
    summed = np.stack([lined[:, a : a + min(n, k + 1)].sum(axis=1) for a, n in zip(first, lines)], axis=1)
    width = np.minimum(k, w - np.arange(lined.shape[2]) * k)
    cells = np.floor(summed / (width[None, None, :] * lines[None, :, None]) + 0.5)
    cells = cells if np.isnan(cells).any() else cells.astype(np.int64)
    closed = morphed(cells, close_steps(5 if side <= SMALL_SIDE else 3))
    smooth = grid.weighted(closed, SURFACE_KERNEL, "replicate")
    before = np.concatenate([smooth[:, :1], smooth[:, :-1]], axis=1)
    after = np.concatenate([smooth[:, 1:], smooth[:, -1:]], axis=1)
    row = row.ravel()
    away = ((y - at[row] * k + 0.5) / k - 0.5)[None, :, None]
    a, up, down = smooth[:, row], before[:, row], after[:, row]
    mixed = np.where(away < 0, a * (1 + away) - up * away, a * (1 - away) + down * away)
    across = (np.arange(w) + 0.5) / k - 0.5
    left = np.floor(across).astype(np.int64)
    low, high = mixed[:, :, np.maximum(left, 0)], mixed[:, :, np.minimum(left + 1, mixed.shape[2] - 1)]
    return np.floor(low + (high - low) * (across - left) + 0.5)


def _band_surface(px: DataFrame, plane: str, name: str, carry: list[str] | None = None) -> DataFrame:
    px = grid.settle(px, carry)
    cells = grid.to_bands(_cell_lines(px, plane))
    both = lambda v: {"cell": morphed(v, close_steps(3)), "_wide": morphed(v, close_steps(5))}
    closed = map_bands(cells, ["cell"], both, ["cell", "_wide"])
    closed = map_planes(closed, ["cell", "_wide"], lambda c, w, small: np.where(small > 0, w, c), ["cell"], ["_small"])
    smooth = gaussian(closed, "cell", SURFACE_KERNEL, "surface", border="replicate", whole=False)
    beside = lambda s: {"_prev": np.concatenate([s[:, :1], s[:, :-1]], axis=1), "_next": np.concatenate([s[:, 1:], s[:, -1:]], axis=1)}
    smooth = map_bands(smooth, ["surface"], beside, ["_prev", "_next"], {"_prev": "double", "_next": "double"})
    smooth = grid.without(smooth, "cell", "_wide")
    first, last = F.col("y") * F.col("_k"), (F.col("y") + 1) * F.col("_k") - 1
    touched = F.sequence(
        F.greatest(F.lit(0), F.floor((first - grid.MARGIN_ROWS) / grid.BAND_ROWS)).cast("int"),
        F.floor(F.least(F.col("_h") - 1, last + grid.MARGIN_ROWS) / grid.BAND_ROWS).cast("int"),
    )
    rows = (
        smooth.filter("core")
        .select(
            "page_id",
            F.explode(touched).alias("band"),
            first.alias("y"),
            F.struct(first.alias("at"), F.col("_k").alias("k"), "surface", "_prev", "_next").alias("value"),
        )
    )
    lit = grid.settle(px, carry, beside=rows)
    cell = F.col("_beside")
    # A scanline lies between the middle of its cells and that of the row above or below.
    away = (F.col("y") - cell["at"] + 0.5) / cell["k"] - 0.5
    mixed = F.when(
        away < 0, F.zip_with(cell["surface"], cell["_prev"], lambda a, b: a * (1 + away) - b * away)
    ).otherwise(F.zip_with(cell["surface"], cell["_next"], lambda a, b: a * (1 - away) + b * away))

    spread = F.arrow_udf(_between, "array<int>")(F.col(plane), mixed, cell["k"])
    return lit.withColumn(name, spread).drop("_beside")
