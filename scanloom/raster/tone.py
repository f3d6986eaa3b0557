"""Reducing a page to a few gray tones, fitted on its histogram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.llm.common import ship
from scanloom.raster import stats

# What counts as bright, and the allowed range of each level.
BRIGHT = 224
TOP_LEVEL = 244
EVERY = 1 << 40
STOP = 0.2
LEVEL_RANGES = {3: ((16, 52), (112, 188), (236, 255)), 4: ((16, 56), (72, 132), (136, 196), (236, 255))}


def _picked_before(rank: Column, size: Column, wanted: Column) -> Column:
    """How many of ``wanted`` evenly spaced picks out of ``size`` sorted values fall below ``rank``."""
    # Pick i is value number floor(i * (size-1) / (wanted-1)); count the i with that number < rank.
    spaced = F.floor((rank * (wanted - 1) + size - 2) / (size - 1))
    return F.when(wanted >= size, rank).when(wanted <= 1, F.when(rank > 0, wanted).otherwise(0)).otherwise(
        F.when(rank <= 0, F.lit(0)).otherwise(F.least(wanted, F.greatest(spaced, F.lit(1))))
    ).cast("long")


def _resample(hist: DataFrame, n: str, keys: list[str], wanted: Column, name: str) -> DataFrame:
    """Counts per value after picking ``wanted`` evenly spaced values from the sorted pixels."""
    by_value = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    marked = hist.withColumns({"_cum": F.sum(n).over(by_value), "_size": F.sum(n).over(whole)}).withColumn("_want", wanted)
    taken = _picked_before(F.col("_cum"), F.col("_size"), F.col("_want")) - _picked_before(
        F.col("_cum") - F.col(n), F.col("_size"), F.col("_want")
    )
    return marked.withColumn(name, taken).drop("_cum", "_size", "_want")


def quantization_sample(
    hist: DataFrame, bright_minimum: int | None = None, sample_limit: int | None = None
) -> DataFrame:
    """Histogram of the pixels to fit on: all of them, unless a limit is given.

    ``bright_minimum`` thins bright values to twice the dark ones, but to no fewer than that;
    ``sample_limit`` thins the whole. A sample of the sorted pixels is derived from cumulative counts;
    no pixel is sorted or moved.
    """
    if bright_minimum is None and sample_limit is None:
        return hist.select(*stats.PAGE, "v", F.col("n").cast("long").alias("n"))
    bright_minimum = EVERY if bright_minimum is None else bright_minimum
    sample_limit = EVERY if sample_limit is None else sample_limit
    bright = F.col("v") >= BRIGHT
    page = W.partitionBy(*stats.PAGE)
    split = hist.withColumns({"_bright": bright, "_dark": F.sum(F.when(~bright, F.col("n")).otherwise(0)).over(page)})
    limit = F.when(
        F.col("_bright") & (F.col("_dark") > 0),
        F.least(F.col("_size"), F.greatest(F.col("_dark") * 2, F.lit(bright_minimum))),
    ).otherwise(F.col("_size"))
    thinned = _resample(split, "n", [*stats.PAGE, "_bright"], limit, "_m").filter("_m > 0")
    capped = _resample(thinned, "_m", stats.PAGE, F.least(F.col("_size"), F.lit(sample_limit)), "sampled")
    return capped.filter("sampled > 0").select(*stats.PAGE, "v", F.col("sampled").alias("n"))


def weighted_bins(hist: DataFrame, bright_minimum: int | None = None) -> DataFrame:
    """Histogram with fractional weights: with ``bright_minimum``, bright bins are scaled down together
    to twice the dark ones, but to no less than that; without it every pixel weighs the same."""
    if bright_minimum is None:
        return hist.withColumn("weight", F.col("n").cast("double"))
    bright = F.col("v") >= BRIGHT
    page = W.partitionBy(*stats.PAGE)
    sums = hist.withColumns(
        {
            "_b": F.sum(F.when(bright, F.col("n")).otherwise(0)).over(page),
            "_d": F.sum(F.when(~bright, F.col("n")).otherwise(0)).over(page),
        }
    )
    limit = F.least(F.col("_b"), F.greatest(F.col("_d") * 2, F.lit(bright_minimum)))
    scale = F.when(bright & (F.col("_b") > limit), limit / F.col("_b")).otherwise(F.lit(1.0))
    return sums.withColumn("weight", F.col("n") * scale).drop("_b", "_d")


def _clusters(bins: Column, k: int, rounds: int) -> Column:
    """k-means over (v, weight) bins: quantile start, a bounded number of rounds, early stop.

    Returns ``struct<centers, done>``; ``done`` says that the fit came to rest. ``bins`` has at most 256 entries, so one page's fit is one small expression.
    """
    total = F.aggregate(bins, F.lit(0.0), lambda s, b: s + b["weight"])

    def start(i: int) -> Column:
        target = total * ((i + 1) / (k + 1))
        reached = F.aggregate(
            bins,
            F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("at")),
            lambda s, b: F.struct(
                (s["cum"] + b["weight"]).alias("cum"),
                F.coalesce(s["at"], F.when(s["cum"] + b["weight"] >= target, b["v"].cast("double"))).alias("at"),
            ),
        )
        return F.coalesce(reached["at"], F.lit(255.0))

    def nearest(v: Column, centers: Column) -> Column:
        gaps = F.transform(centers, lambda c, i: F.struct(F.abs(v - c).alias("gap"), i.alias("i")))
        return F.array_min(gaps)["i"]

    def move(centers: Column) -> Column:
        sums = F.aggregate(
            bins,
            F.array_repeat(F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), k),
            lambda acc, b: F.transform(
                F.transform(F.array(b), lambda one: F.struct(one.alias("b"), nearest(one["v"], centers).alias("at"))),
                lambda hit: F.transform(
                    acc,
                    lambda a, i: F.when(
                        i == hit["at"],
                        F.struct((a["s"] + hit["b"]["v"] * hit["b"]["weight"]).alias("s"), (a["n"] + hit["b"]["weight"]).alias("n")),
                    ).otherwise(a),
                ),
            )[0],
        )
        return F.zip_with(centers, sums, lambda c, a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(c))

    def step(state: Column, _: Column) -> Column:
        moved = F.transform(
            F.array(state),
            lambda s: F.when(s["done"], s["centers"]).otherwise(move(s["centers"])),
        )[0]
        return F.transform(
            F.array(F.struct(state.alias("old"), moved.alias("new"))),
            lambda p: F.struct(
                p["new"].alias("centers"),
                (p["old"]["done"] | (F.array_max(F.zip_with(p["old"]["centers"], p["new"], lambda a, b: F.abs(a - b))) < STOP)).alias("done"),
            ),
        )[0]

    first = F.struct(F.array(*[start(i) for i in range(k)]).alias("centers"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)


def _levels(centers: Column, k: int) -> Column:
    """Round, sort, clamp each level to its range, and keep levels apart."""
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in LEVEL_RANGES[k]])
    whole = F.array_sort(F.transform(centers, lambda c: F.floor(c + 0.5).cast("int")))
    clamped = F.zip_with(whole, ranges, lambda v, r: F.greatest(r["lo"], F.least(r["hi"], v)))
    return F.aggregate(
        clamped,
        F.array().cast("array<int>"),
        lambda done, v: F.concat(
            done,
            F.array(
                F.when(
                    (F.size(done) > 0) & (v <= F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(-1))),
                    F.least(F.lit(TOP_LEVEL), F.try_element_at(done, F.lit(-1)) + 8),
                ).otherwise(v)
            ),
        ),
    )


def page_bins(hist: DataFrame, weight: str = "n") -> DataFrame:
    """One row per page: ``bins``, its values in order with their weight and the weight and weighted sum
    up to them, behind an empty one. At most 257 entries."""
    ship(hist.sparkSession)
    n = F.col(weight).cast("double")
    upto = W.partitionBy(*stats.PAGE).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    summed = hist.select(*stats.PAGE, "v", n.alias("weight"), F.sum(n).over(upto).alias("cw"), F.sum(n * F.col("v")).over(upto).alias("cs"))
    nothing = F.lit(0.0)
    empty = F.struct(F.lit(-1).alias("v"), nothing.alias("weight"), nothing.alias("cw"), nothing.alias("cs"))
    listed = F.collect_list(F.struct(F.col("v").cast("int").alias("v"), "weight", "cw", "cs"))
    return summed.groupBy(*stats.PAGE).agg(F.array_sort(F.concat(F.array(empty), listed)).alias("bins"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_split(v: np.ndarray, cw: np.ndarray, cs: np.ndarray, k: int) -> list[float]:
    """The means of the best split of a page's values into ``k`` (3 or 4) runs, by dynamic programming.

    The best split has the least squared distance to the means, that is, the largest sum over runs of
    squared sum by weight; of equals, the one cut first. ``before[j]`` is the best split in two of the
    first j values and ``behind[j]`` that of the others, so the last step tries every j once. With
    fewer values than runs, runs without values take the value at their cut. ``cw`` and ``cs`` are the
    weight and weighted sum up to each value, behind an empty one.
    """
    last = len(v) - 1
    apart, weight = cs[None, :] - cs[:, None], cw[None, :] - cw[:, None]
    later = np.arange(last + 1)[None, :] > np.arange(last + 1)[:, None]
    gain = np.where(later, apart * apart / np.where(later, weight, 1.0), 0.0)
    allowed = later | np.eye(last + 1, dtype=bool)
    # Cut i before j for two runs of the first j values; cut i after j for two runs of the others.
    first = np.where(allowed, gain[0][:, None] + gain, -np.inf)
    before = first.argmax(axis=0)
    found = first[before, np.arange(last + 1)]
    if k == 3:
        j = int((found + gain[:, last]).argmax())
        bounds = [0, int(before[j]), j, last]
    else:
        second = np.where(allowed, gain + gain[:, last][None, :], -np.inf)
        behind = second.argmax(axis=1)
        j = int((found + second[np.arange(last + 1), behind]).argmax())
        bounds = [0, int(before[j]), j, int(behind[j]), last]
    return [
        float((cs[b] - cs[a]) / (cw[b] - cw[a]) if cw[b] > cw[a] else v[min(max(b, 1), last)])
        for a, b in zip(bounds, bounds[1:])
    ]


def exact_centers(bins: Column, k: int) -> Column:
    """``best_split`` of each page's bins."""

    def centers(pages: pa.Array) -> pa.Array:
        flat = pages.flatten()
        v, cw, cs = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("v", "cw", "cs"))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False))
        with np.errstate(all="ignore"):
            found = [best_split(v[a:b], cw[a:b], cs[a:b], k) if b - a > 1 else None for a, b in zip([0, *ends], ends)]
        return pa.array(found, pa.list_(pa.float64()))

    return F.arrow_udf(centers, "array<double>")(bins)


def _otsu(bins: Column) -> Column:
    """``stats.otsu`` on one page's bins."""
    def variance(b: Column, whole: Column) -> Column:
        rest = whole["cw"] - b["cw"]
        apart = b["cs"] / b["cw"] - (whole["cs"] - b["cs"]) / rest
        return F.when((b["cw"] > 0) & (rest > 0), F.struct((b["cw"] * rest * apart * apart).alias("var"), (-b["v"]).alias("v")))

    most = _bind(F.element_at(bins, -1), lambda whole: F.array_max(F.transform(bins, lambda b: variance(b, whole))))
    return F.coalesce(-most["v"], F.lit(127))


def tone_count_of(bins: Column) -> Column:
    """``stats.tone_count`` on one page's bins."""
    total = F.element_at(bins, -1)["cw"]
    above = lambda rank: F.get(F.filter(bins, lambda b: b["cw"] > rank), F.lit(0))["v"]

    def linear(p: float) -> Column:
        at = (total - 1) * F.lit(p)
        low, high = above(F.floor(at)), above(F.ceil(at))
        return (low + (high - low) * (at - F.floor(at))).cast("double")

    mid = F.aggregate(bins, F.lit(0.0), lambda s, b: s + F.when((b["v"] >= 96) & (b["v"] < 220), b["weight"]).otherwise(0.0)) / total
    q10, tail = linear(0.10), linear(0.50) - linear(0.10)
    return F.when((q10 >= 232) & (tail < 12), 2).when((q10 >= 185) & (tail < 60) & (mid < 0.12), 3).otherwise(4)


def _levels_of(bins: Column, tones: Column, fit) -> Column:
    """Levels of a page; ``fit(k)`` gives the centers of k tones."""
    dark = F.greatest(F.lit(16), F.least(F.lit(48), F.floor(_otsu(bins) * 0.30 + 0.5))).cast("int")
    return F.when(tones == 2, F.array(dark, F.lit(TOP_LEVEL))).when(tones == 3, _levels(fit(3), 3)).otherwise(_levels(fit(4), 4))


def fitted_tones(hist: DataFrame) -> DataFrame:
    """(page_id, h, tones, levels) with every page's own number of tones, from one pass over its histogram."""
    bins = F.col("bins")
    counted = page_bins(hist).withColumn("tones", tone_count_of(bins))
    return counted.select(*stats.PAGE, "tones", _levels_of(bins, F.col("tones"), lambda k: exact_centers(bins, k)).alias("levels"))


def tone_levels(
    hist: DataFrame, tones: DataFrame, rounds: int | None = None, bright_minimum: int | None = None
) -> DataFrame:
    """Gray levels per page: (page_id, h, tones, levels, converged).

    Two tones: a dark level from the Otsu threshold, and the top level. Three or four: k-means on
    the weighted histogram, the best there is, or with ``rounds`` what so many rounds from a quantile
    start reach.
    """
    bins = F.col("bins")
    joined = tones.select(*stats.PAGE, "tones").join(page_bins(weighted_bins(hist, bright_minimum), "weight"), stats.PAGE)
    if rounds is None:
        levels = _levels_of(bins, F.col("tones"), lambda k: exact_centers(bins, k))
        return joined.select(*stats.PAGE, "tones", levels.alias("levels"), F.lit(True).alias("converged"))
    own = F.slice(bins, F.lit(2), F.size(bins))
    fit = F.when(F.col("tones") == 3, _clusters(own, 3, rounds)).when(F.col("tones") > 3, _clusters(own, 4, rounds))
    fitted = joined.withColumn("_fit", fit)
    levels = _levels_of(bins, F.col("tones"), lambda k: F.col("_fit.centers"))
    converged = F.coalesce(F.col("_fit.done"), F.lit(True))
    return fitted.select(*stats.PAGE, "tones", levels.alias("levels"), converged.alias("converged"))


def cuts(levels: Column, mode: str = "round") -> Column:
    """Values at which a pixel moves to the next level: halfway, rounded half to even or truncated."""
    def halfway(low: Column, i: Column) -> Column:
        middle = (low + F.get(levels, i + 1)) / 2
        return (F.rint(middle) if mode == "round" else F.floor(middle)).cast("int")

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), halfway)


def quantize(v: np.ndarray, levels: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Level whose range holds ``v``, given the page's ``cuts``. Levels and cuts have a row per pixel, NaN
    beyond their end."""
    over = (v[:, None] >= at).sum(axis=1)
    return np.take_along_axis(levels, over[:, None], axis=1)[:, 0]


def paper_floor(v: np.ndarray, mask: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Paper is at least the second level from the top, or the top level when there are two."""
    size = (~np.isnan(levels)).sum(axis=1)
    last = lambda i: np.take_along_axis(levels, np.maximum(size - i, 0)[:, None], axis=1)[:, 0]
    return np.where(mask == 0, v, np.where(size >= 3, np.fmax(v, last(2)), last(1)))


# --- pages of one band -----------------------------------------------------------------------------


def levels_of_values(values: np.ndarray) -> list[int]:
    """The levels that ``fitted_tones`` gives a page with these pixels."""
    if values.dtype.kind == "f":
        values = values[~np.isnan(values)].astype(np.int64)
    if not len(values):
        return []
    v, n = np.unique(values, return_counts=True)
    n = n.astype(np.float64)
    # Behind an empty bin, as in ``page_bins``.
    v, n = np.concatenate([[-1], v]).astype(np.int64), np.concatenate([[0.0], n])
    cw, cs = np.cumsum(n), np.cumsum(n * v)
    with np.errstate(all="ignore"):
        tones = _tones_of(v, n, cw)
        if tones == 2:
            return [int(max(16, min(48, np.floor(_threshold_of(v, cw, cs) * 0.30 + 0.5)))), TOP_LEVEL]
        centers = best_split(v, cw, cs, tones)
    out: list[int] = []
    for center, (low, high) in zip(sorted(int(np.floor(c + 0.5)) for c in centers), LEVEL_RANGES[tones]):
        level = max(low, min(high, center))
        out.append(min(TOP_LEVEL, out[-1] + 8) if out and level <= out[-1] else level)
    return out


def _tones_of(v: np.ndarray, n: np.ndarray, cw: np.ndarray) -> int:
    """``tone_count_of``."""
    total = cw[-1]

    def linear(p: float) -> float:
        at = (total - 1) * p
        low, high = (float(v[np.searchsorted(cw, rank, "right")]) for rank in (np.floor(at), np.ceil(at)))
        return low + (high - low) * (at - np.floor(at))

    q10 = linear(0.10)
    tail, mid = linear(0.50) - q10, n[(v >= 96) & (v < 220)].sum() / total
    return 2 if q10 >= 232 and tail < 12 else 3 if q10 >= 185 and tail < 60 and mid < 0.12 else 4


def _threshold_of(v: np.ndarray, cw: np.ndarray, cs: np.ndarray) -> int:
    """``stats.otsu``."""
    rest = cw[-1] - cw
    apart = cs / cw - (cs[-1] - cs) / rest
    variance = np.where((cw > 0) & (rest > 0), cw * rest * apart * apart, -1.0)
    return int(v[variance.argmax()]) if variance.max() >= 0 else 127


def to_page_levels(stack: np.ndarray, paper: np.ndarray) -> np.ndarray:
    """``quantize`` and ``paper_floor`` of whole pages (page, row, x), each with its own levels."""
    levels = np.full((len(stack), 4), np.nan)
    for i, own in enumerate(map(levels_of_values, stack.reshape(len(stack), -1))):
        levels[i, : len(own)] = own
    halfway = np.rint((levels[:, :-1] + levels[:, 1:]) / 2)
    over = sum((stack >= halfway[:, i, None, None]).astype(np.int64) for i in range(3))
    picked = np.take_along_axis(levels, over.reshape(len(stack), -1), axis=1).reshape(stack.shape)
    size = (~np.isnan(levels)).sum(axis=1)
    last = lambda i: np.take_along_axis(levels, np.maximum(size - i, 0)[:, None], axis=1)[:, :, None]
    return np.where(paper == 0, picked, np.where(size[:, None, None] >= 3, np.fmax(picked, last(2)), last(1)))
