"""Page-level statistics. Everything works on histograms of at most 256 rows per page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.llm.common import ship
from scanloom.raster.grid import lengths_of, line_total, only, pixels

PAGE = ["page_id", "h"]


def _counted(px: DataFrame, planes: list[str]) -> DataFrame:
    """How often the planes have each value, or pair of values, on a page: counted among the scanlines of
    a batch in Python, and those counts added up."""
    ship(px.sparkSession)
    lines = only(px, [*PAGE, "core", *planes]).filter("core").select(*PAGE, *planes)
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    columns = ["v"] if len(planes) == 1 else planes
    values = ",".join(f"`{c}` {kinds[p].elementType.simpleString()}" for c, p in zip(columns, planes))
    keys = ",".join(f"`{c}` {kinds[c].simpleString()}" for c in PAGE)

    def run(batches):
        for batch in batches:
            own = pa.array(np.repeat(np.arange(len(batch)), lengths_of(batch.column(planes[0]))))
            keyed = {f"_{c}": pc.take(batch.column(c), own) for c in PAGE}
            flat = pa.table(keyed | {c: batch.column(p).flatten() for c, p in zip(columns, planes)})
            found = flat.group_by([*keyed, *columns], use_threads=False).aggregate([([], "count_all")])
            for part in found.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in [*keyed, *columns, "count_all"]], names=[*PAGE, *columns, "n"]
                )

    # Dealt by page once: the sums and what is read off a page's values need no further shuffle.
    counts = lines.mapInArrow(run, f"{keys},{values},n bigint").repartition(*PAGE)
    return counts.groupBy(*PAGE, *columns).agg(F.sum("n").alias("n"))


def histogram(px: DataFrame, plane: str) -> DataFrame:
    """(page_id, h, v, n): counts are combined on the map side before the shuffle."""
    return _counted(px, [plane])


def pair_histogram(px: DataFrame, first: str, second: str) -> DataFrame:
    """(page_id, h, first, second, n): how often two planes have each pair of values."""
    return _counted(px, [first, second])


def with_cumulative(hist: DataFrame) -> DataFrame:
    by_value = W.partitionBy(*PAGE).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return hist.withColumns({"cum": F.sum("n").over(by_value), "total": F.sum("n").over(W.partitionBy(*PAGE))})


def _at_rank(rank: Column) -> Column:
    """Value at a 0-based rank of the sorted pixels."""
    return F.min(F.when(F.col("cum") > rank, F.col("v")))


def nearest(p: float) -> Column:
    """Nearest-rank percentile, to be aggregated over ``with_cumulative``."""
    target = F.greatest(F.lit(0), F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))))
    return F.coalesce(_at_rank(target), F.lit(255))


def linear(p: float) -> Column:
    """Linearly interpolated percentile, to be aggregated over ``with_cumulative``."""
    at = (F.col("total") - 1) * F.lit(p)
    low, high = _at_rank(F.floor(at)), _at_rank(F.ceil(at))
    part = F.max(at - F.floor(at))
    return (low + (high - low) * part).cast("double")


def percentile_nearest(hist: DataFrame, p: float, name: str = "value") -> DataFrame:
    return with_cumulative(hist).groupBy(*PAGE).agg(nearest(p).alias(name))


def percentile_linear(hist: DataFrame, p: float, name: str = "value") -> DataFrame:
    return with_cumulative(hist).groupBy(*PAGE).agg(linear(p).alias(name))


def percentiles(hist: DataFrame, **wanted: Column) -> DataFrame:
    """Several percentiles in one pass: ``percentiles(h, p10=linear(0.1), lo=nearest(0.005))``."""
    return with_cumulative(hist).groupBy(*PAGE).agg(*[c.alias(n) for n, c in wanted.items()])


def otsu(hist: DataFrame, weight: str = "n") -> DataFrame:
    """Threshold with the largest between-class variance; the first such value wins, 127 if none."""
    by_value = W.partitionBy(*PAGE).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*PAGE)
    n, v = F.col(weight).cast("double"), F.col("v")
    sums = hist.withColumns(
        {
            "_w": F.sum(n).over(by_value), "_s": F.sum(n * v).over(by_value),
            "_all_w": F.sum(n).over(whole), "_all_s": F.sum(n * v).over(whole),
        }
    )
    rest = F.col("_all_w") - F.col("_w")
    apart = F.col("_s") / F.col("_w") - (F.col("_all_s") - F.col("_s")) / rest
    variance = F.when((F.col("_w") > 0) & (rest > 0), F.col("_w") * rest * apart * apart)
    return (
        sums.withColumn("_var", variance)
        .groupBy(*PAGE)
        .agg(F.coalesce(F.max_by("v", F.when(F.col("_var").isNotNull(), F.struct("_var", -v))), F.lit(127)).alias("threshold"))
    )


def tone_count(hist: DataFrame, percentile: str = "linear") -> DataFrame:
    """2, 3 or 4 gray tones from the 10 % and 50 % percentiles and the share of mid tones."""
    pick = linear if percentile == "linear" else nearest
    mid = F.sum(F.when((F.col("v") >= 96) & (F.col("v") < 220), F.col("n")).otherwise(0)) / F.sum("n")
    q = percentiles(hist, q10=pick(0.10), q50=pick(0.50), mid_ratio=mid)
    tail = F.col("q50") - F.col("q10")
    tones = (
        F.when((F.col("q10") >= 232) & (tail < 12), 2)
        .when((F.col("q10") >= 185) & (tail < 60) & (F.col("mid_ratio") < 0.12), 3)
        .otherwise(4)
    )
    return q.withColumn("tones", tones)


def plane_mean(px: DataFrame, plane: str, name: str) -> DataFrame:
    """Mean of a plane per page, from per-row sums."""
    total = line_total(px, [plane], lambda v: v)
    return (
        px.filter("core")
        .select(*PAGE, total.alias("_total"), F.size(plane).alias("_size"))
        .groupBy(*PAGE)
        .agg((F.sum("_total") / F.sum("_size")).alias(name))
    )


def mean_parts(px: DataFrame, plane: str) -> dict[str, tuple[Column, str]]:
    """What a scanline adds to the mean of a plane over its page: the sum and the number of its pixels."""
    return {"_total": (line_total(px, [plane], lambda v: v), "sum"), "_size": (F.size(plane), "sum")}


def masked_parts(px: DataFrame, planes: list[str], mask: str) -> dict[str, tuple[Column, str]]:
    """What a scanline adds to the masked means of its page: pixels, and each plane's sum."""
    sums = {f"_sum_{p}": (line_total(px, [p, mask], lambda v, m: v * m), "sum") for p in planes}
    return {"_masked": (line_total(px, [mask], lambda m: m), "sum")} | sums


def masked_means(planes: list[str], default: float = 128.0) -> dict[str, Column]:
    """Means from the page's ``masked_parts``; ``default`` where the mask is set nowhere."""
    return {
        f"mean_{p}": F.when(F.col("_masked") > 0, F.col(f"_sum_{p}") / F.col("_masked")).otherwise(F.lit(default))
        for p in planes
    }


def masked_mean(px: DataFrame, planes: list[str], mask: str, default: float = 128.0) -> DataFrame:
    """Mean of each plane where the mask is set; ``default`` where it is set nowhere."""
    sums = _page_totals(px, masked_parts(px, planes, mask))
    return sums.select(*PAGE, F.col("_masked").alias("masked"), *[c.alias(n) for n, c in masked_means(planes, default).items()])


def _page_totals(px: DataFrame, parts: dict[str, tuple[Column, str]]) -> DataFrame:
    counted = px.filter("core").select(*PAGE, *[v.alias(n) for n, (v, _) in parts.items()])
    return counted.groupBy(*PAGE).agg(*[getattr(F, how)(n).alias(n) for n, (_, how) in parts.items()])


def richness_parts(px: DataFrame, sat: str, visible: str, paper: str | None = None) -> dict[str, tuple[Column, str]]:
    """What a scanline adds to its page's colour richness: visible pixels and those of clear colour;
    with a ``paper`` mask, also the strongest visible colour on it (``top_sat``, -1 if none)."""
    vivid = line_total(px, [sat, visible], lambda s, v: (s > 18) & (v > 0))
    parts = {"_seen_n": (line_total(px, [visible], lambda v: v), "sum"), "_vivid_n": (vivid, "sum")}
    if paper:
        on_paper = lambda s, v, p: np.where((v > 0) & (p > 0), s, -1)
        parts["top_sat"] = (line_total(px, [sat, visible, paper], on_paper, "max"), "max")
    return parts


def richness() -> Column:
    """Share of visible pixels with clear colour, rescaled to 0..1, from the page's ``richness_parts``."""
    density = F.col("_vivid_n") / F.col("_seen_n")
    return F.when(F.col("_seen_n") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (density - 0.025) / 0.14))
    )


def color_richness(px: DataFrame, sat: str, visible: str, paper: str | None = None) -> DataFrame:
    """``richness`` per page and, with a ``paper`` mask, ``top_sat``."""
    sums = _page_totals(px, richness_parts(px, sat, visible, paper))
    return sums.select(*PAGE, richness().alias("richness"), *(["top_sat"] if paper else []))


def line_bright_ratio(px: DataFrame, plane: str, axis: str, threshold: int = 18) -> DataFrame:
    """Share of bright pixels per row (``axis='y'``) or per column (``axis='x'``)."""
    if axis == "y":
        bright = F.aggregate(plane, F.lit(0).cast("long"), lambda s, v: s + (v > threshold).cast("int"))
        return px.filter("core").select(*PAGE, "w", F.col("y").alias("at"), (bright / F.size(plane)).alias("ratio"))
    return (
        pixels(px, plane)
        .groupBy(*PAGE, "w", F.col("x").alias("at"))
        .agg((F.count_if(F.col(plane) > threshold) / F.count(F.lit(1))).alias("ratio"))
    )


def trim_bounds(px: DataFrame, plane: str, ratio: float = 0.65, keep: float = 0.5) -> DataFrame:
    """First and last bright row and column; the whole page when less than half would be kept."""

    def ends(axis: str, a: str, b: str) -> DataFrame:
        extent = F.col("h" if axis == "y" else "w")
        good = F.when(F.col("ratio") > ratio, F.col("at"))
        return (
            line_bright_ratio(px, plane, axis)
            .groupBy(*PAGE, "w")
            .agg(F.coalesce(F.min(good), F.lit(0)).alias(a), F.max(good + 1).alias(b))
            .withColumn(b, F.coalesce(F.col(b), extent))
        )

    # The size check would take ends, made from a few bytes a page, for small tables.
    both = ends("y", "top", "bottom").hint("merge").join(ends("x", "left", "right").drop("w", "h").hint("merge"), "page_id")
    small = (F.col("bottom") - F.col("top") < F.col("h") * keep) | (F.col("right") - F.col("left") < F.col("w") * keep)
    return both.select(
        "page_id",
        F.when(small, 0).otherwise(F.col("top")).alias("top"),
        F.when(small, F.col("h")).otherwise(F.col("bottom")).alias("bottom"),
        F.when(small, 0).otherwise(F.col("left")).alias("left"),
        F.when(small, F.col("w")).otherwise(F.col("right")).alias("right"),
    )


def center_border_mean(px: DataFrame, plane: str) -> DataFrame:
    """Mean brightness of the centre box and of the border bands (corners weigh twice)."""
    p = pixels(px, plane)
    h, w, x, y, v = F.col("h"), F.col("w"), F.col("x"), F.col("y"), F.col(plane)
    inside = (
        (y >= F.floor(h / 6)) & (y < F.floor(h * 5 / 6)) & (x >= F.floor(w / 6)) & (x < F.floor(w * 5 / 6))
    )
    bh, bw = F.greatest(F.lit(1), F.floor(h / 20)), F.greatest(F.lit(1), F.floor(w / 20))
    weight = sum(
        (c.cast("int") for c in (y < bh, y >= h - bh, x < bw, x >= w - bw)), F.lit(0)
    )
    return p.groupBy("page_id").agg(
        F.avg(F.when(inside, v)).alias("center_mean"),
        (F.sum(v * weight) / F.sum(weight)).alias("border_mean"),
    )


# --- pages of one band -----------------------------------------------------------------------------
# The same statistics on arrays (page, row, x) of whole pages, see ``grid.by_size``. Each gives an array
# (page, 1, 1). As in a histogram, missing pixels count as the smallest ones but are never the answer.


def ranked(stack: np.ndarray) -> np.ndarray:
    """Each page's values in order, missing ones first."""
    flat = stack.reshape(len(stack), -1)
    if flat.dtype.kind != "f":
        return np.sort(flat, axis=1)
    return np.sort(np.where(np.isnan(flat), -np.inf, flat), axis=1)


def _ranked_at(values: np.ndarray, rank: int) -> np.ndarray:
    found = values[:, rank].astype(np.float64)
    if np.isinf(found).any():
        known = np.where(np.isinf(values), np.inf, values).min(axis=1)
        found = np.where(np.isinf(found), np.where(np.isinf(known), np.nan, known), found)
    return found[:, None, None]


def nearest_of(values: np.ndarray, p: float) -> np.ndarray:
    """``nearest`` of ``ranked`` values."""
    total = values.shape[1]
    found = _ranked_at(values, max(0, min(total - 1, int(np.floor(total * p)))))
    return np.where(np.isnan(found), 255.0, found)


def linear_of(values: np.ndarray, p: float) -> np.ndarray:
    """``linear`` of ``ranked`` values."""
    at = (values.shape[1] - 1) * p
    low, high = _ranked_at(values, int(np.floor(at))), _ranked_at(values, int(np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def total_of(stack: np.ndarray) -> np.ndarray:
    """Sum over each page, without missing pixels."""
    return np.nansum(stack, axis=(1, 2), dtype=np.float64 if stack.dtype.kind == "f" else np.int64, keepdims=True)


def mean_of(stack: np.ndarray) -> np.ndarray:
    return total_of(stack) / (stack.shape[1] * stack.shape[2])


def masked_mean_of(stack: np.ndarray, mask: np.ndarray, default: float = 128.0) -> np.ndarray:
    """``masked_mean`` of one plane."""
    masked = total_of(mask)
    return np.where(masked > 0, total_of(stack * mask) / np.where(masked > 0, masked, 1), default)


def richness_of(sat: np.ndarray, visible: np.ndarray) -> np.ndarray:
    """``richness``."""
    seen, vivid = total_of(visible), total_of((sat > 18) & (visible > 0))
    density = vivid / np.where(seen > 0, seen, 1)
    return np.where(seen == 0, 0.0, np.fmin(1.0, np.fmax(0.0, (density - 0.025) / 0.14)))


def top_saturation_of(sat: np.ndarray, visible: np.ndarray, paper: np.ndarray) -> np.ndarray:
    """``top_sat`` of ``color_richness``."""
    return np.fmax.reduce(np.where((visible > 0) & (paper > 0), sat, -1), axis=(1, 2), keepdims=True)
