"""Ranking of candidate outlines per image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from scanloom.functions import geometry as g

# The least share of the image that a candidate must cover. How many candidates are
# looked at is for the caller to say.
MIN_AREA = 0.05
DOCS_MIN_AREA = 0.15


def with_area(quads: DataFrame) -> DataFrame:
    return quads.withColumn("area", g.quad_area(F.col("corners")))


def _largest(df: DataFrame, n) -> DataFrame:
    # rank-and-filter: Spark keeps only the best rows per image before the shuffle.
    by_area = W.partitionBy("image_id").orderBy(F.col("area").desc(), F.col("cand_id"))
    return df.withColumn("area_rank", F.row_number().over(by_area)).filter(F.col("area_rank") <= n)


def top_candidates_by_area(quads: DataFrame, n: int, min_ratio: float = MIN_AREA, limit_col: str | None = None) -> DataFrame:
    """Area floor first, then the largest ``n`` per image, or fewer where ``limit_col`` of the row says so."""
    big = quads.filter(F.col("area") >= F.col("img_w") * F.col("img_h") * min_ratio)
    largest = _largest(big, n)
    return largest if limit_col is None else largest.filter(F.col("area_rank") <= F.col(limit_col))


def top_candidates_docs(quads: DataFrame, n: int, min_ratio: float = DOCS_MIN_AREA) -> DataFrame:
    """The largest ``n`` first, then the area floor."""
    return _largest(quads, n).filter(F.col("area") >= F.col("img_w") * F.col("img_h") * min_ratio)


def scored(quads: DataFrame) -> DataFrame:
    """Convex candidates with ordered corners and their page-likeness.

    Corners, sides and angles are separate columns, each computed once.
    """
    image_area = (F.col("img_w") * F.col("img_h")).cast("double")
    return (
        quads.filter(g.is_convex(F.col("corners")))
        .withColumn("ordered", g.order_corners(F.col("corners")))
        .withColumns({"_sides": g.side_lengths(F.col("ordered")), "_angles": g.corner_angles(F.col("ordered"))})
        .withColumn("score", g.shape_score(F.col("_angles"), F.col("_sides"), F.col("area") / image_area))
        .drop("_sides", "_angles")
    )


def best_candidate(quads: DataFrame, score: str = "score", ordinal: str = "cand_id") -> DataFrame:
    """Highest positive score per image; among equals the earliest candidate."""
    best = quads.filter(F.col(score) > 0).groupBy("image_id").agg(
        F.max_by(F.struct(*quads.columns), F.struct(F.col(score), -F.col(ordinal))).alias("_best")
    )
    return best.select("_best.*")
