"""Building blocks that keep one very large group from landing in one task.

A window over ``partitionBy(document_id)`` sends a whole document to a single task. The helpers
here split a group into ordered buckets, work inside each bucket, and carry a small per-bucket
summary forward, so the largest unit of work is a bucket and not the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Distinct leading order values per bucket, and rows per chunk. Both bound one task's unit of work.
BUCKET_SPAN = 4096
CHUNK_ROWS = 4096


def span_bucket(value: Column, span: int = BUCKET_SPAN) -> Column:
    """Order-preserving bucket of a numeric order value."""
    return F.floor(value / F.lit(span)).cast("long")


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    value: Column,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``.

    ``bucket`` must not decrease along ``order`` inside a key. Rows shuffle once by (keys, bucket);
    the bucket totals are partially aggregated and only later buckets receive an offset.
    """
    marked = df.withColumn("_bucket", bucket)
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_before", F.sum("_total").over(earlier))
        .filter(F.col("_before").isNotNull())
        .drop("_total")
    )
    last = 0 if inclusive else -1
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    return (
        marked.withColumn("_local", F.sum(value).over(inside))
        .join(offsets, [*keys, "_bucket"], "left")
        .select(
            *df.columns,
            (F.coalesce("_local", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(name),
        )
    )


def number_rows(
    df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "pos"
) -> DataFrame:
    """0-based position of each row inside its key, in ``order`` (which must be unique)."""
    return prefix_sum(df, keys, bucket, order, F.lit(1).cast("long"), name, inclusive=False)


def chunk_with_overlap(
    df: DataFrame, pos: str, overlap: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cut numbered groups into chunks of ``rows`` rows, each led by the ``overlap`` rows before it.

    Adds ``chunk`` and ``own`` (false for the borrowed leading rows). A sliding frame of up to
    ``overlap`` preceding rows is then exact inside (key, chunk).
    """
    home = F.floor(F.col(pos) / F.lit(rows)).cast("long")
    lent = F.col(pos) % F.lit(rows) >= F.lit(rows - overlap)
    return (
        df.withColumn("_home", home)
        .withColumn(
            "chunk",
            F.explode(F.when(lent, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))),
        )
        .withColumn("own", F.col("chunk") == F.col("_home"))
        .drop("_home")
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunks: DataFrame
) -> DataFrame:
    """Last non-null ``value`` at or before each row, for rows already cut into ``chunk``.

    ``chunks(keys, chunk)`` lists every chunk once. Inside a chunk this is a window; across chunks
    only one value per chunk travels.
    """
    inside = W.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys, "chunk").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_end")
    )
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    inherited = (
        chunks.join(ends, [*keys, "chunk"], "left")
        .withColumn("_in", F.last("_end", ignorenulls=True).over(earlier))
        .filter(F.col("_in").isNotNull())
        .select(*keys, "chunk", "_in")
    )
    return (
        df.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
        .join(inherited, [*keys, "chunk"], "left")
        .select(*df.columns, F.coalesce("_here", "_in").alias(name))
    )
