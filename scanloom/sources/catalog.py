"""Reading and writing catalogue tables, rasters, file listings and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.schema import DOCUMENTS, MANIFEST, PAGES

CURRENT = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def _current(spark: SparkSession, folder: str) -> str:
    version = spark.read.text(f"{folder}/{CURRENT}").first()
    if version is None:
        raise FileNotFoundError(f"{folder} has no current version")
    return f"{folder}/{version[0]}"


def read_catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents and pages of the current version; columns a version lacks come back NULL."""
    at = _current(spark, folder)
    return spark.read.schema(DOCUMENTS).parquet(f"{at}/documents"), spark.read.schema(PAGES).parquet(f"{at}/pages")


def write_catalog(documents: DataFrame, pages: DataFrame, folder: str, partitions: int | None = None) -> str:
    """Write a new version beside the old one, then point to it; the version being read stays intact.

    Pages are grouped by document and sorted, so a document's pages sit in few row groups. Repartitioning
    adds the sort order's range, so one very large document still spreads over several files.
    """
    spark = documents.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    spread = [F.col("document_id"), F.floor(F.col("sort_order") / 4096)]
    laid_out = pages.repartition(partitions, *spread) if partitions else pages.repartition(*spread)
    documents.write.parquet(f"{folder}/{version}/documents")
    laid_out.sortWithinPartitions("document_id", "sort_order").write.parquet(f"{folder}/{version}/pages")
    # The pointer is written whole under another name and renamed, so a reader sees the old or the new one.
    fs, pending, jvm = _hadoop(spark, f"{folder}/.{CURRENT}-{version}")
    out = fs.create(pending, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(pending), fs.makeQualified(path), options)
    return version


def write_raster(px: DataFrame, folder: str, kind: str) -> None:
    """Append rendered scanlines under their kind (large, small, step0, …)."""
    px.filter("core").drop("band", "core").withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(folder)


def read_raster(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    from scanloom.raster.grid import to_bands

    return to_bands(spark.read.parquet(folder).filter(F.col("kind") == kind).drop("kind"))


def read_inventory(spark: SparkSession, folders: dict[str, str], cache_id: str = "device") -> DataFrame:
    """File listing by kind: name, size and time. File contents are never read."""
    parts = [
        spark.read.format("binaryFile").load(folder).select(
            F.lit(cache_id).alias("cache_id"),
            F.lit(kind).alias("kind"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
        )
        for kind, folder in folders.items()
    ]
    listing = parts[0]
    for part in parts[1:]:
        listing = listing.unionByName(part)
    return listing


def read_manifest(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Sample manifest (a JSON array); ``only`` picks entries by id, empty means all."""
    entries = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return entries.filter(F.col("id").isin(*only)) if only else entries
