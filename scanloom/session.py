"""Session settings the jobs expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that change results or protect against skew. Sizes (executors, memory, shuffle
# partitions) belong to the deployment and are left to it.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Raster stages do much work per byte, so small shuffles are still worth spreading.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Histograms and scanlines take some fifty times their shuffled bytes when they are sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread_shuffles(spark: SparkSession, partitions: int) -> None:
    """Start shuffles with so many partitions at least, so that a task's share does not grow with the input;
    Spark joins those that turn out small."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if partitions > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, partitions)


def local_session(cpus: int | str = 8, name: str = "scanloom", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and bench.py."""
    # Task workers must be able to import the package from wherever the driver was started.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
