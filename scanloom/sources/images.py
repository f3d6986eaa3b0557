"""Encoded page images to scanlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.raster.grid import to_bands


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """Decoded images (Spark's image source); files that cannot be decoded are skipped."""
    return spark.read.format("image").option("dropInvalid", True).load(glob)


def dropped_images(spark: SparkSession, glob: str) -> DataFrame:
    """``image_path`` of the files that ``read_images`` skips."""
    every = spark.read.format("image").load(glob)
    return every.filter(F.col("image.height") < 0).select(F.element_at(F.split("image.origin", "/"), -1).alias("image_path"))


def image_dims(images: DataFrame) -> DataFrame:
    """Name, width and height of each image."""
    return images.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image_path"),
        F.col("image.width").alias("img_w"),
        F.col("image.height").alias("img_h"),
    )


def image_scanlines(images: DataFrame, page_id: Column) -> DataFrame:
    """Scanlines of 1-, 3- or 4-channel images. Bytes are row-major, colour as blue, green, red."""
    image = F.col("image")
    channels, width = image["nChannels"], image["width"]
    # Cut into lines before the explode, so a row carries its own line and never the whole raster.
    lines = F.transform(
        F.sequence(F.lit(0), image["height"] - 1),
        lambda y: F.hex(F.substring(image["data"], y * width * channels + 1, width * channels)),
    )
    lined = images.select(
        page_id.alias("page_id"), channels.alias("_c"), width.alias("_w"), image["height"].alias("_h"), F.posexplode(lines).alias("y", "_hex")
    )

    def plane(offset: int) -> Column:
        at = F.when(F.col("_c") == 1, F.lit(0)).otherwise(offset)
        return F.transform(
            F.sequence(F.lit(0), F.col("_w") - 1),
            lambda x: F.conv(F.substring(F.col("_hex"), (x * F.col("_c") + at) * 2 + 1, F.lit(2)), 16, 10).cast("int"),
        )

    return to_bands(
        lined.select(
            "page_id", "y", F.col("_h").alias("h"), F.col("_w").alias("w"),
            plane(2).alias("r"), plane(1).alias("g"), plane(0).alias("b"),
        )
    )
