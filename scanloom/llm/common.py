"""Helpers shared by the operators: staged tables, code shipping, text and hash expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space that the contracts strip and split at, and the letters that they lower.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows that pass to a Python worker at once. Texts can be long, and the setting's own default of ten
# thousand of them takes much of a worker's memory; so can a thousand bands of large images.
BATCH_ROWS = 1000
BATCH_BYTES = 64 << 20

_shipped: set[str] = set()
_memos: list = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application, and keep
    the batches that they get small."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{package}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join(package, os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def remembers(make):
    """Marks a cached maker of large tables, for ``release_memos``."""
    _memos.append(make)
    return make


def release_memos() -> None:
    """Frees what earlier stages left in this Python worker; tasks that need none of it call this."""
    for make in _memos:
        make.cache_clear()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only where that setting is missing on a local master (tests) is a temporary folder taken.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage: lost executors never recompute what is written, and every reader sees the
    same rows. The files stay until the owner of the checkpoint folder clears it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, everything else kept; the fast path is for texts of ASCII only."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
