"""Structured Streaming forms of the stateful operators.

State is kept per key in the state store; the processors hold only small per-row logic. They need
``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``use_rocksdb``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
