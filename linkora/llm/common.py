"""What the corpus operators share: reading tables, the shared folder, staged tables, batch limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import clear, shared_dir, shared_path, staged

__all__ = ["MASK64", "bounded_batches", "clear", "shared_dir", "shared_path", "splitmix64", "staged", "table"]

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 32) -> None:
    """Arrow batches of a bounded size, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def splitmix64(x):
    """A 64-bit mixing function over a numpy uint64 array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
