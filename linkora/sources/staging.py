"""Tables written to the folder that driver and executors share: what is used twice is computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a folder of this machine is made, which is right for a local master only; on any
    other master the setting is required.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkora-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that the application has written there; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffled is deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_deleted(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_each(parts: Iterable[DataFrame], name: str) -> list[DataFrame]:
    """Each of ``parts`` written before the next is asked for, so that the shuffles of one at a time are on disk."""
    return [staged(part, name, "zstd") for part in parts]


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def staged_by(df: DataFrame, name: str, column: str, n: int) -> list[DataFrame]:
    """``df`` written once, in ``n`` parts by the hash of ``column``."""
    if n == 1:
        return [staged(df, name)]
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    part = F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    with shuffles_deleted(spark):
        df.withColumn("_part", part).write.option("compression", "zstd").partitionBy("_part").parquet(path)
    whole = spark.read.schema(StructType([*df.schema, StructField("_part", IntegerType())])).parquet(path)
    return [whole.filter(F.col("_part") == k).drop("_part") for k in range(n)]


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, dealt out to every core where it has fewer partitions: a file of one row group is one task's work, however dear its rows.

    A scan of more partitions, as of any large table, is left alone. Select its columns first.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
