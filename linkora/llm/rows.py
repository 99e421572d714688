"""Rows numbered and written once, so that what a stage drops by number needs no shuffle of the texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path

#: A bucket key stands for so many consecutive numbers at most, which bounds the list of those that go.
GROUP_BITS = 12


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class NumberedRows:
    """``docs`` with a unique ``number`` a row, written as a table bucketed by runs of numbers.

    A task's rows are numbered in order, so writing shuffles nothing and a task fills few buckets. Repeated
    rows get numbers of their own; columns of any name are kept.
    """

    def __init__(self, docs: DataFrame, most_buckets: int = 20_000):
        spark, self.columns = docs.sparkSession, docs.columns
        self.number, self.group = free_name(docs, "_row"), free_name(docs, "_rows")
        self.buckets = max(1, min(most_buckets, docs.rdd.getNumPartitions()))
        rows = docs.withColumn(self.number, F.monotonically_increasing_id()).withColumn(self.group, F.shiftright(self.number, GROUP_BITS))
        name = f"numbered_rows_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, self.group).option("path", shared_path(spark, "rows")).saveAsTable(name)
        self.rows = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay where they are

    def _beside(self, numbers: DataFrame, how: str) -> tuple[DataFrame, str]:
        """The rows with the ``numbers`` (a DataFrame's one column) of their group beside them, and that column's name. Only numbers are shuffled."""
        column = free_name(self.rows, "_numbers")
        grouped = numbers.toDF(self.number).withColumn(self.group, F.shiftright(self.number, GROUP_BITS)).repartition(self.buckets, self.group)  # as the rows' buckets
        lists = grouped.groupBy(self.group).agg(F.collect_set(self.number).alias(column))
        return self.rows.join(lists.hint("shuffle_hash"), self.group, how), column

    def without(self, dropped: DataFrame) -> DataFrame:
        """The rows, as they came, less those whose number is in ``dropped``."""
        rows, column = self._beside(dropped, "left")
        return rows.filter(F.col(column).isNull() | ~F.array_contains(column, F.col(self.number))).select(self.columns)

    def texts(self, numbers: DataFrame) -> DataFrame:
        """(row, text) of the rows whose number is in ``numbers``."""
        rows, column = self._beside(numbers, "inner")
        return rows.filter(F.array_contains(column, F.col(self.number))).select(F.col(self.number).alias("row"), "text")
