"""Exact dedup: a persistent digest index, bucketed and sorted by hash; new rows meet it in a sort-merge anti-join."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, staged


def normalised(text: Column) -> Column:
    r"""Null as empty; each run of ``[\x20\x09-\x0D]`` as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A table (digest, keep_id) in the folder ``path``, bucketed and sorted by digest.

    It lives in the folder, not in the session: ``path/versions`` lists its versions (number, buckets), the last of which
    is in ``path/v<number>``. A later session opens it by its path alone; ``buckets`` is for a new index, and
    opening one that has another number of buckets is refused. A batch meets the buckets in merge joins that shuffle the
    batch only; each bucket is sorted again as it is read, since a bucket gets a file from every append.
    :meth:`compact` writes one file for each bucket, with more buckets where it has grown.
    """

    ROWS = 1_000_000  # wanted in a bucket at most

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        known = self._versions()
        if known and buckets not in (None, known[-1][1]):
            raise ValueError(f"the index at {path} has {known[-1][1]} buckets, not {buckets}")
        if not known:
            self._add_version(0, buckets or 64)
            known = [(0, buckets or 64)]
        self._open(*known[-1])

    def _versions(self) -> list[tuple[int, int]]:
        try:
            return sorted(map(tuple, self.spark.read.schema("number int, buckets int").parquet(f"{self.path}/versions").collect()))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _add_version(self, number: int, buckets: int) -> None:
        self.spark.createDataFrame([(number, buckets)], "number int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def _create(self, number: int, buckets: int) -> str:
        where = f"{self.path}/v{number}"
        name = "digest_index_" + hashlib.sha256(where.encode()).hexdigest()[:24]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
        return name

    def _open(self, number: int, buckets: int) -> None:
        self.number, self.buckets, self.name = number, buckets, self._create(number, buckets)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def dealt(self, firsts: DataFrame) -> DataFrame:
        """``firsts`` (digest and more, a row for each digest), stored, dealt out as the buckets are."""
        return staged(firsts, "firsts").repartition(self.buckets, "digest")

    def unknown(self, dealt: DataFrame) -> DataFrame:
        """The rows whose digest the index lacks: a sort-merge anti-join, bucket by bucket."""
        return dealt.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def known(self, dealt: DataFrame) -> DataFrame:
        """The rows whose digest the index has, with the keep_id it has."""
        return dealt.join(self.rows().hint("merge"), "digest")

    def append(self, new: DataFrame) -> None:
        """Add rows (digest, keep_id) that are unknown. Repeating a batch adds nothing."""
        self.unknown(new.select("digest", "keep_id")).write.insertInto(self.name)

    def compact(self) -> None:
        """Write the rows anew as the next version, a file for each bucket of about ``ROWS`` rows; readers of the old one are not disturbed."""
        rows = self.rows()
        buckets = max(self.buckets, -(-rows.count() // self.ROWS))
        old, name = self.name, self._create(self.number + 1, buckets)
        rows.repartition(buckets, "digest").write.insertInto(name)
        self._add_version(self.number + 1, buckets)
        self._open(self.number + 1, buckets)
        self.spark.sql(f"DROP TABLE {old}")  # its name; the files stay for those who read them

    def close(self) -> None:
        """Forget the session's name for it; the index stays in its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex, row: str | None = None) -> DataFrame:
    """Dedup whole ``docs`` (doc_id, text) against ``index`` and themselves, and add what is new to it.

    Returns a row for each input row: doc_id, keep_id (doc_id of the row that stays, of an earlier batch
    if the index has its digest), group_size (equal texts in this batch), kept, text_sha256. Of equal
    texts the smallest doc_id stays, null ids last; of rows that also share the id, one. An empty table
    gives no rows; other columns are ignored. If ``docs`` has unique row ids, ``row`` is their column, and it is returned too.

    Texts are read once and leave as digests; a digest's rows are counted before the shuffle. Which digests are
    new, so whose rows may stay, is the anti-join's answer; the others take their keep_id from the index. Only
    the batch's distinct digests meet the index; the join back to the rows can be split where one digest holds many.
    """
    rows = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text").cast("string")), 256).alias("digest"), (F.col(row).cast("long") if row else F.monotonically_increasing_id()).alias("row")),
        "digests",
    )
    key = F.struct(F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("row").alias("c"))
    firsts = index.dealt(rows.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("group_size")))
    new = index.unknown(firsts).select("digest", F.when(~F.col("first.a"), F.col("first.b")).alias("keep_id"), F.col("first.c").alias("first_row"), "group_size")
    old = index.known(firsts).select("digest", "keep_id", F.lit(None).cast("long").alias("first_row"), "group_size")
    groups = staged(new.unionByName(old), "groups")
    index.append(groups.filter("first_row is not null"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("first_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"), *([F.col("row").alias(row)] if row else []))


def new_index(spark: SparkSession, path: str | None = None, rows: int = 0) -> DigestIndex:
    """An index in ``path`` (by default a new folder of the shared one) with buckets for about ``rows`` digests, 20,000 at most."""
    return DigestIndex(spark, path or shared_path(spark, "digest-index"), max(8, min(20_000, -(-rows // DigestIndex.ROWS))))
