"""Sharding by bytes: splitters from size-weighted key samples, range partitions, overfull ranges subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def splitters(keys: DataFrame, ranges: int, total: int, largest: float, per_range: int = 16) -> tuple[list[tuple[int, int]], list[int]]:
    """(at most ``ranges - 1`` quantile boundaries of (h, h2), the hashes of over ``largest`` in all that they may divide).

    About ``ranges * per_range`` keys are drawn with weight ``size``: a key is drawn if ``-ln(u) / size`` is below a
    threshold, u being a hash of the key and ``total`` the sum of sizes, so each task decides alone, and the
    driver gets about that many keys whatever the input's size. A hash drawn for several boundaries keeps the
    inner ones, which subdivide it, only if its exact size is over ``largest``; else, and where it is drawn
    for one, the boundary moves ahead of that hash's rows.
    """
    u = (F.pmod(F.xxhash64("h", "h2", F.lit(7)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = sorted((r.h, r.h2) for r in keys.filter(-F.log(u) / F.col("size") < ranges * per_range / max(1, total)).select("h", "h2").collect())
    chosen = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    of_hash: dict[int, int] = {}
    for h, _ in chosen:
        of_hash[h] = of_hash.get(h, 0) + 1
    several = [(h,) for h, n in of_hash.items() if n > 1]  # at most half as many as ranges
    exact = keys.join(F.broadcast(keys.sparkSession.createDataFrame(several, "h long")), "h").groupBy("h").agg(F.sum("size").alias("size")).collect() if several else []
    divided = {r.h for r in exact if r["size"] > largest}
    low = -(1 << 63)
    return sorted({(h, h2 if h in divided else low) for h, h2 in chosen}), sorted(divided)


def range_of(h: np.ndarray, h2: np.ndarray, at: list[tuple[int, int]]) -> np.ndarray:
    """How many splitters are at or below each (h, h2)."""
    first = np.array([a for a, _ in at], dtype=np.int64)
    second = np.array([b for _, b in at], dtype=np.int64)
    low, high = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
    out = low.copy()
    for i in np.flatnonzero(high > low):
        out[i] += np.searchsorted(second[low[i] : high[i]], h2[i], "right")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, rows_per_range: int = 100_000, most_ranges: int = 20_000, together: float = 0.01) -> DataFrame:
    """Put whole ``docs`` (doc_id, text) into ``shards`` shards of near-equal size.

    Size is the text's UTF-8 bytes (null: none) plus 1. Returns doc_id, size, text_crc32, law (``bytes``),
    shard, slot (gapless from 0 in each shard), grown_shard (null under this law). Rows are ordered by the
    hash of their text, then by that of their id, so equal texts stand together. A group of equal texts stays in
    one shard unless that alone could move a shard's size by more than the law's tolerance: sizes are near equal if
    they differ by a few times ``together`` of a shard, so a group larger than that is divided row by row. Null and
    repeated ids and rows are placed like others; an empty table gives no rows; other columns are ignored.

    Exact sizes of the ranges set where each begins, so no task orders more than about one range, of
    ``rows_per_range`` rows of numbers or, beyond ``most_ranges`` ranges, more.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows.withColumn("h2", F.xxhash64("doc_id", "row")), "sizes")
    n_rows, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(8 * shards, min(most_ranges, -(-n_rows // rows_per_range)))
    largest = together * size / shards
    at, divided = splitters(rows, ranges, size, largest)

    @F.pandas_udf("int")
    def place(h: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(), h2.to_numpy(), at).astype(np.int32))

    @F.pandas_udf("boolean")
    def over_ranges(h: pd.Series) -> pd.Series:
        return pd.Series(np.isin(h.to_numpy(), divided))

    rows = staged(rows.withColumns({"part": place("h", "h2"), "over": over_ranges("h")}), "ranged")
    parts = sorted(rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    starts, bytes_, count = [], 0, 0
    for part in parts:
        starts.append((part.part, bytes_, count))
        bytes_, count = bytes_ + part.bytes, count + part.n
    spark, total = docs.sparkSession, max(1, bytes_)
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, bytes_before long, rows_before long"))  # at most `ranges` rows
    order = Window.partitionBy("part").orderBy("h", "h2", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("part", "h")
    ordered = (
        rows.withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("rank", F.count("*").over(order))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_ahead", F.min("ahead").over(group))
        .join(offsets, "part")
        .withColumn("stays", ~F.col("over") & (F.col("group_bytes") <= largest))
        # a group's middle, or a row's own, decides
        .withColumn("middle", F.col("bytes_before") + F.when(F.col("stays"), F.col("group_ahead") + F.col("group_bytes") / 2).otherwise(F.col("ahead") + F.col("size") / 2))
        .select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rank")).alias("place"), F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / total)).cast("int").alias("shard"))
    )
    ordered = staged(ordered, "ordered")
    firsts = F.broadcast(ordered.groupBy("shard").agg(F.min("place").alias("first")))  # at most `shards` rows
    return ordered.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
