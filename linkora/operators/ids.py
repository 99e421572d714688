"""Record ids ``S<source>-<number>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 2, 1).cast("int")


def encoded(entity_id: Column) -> Column:
    """source * 10^10 + number, as a long."""
    return F.substring(entity_id, 2, 1).cast("long") * 10**10 + F.substring(entity_id, 4, 20).cast("long")


def bucket(key: Column, seed: int, buckets: int) -> Column:
    """A stable bucket of a key, the same in any plan, at any partitioning and in other engines: 60 bits of its md5 with the seed."""
    digest = F.md5(F.concat_ws("|", key, F.lit(seed)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(buckets))
