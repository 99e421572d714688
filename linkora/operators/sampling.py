"""Geo keys and the geo-stratified development sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import components, last_component
from .ids import bucket


def geo_vocabulary(entities: DataFrame, min_count: int = 500) -> DataFrame:
    """(country, comp): last address components that are frequent within their country."""
    rows = entities.select("country", last_component(F.col("business_address")).alias("comp"))
    return rows.groupBy("country", "comp").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).drop("n")


def with_geo(entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``geo``: ``country|component`` of the last component in the vocabulary, or ``country|?``."""
    comps = entities.select("entity_id", "country", F.posexplode(components(F.col("business_address"))).alias("pos", "comp"))
    found = comps.join(vocabulary, ["country", "comp"]).groupBy("entity_id").agg(F.max_by("comp", "pos").alias("comp"))
    return entities.join(found, "entity_id", "left").withColumn("geo", F.concat_ws("|", "country", F.coalesce("comp", F.lit("?")))).drop("comp")


def pick_groups(sizes: DataFrame, fraction: float, order: Column) -> DataFrame:
    """Whole groups (geo, n) in ``order`` until ``fraction`` of all rows is covered; those above half of it are skipped.

    A skipped group doesn't count, so the largest are left out first and a running sum decides. The window's rows are geo keys, not records.
    """
    total = sizes.agg(F.sum("n").alias("total"))
    rows = sizes.crossJoin(F.broadcast(total)).filter(F.col("n") <= 0.5 * fraction * F.col("total"))  # one row
    before = F.coalesce(F.sum("n").over(Window.orderBy(order, "geo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < fraction * F.col("total")).select("geo", "n")


def geo_sample(entities: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Entities (with geo) of the picked geo keys; the keys' order is that of their md5."""
    sizes = entities.groupBy("geo").agg(F.count("*").alias("n"))
    return entities.join(pick_groups(sizes, fraction, F.md5(F.col("geo").cast("binary"))).select("geo"), "geo", "left_semi")


def development_records(records: DataFrame, sample: DataFrame, picked: DataFrame, component_geo: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Records of sampled entities, unowned ones of picked geo keys, and a ``fraction`` of the unowned without a known one.

    ``records`` have true_s1 (null: unowned), ``component_geo`` maps (country, comp) to geo, ``picked`` has the geo keys.
    """
    owned = records.filter("true_s1 is not null").join(sample.select(F.col("entity_id").alias("true_s1")), "true_s1", "left_semi").select(records.columns)
    unowned = records.filter("true_s1 is null")
    comps = unowned.select("entity_id", "country", F.posexplode(components(F.col("business_address"))).alias("pos", "comp"))
    geo = comps.join(component_geo.select("country", "comp", "geo"), ["country", "comp"]).groupBy("entity_id").agg(F.max_by("geo", "pos").alias("geo"))
    known = unowned.join(geo, "entity_id", "left").join(picked.select("geo", F.lit(True).alias("in_picked")), "geo", "left")
    coin = bucket(F.col("entity_id"), seed, 1_000_000) < fraction * 1_000_000
    return owned.unionByName(known.filter(F.col("in_picked") | (F.col("geo").isNull() & coin)).select(records.columns))
