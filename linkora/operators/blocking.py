"""Candidate pairs by a sparse cosine top-K join over an inverted index, scoped by country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q_id, s_id, cos) of all pairs that share a token of their country. The sum starts before the shuffle.

    Fan-out is bounded by the cap on document frequency that both sides' vectors were made with. The join's key is a
    64-bit hash of country and token, so no token text is shuffled.
    """
    key = F.xxhash64("country", "tok").alias("key")
    q = queries.select(F.col("entity_id").alias("q_id"), key, F.col("w").alias("wq"))
    s = index.select(F.col("entity_id").alias("s_id"), key, F.col("w").alias("ws"))
    return q.join(s, "key").groupBy("q_id", "s_id").agg(F.round(F.sum(F.col("wq") * F.col("ws")), 6).alias("cos"))


def top_candidates(pairs: DataFrame, top_k: int = 8, min_cos: float = 0.08, rel_cos: float = 0.25) -> DataFrame:
    """The best ``top_k`` pairs of each query with ``cos >= min_cos``, of those the ones with ``cos >= rel_cos`` times the best. Ties go by s_id."""
    order = Window.partitionBy("q_id").orderBy(F.desc("cos"), "s_id")
    best = pairs.filter(F.col("cos") >= min_cos).withColumn("cos_rank", F.row_number().over(order)).filter(F.col("cos_rank") <= top_k)
    return best.withColumn("best", F.max("cos").over(Window.partitionBy("q_id"))).filter(F.col("cos") >= rel_cos * F.col("best")).drop("best")


def competition(pairs: DataFrame) -> DataFrame:
    """cos_rank, cos_gap, cos_ratio and n_cand of each pair within its query, in one shuffle."""
    group = Window.partitionBy("q_id")
    best = F.max("cos").over(group)
    return pairs.withColumns({
        "cos_rank": F.row_number().over(group.orderBy(F.desc("cos"), "s_id")), "cos_gap": F.round(best - F.col("cos"), 6),
        "cos_ratio": F.round(F.col("cos") / best, 6), "n_cand": F.count("*").over(group),
    })


def _cosine(q: Column, s: Column) -> Column:
    """The product of two vectors, maps of token -> weight, summed over the first one's tokens."""
    return F.coalesce(F.round(F.aggregate(F.map_entries(q), F.lit(0.0), lambda total, x: total + x.value * F.coalesce(F.try_element_at(s, x.key), F.lit(0.0))), 6), F.lit(0.0))


#: The columns of :func:`tfidf.field_vectors`.
VECTORS = ("v_name", "v_addr", "v_num")


def with_cosines_of_vectors(rows: DataFrame) -> DataFrame:
    """name_cos, addr_cos and num_cos of rows that carry both sides' vectors (q_v_*, s_v_*), in their place."""
    found = {f"{v[2:]}_cos": _cosine(F.col(f"q_{v}"), F.col(f"s_{v}")) for v in VECTORS}
    return rows.withColumns(found).drop(*[f"{x}_{v}" for x in "qs" for v in VECTORS])


def with_field_cosines(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """``pairs`` (q_id, s_id and more) with name_cos, addr_cos and num_cos, from uncapped vectors; 0 where no token is shared.

    Vectors are maps, a row for each record (:func:`tfidf.field_vectors`): a pair carries its two rows, and no token is shuffled.
    """
    side = lambda df, x: df.select(F.col("entity_id").alias(f"{x}_id"), *[F.col(v).alias(f"{x}_{v}") for v in VECTORS])
    return with_cosines_of_vectors(pairs.join(side(index, "s"), "s_id", "left").join(side(queries, "q"), "q_id", "left"))


def field_cosines(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q_id, s_id, name_cos, addr_cos, num_cos) of (q_id, s_id) pairs."""
    return with_field_cosines(pairs.select("q_id", "s_id"), queries, index).select("q_id", "s_id", "name_cos", "addr_cos", "num_cos")
