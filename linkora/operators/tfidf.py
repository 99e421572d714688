"""Document frequencies and TF-IDF weights over exploded tokens (entity_id, country, field, tok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import FIELDS


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(field, tok, df) over rows of distinct tokens."""
    return tokens.groupBy("field", "tok").agg(F.count("*").alias("df"))


def idf(n: int | Column, df: Column) -> Column:
    return F.log((F.lit(n) + 1) / (df + 1)) + 1


def weighted(tokens: DataFrame, frequency: DataFrame, n: int, cap: int | None = None) -> DataFrame:
    """Tokens with weight w, L2-normed in each entity and field. Tokens outside ``frequency`` vanish, those above ``cap`` too.

    Rows are partitioned by entity once; all norms and sums of an entity, here and in :func:`block_vector`, need no other shuffle.
    """
    known = frequency if cap is None else frequency.filter(F.col("df") <= cap)
    rows = tokens.join(known, ["field", "tok"]).withColumn("w", idf(n, F.col("df"))).repartition("entity_id")
    per_field = Window.partitionBy("entity_id", "field")
    return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_field))).drop("df")


def block_vector(tokens: DataFrame, frequency: DataFrame, n: int, cap: int | None, weights: dict[str, float] | None = None) -> DataFrame:
    """(entity_id, country, tok, w): the fields' capped vectors, weighted, summed by token and L2-normed again."""
    weight = F.create_map(*[F.lit(x) for pair in (weights or FIELDS).items() for x in pair])
    rows = weighted(tokens, frequency, n, cap).groupBy("entity_id", "country", "tok").agg(F.sum(F.col("w") * F.element_at(weight, F.col("field"))).alias("w"))
    whole = Window.partitionBy("entity_id")
    return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))


def field_vectors(weights: DataFrame) -> DataFrame:
    """(entity_id, v_name, v_addr, v_num): the fields' vectors of :func:`weighted` as maps token -> weight, a row for each entity.

    The rows are partitioned by entity already, so nothing is shuffled. An entity has each token of a field once.
    """
    one = lambda f: F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.struct("tok", "w")))).alias(f"v_{f}")
    return weights.groupBy("entity_id").agg(*[one(f) for f in FIELDS])
