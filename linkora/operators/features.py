"""The 44 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import PAIR_SCORES, pair_scores
from ..functions.normalize import skeleton
from . import blocking
from .ids import source_of

#: The columns a model sees, in order.
FEATURES = [
    "cos", "cos_rank", "cos_gap", "cos_ratio", "n_cand", "n_ratio", "n_tset", "c_ratio", "c_tsort", "c_tset", "c_partial", "c_jw",
    "cat_ratio", "cat_partial", "skel_ratio", "alias_best", "a_ratio", "a_tset", "a_tsort", "a_partial", "name_cos", "addr_cos",
    "num_cos", "num_inter", "num_jacc", "num_q_cov", "num_q_len", "num_s_len", "ntok_inter", "ntok_jacc", "ntok_q_cov", "atok_inter",
    "atok_jacc", "atok_q_cov", "q_addr_empty", "q_nonlatin", "q_src", "len_q_core", "len_s_core", "s_core_dup", "s_addr_dup",
    "c_tset_gap", "a_tset_gap", "name_cos_gap",
]


def with_duplicate_counts(entities: DataFrame) -> DataFrame:
    """core_dup and addr_dup: how many entities share the exact core or address, the empty one too.

    Counts are taken before the shuffle and joined back, so that a value of many rows (the empty one) doesn't meet in one task.
    """
    for column in ("core", "addr"):
        counts = entities.groupBy(column).agg(F.count("*").alias(f"{column}_dup"))
        entities = entities.join(counts, column)
    return entities


def overlap(q: Column, s: Column, prefix: str) -> dict[str, Column]:
    shared = F.size(F.array_intersect(q, s))
    return {
        f"{prefix}_inter": shared, f"{prefix}_jacc": F.round(shared / F.greatest(F.size(q) + F.size(s) - shared, F.lit(1)), 6),
        f"{prefix}_q_cov": F.round(shared / F.greatest(F.size(q), F.lit(1)), 6),
    }


def with_skeleton(records: DataFrame) -> DataFrame:
    """The core's skeleton, which a record with many pairs needs once."""
    return records.withColumn("skeleton", skeleton(F.col("core")))


def gathered(pairs: DataFrame, queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with both sides' columns, as q_* and s_*; with the vectors of sides that have them. Entities may have their duplicate counts already.

    Narrow pairs go to the entities first, so only the entities' columns are shuffled for each pair, and the rows end up by q_id.
    """
    entities = entities if "core_dup" in entities.columns else with_duplicate_counts(entities)
    side = lambda df, x, columns: df.select(*[F.col(c).alias(f"{x}_id" if c == "entity_id" else f"{x}_{c}") for c in (*columns, *blocking.VECTORS) if c in df.columns])
    q = side(queries, "q", ("entity_id", "name", "core", "alias", "addr", "skeleton", "nonlatin", "tok_name", "tok_addr", "tok_num"))
    s = side(entities, "s", ("entity_id", "name", "core", "addr", "skeleton", "tok_name", "tok_addr", "tok_num", "core_dup", "addr_dup"))
    return pairs.join(s, "s_id").join(q, "q_id")


def set_features(rows: DataFrame) -> DataFrame:
    """Overlaps of the token sets, and flags and lengths."""
    columns: dict[str, Column] = {}
    for field, prefix in (("num", "num"), ("name", "ntok"), ("addr", "atok")):
        columns |= overlap(F.col(f"q_tok_{field}"), F.col(f"s_tok_{field}"), prefix)
    columns |= {
        "num_q_len": F.size("q_tok_num"), "num_s_len": F.size("s_tok_num"), "q_addr_empty": (F.col("q_addr") == "").cast("int"),
        "q_nonlatin": F.col("q_nonlatin").cast("int"), "q_src": source_of(F.col("q_id")), "len_q_core": F.length("q_core"), "len_s_core": F.length("s_core"),
    }
    return rows.withColumns(columns)


def string_features(rows: DataFrame) -> DataFrame:
    """The fuzzy scores of names, cores, aliases and addresses, in one pass through Python."""
    columns = ["q_name", "s_name", "q_core", "s_core", "q_skeleton", "s_skeleton", "q_alias", "q_addr", "s_addr"]
    missing = {f"{x}_skeleton": skeleton(F.col(f"{x}_core")) for x in "qs" if f"{x}_skeleton" not in rows.columns}
    rows = rows.withColumns(missing).withColumn("scores", pair_scores(*map(F.col, columns)))
    return rows.withColumns({c: F.col(f"scores.{c}") for c in PAIR_SCORES}).drop("scores")


def pair_features(pairs: DataFrame, queries: DataFrame, entities: DataFrame, query_weights: DataFrame, entity_weights: DataFrame | None = None) -> DataFrame:
    """q_id, s_id and :data:`FEATURES` of the (q_id, s_id, cos) candidates.

    ``queries`` and ``entities`` are normalised records with tokens, the weights their uncapped vectors
    (:func:`tfidf.field_vectors`), which entities may have already.
    """
    beside = lambda df, vectors: df if vectors is None else df.join(vectors, "entity_id", "left")
    rows = gathered(blocking.competition(pairs.select("q_id", "s_id", "cos")), beside(queries, query_weights), beside(entities, entity_weights))
    rows = string_features(set_features(blocking.with_cosines_of_vectors(rows)))
    group = Window.partitionBy("q_id")
    rows = rows.withColumns({f"{c}_gap": F.max(c).over(group) - F.col(c) for c in ("c_tset", "a_tset", "name_cos")})
    return rows.select("q_id", "s_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES])
