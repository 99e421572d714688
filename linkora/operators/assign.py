"""Decisions over scored pairs (q_id, s_id, p) and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_owner(pairs: DataFrame, tau: float | None = None) -> DataFrame:
    """Each record's best entity, by p, then cos if there is one, then s_id; kept if p >= tau."""
    ties = ["cos"] if "cos" in pairs.columns else []
    order = Window.partitionBy("q_id").orderBy(F.desc("p"), *map(F.desc, ties), "s_id")
    best = pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return best if tau is None else best.filter(F.col("p") >= tau)


def f_beta(tp: Column, predicted: Column, true: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    precision, recall = tp / F.greatest(predicted, F.lit(1)), tp / F.greatest(true, F.lit(1))
    return F.when((predicted == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + b2) * precision * recall / (b2 * precision + recall))


def f_beta_by_entity(entities: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """s_id, country, tp, n_pred, n_true, f of every entity; ``predicted`` and ``truth`` are distinct (s_id, q_id) rows."""
    both = predicted.select("s_id", "q_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("s_id", "q_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    per_pair = both.groupBy("s_id", "q_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    counts = per_pair.groupBy("s_id").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))
    rows = entities.select(F.col("entity_id").alias("s_id"), "country").join(counts, "s_id", "left").fillna(0, ["tp", "n_pred", "n_true"])
    return rows.withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"), beta))


def tau_sweep(entities: DataFrame, scored: DataFrame, truth: DataFrame, taus: list[float], beta: float = 0.5) -> DataFrame:
    """(tau, f): the macro F-beta at each threshold, in one pass. ``scored`` is :func:`best_owner` without one.

    Every record counts for all thresholds up to its score, so each entity has a few counts for each threshold and no row is repeated by it.
    """
    hits = scored.join(truth.select("s_id", "q_id", F.lit(1).alias("t")), ["s_id", "q_id"], "left").fillna(0, ["t"])
    counts = [x for i, tau in enumerate(taus) for x in (F.sum(F.when(F.col("p") >= tau, 1).otherwise(0)).alias(f"n{i}"), F.sum(F.when(F.col("p") >= tau, F.col("t")).otherwise(0)).alias(f"h{i}"))]
    true = truth.groupBy("s_id").agg(F.count("*").alias("n_true"))
    rows = entities.select(F.col("entity_id").alias("s_id")).join(hits.groupBy("s_id").agg(*counts), "s_id", "left").join(true, "s_id", "left").fillna(0)
    means = rows.agg(*[F.avg(f_beta(F.col(f"h{i}"), F.col(f"n{i}"), F.col("n_true"), beta)).alias(f"f{i}") for i in range(len(taus))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(tau).alias("tau"), F.round(F.col(f"f{i}"), 6).alias("f")) for i, tau in enumerate(taus)])).alias("x")).select("x.tau", "x.f")


def blocking_quality(pairs: DataFrame, truth: DataFrame, n_records: Column, n_entities: Column) -> DataFrame:
    """n_pairs, found, n_true, recall and reduction ratio of candidate pairs."""
    found = pairs.join(truth.select("s_id", "q_id", F.lit(1).alias("t")), ["s_id", "q_id"], "left").agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("t"), F.lit(0)).alias("found"))
    out = found.crossJoin(truth.agg(F.count("*").alias("n_true")))  # one row each
    return out.withColumns({"recall": F.round(F.col("found") / F.greatest("n_true", F.lit(1)), 6), "reduction": F.round(1 - F.col("n_pairs") / (n_records * n_entities), 6)})


def grouped_lists(entities: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    """(source1_entity_id, ``column``) for every entity: its records' ids, distinct, sorted and comma-joined, empty for none."""
    lists = matches.groupBy("s_id").agg(F.array_join(F.array_sort(F.collect_set("q_id")), ",").alias(column))
    rows = entities.select(F.col("entity_id").alias("s_id")).join(lists, "s_id", "left")
    return rows.select(F.col("s_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def list_statistics(lists: DataFrame, column: str) -> DataFrame:
    """n_rows, n_ids and n_empty of a grouped-list output."""
    c = F.col(column)
    return lists.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(c != "", F.size(F.split(c, ","))).otherwise(0)), F.lit(0)).cast("long").alias("n_ids"), F.count_if(c == "").alias("n_empty"))
