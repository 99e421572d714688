"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkora.llm import decontam, exact_dedup, langid, packing, similar, simhash
from linkora.llm.common import staged, table
from linkora.llm.rows import NumberedRows, free_name

# In every stage: columns of any name are kept as they are, also those an operator uses itself; an empty table gives no
# rows. The stages that drop rows number them and drop by that number, so repeated rows, shared ids and null ids
# decide nothing but which of equal or similar rows stays (the smallest doc_id, null ids last, then any one).


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null or has no letters; fills a null ``lang`` with the prediction. Each row is judged by itself: repeated rows stay or go together."""
    names = free_name(docs, "_language"), free_name(docs, "_score")
    found = langid.predict(docs, langid.train(docs), names).filter(F.col(names[0]) != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space as one space, null as empty) the one of the smallest doc_id stays."""
    numbered = NumberedRows(docs)
    rows = numbered.rows.select(F.col(numbered.number).alias("row"), "doc_id", "text")
    index = exact_dedup.new_index(spark, rows=rows.count())
    found = exact_dedup.deduplicate(rows, index, "row")
    index.close()
    return numbered.without(found.filter(~F.col("kept")).select("row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links (five words, 3 bits), each group checked by exact similarity, and what lies further apart than 3 bits.

    Of rows linked, over others, by a five-word Jaccard similarity of at least 0.8 the one of the smallest doc_id stays. Texts without words, null ones too, count as alike.
    """
    numbered = NumberedRows(docs)
    groups = simhash.near_duplicates(numbered.rows.select(F.col(numbered.number).alias("doc_id"), "text"), words=5)
    return numbered.without(similar.repeats(numbered, groups))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of whose words at least one in twenty is inside a window of ``benchmark``; a null or empty text has no words and stays."""
    numbered = NumberedRows(docs)
    found = decontam.contamination(numbered.rows.select(F.col(numbered.number).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return numbered.without(found.filter("contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows packed into sequences of 2048 ids, each row by itself; a null text is empty (one id), a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: The first stage is a learned model and the last a tokenizer's output; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
