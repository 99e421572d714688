"""Tab-separated sources and sinks: every column a string, quotes ordinary characters, blank is blank."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


def read_tsv(spark: SparkSession, path: str, columns: list[str] = RECORD_COLUMNS) -> DataFrame:
    """A file or folder with a header line. Blank fields are empty strings, and texts like NA stay text."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, StringType())
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Strings as they are; blank fields stay blank and outer spaces stay."""
    (df.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def data_dir(default: str = "dataset") -> str:
    return os.environ.get("LINKORA_DATA_DIR", default)


def source_path(split: str, source: int, root: str | None = None) -> str:
    return f"{root or data_dir()}/{split}/{split}_source{source}.tsv"


def read_source(spark: SparkSession, split: str, source: int, root: str | None = None) -> DataFrame:
    return read_tsv(spark, source_path(split, source, root))


def read_records(spark: SparkSession, split: str, root: str | None = None) -> DataFrame:
    """Both record feeds of a split."""
    return read_source(spark, split, 2, root).unionByName(read_source(spark, split, 3, root))


def read_truth(spark: SparkSession, split: str = "train", root: str | None = None) -> DataFrame:
    return read_tsv(spark, f"{root or data_dir()}/{split}/{split}_ground_truth.tsv", TRUTH_COLUMNS)


def exploded_truth(truth: DataFrame) -> DataFrame:
    """(s_id, q_id): a row for each match in the comma lists."""
    rows = truth.filter(F.col("matched_entity_ids") != "")
    return rows.select(F.col("source1_entity_id").alias("s_id"), F.explode(F.split("matched_entity_ids", ",")).alias("q_id"))


def records_with_two_owners(pairs: DataFrame) -> DataFrame:
    """Records that break the rule of one owner: none in good data."""
    return pairs.groupBy("q_id").agg(F.count("*").alias("n_owners")).filter("n_owners > 1")
