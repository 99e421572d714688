"""Checks and packaging of the two list outputs."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import write_tsv
from .staging import shared_path


def violations(matches: DataFrame, candidates: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, n): how often each rule of the outputs is broken; all 0 in good outputs.

    ``matches`` and ``candidates``: (source1_entity_id, ids); ``entities`` and ``records`` have entity_id. Every entity has
    one row, ids are distinct within a row, belong to known records of sources 2 and 3, and matches are candidates.
    """

    def listed(df: DataFrame) -> DataFrame:
        return df.filter(F.col("ids") != "").select("source1_entity_id", F.explode(F.split("ids", ",")).alias("q_id"))

    def counted(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    m, c, ids = listed(matches), listed(candidates), entities.select(F.col("entity_id").alias("source1_entity_id"))
    rules = [
        ("entity without a row", ids.join(matches, "source1_entity_id", "left_anti")),
        ("row of an unknown entity", matches.join(ids, "source1_entity_id", "left_anti")),
        ("entity with two rows", matches.groupBy("source1_entity_id").count().filter("count > 1")),
        ("id twice in a list", m.groupBy("source1_entity_id", "q_id").count().filter("count > 1")),
        ("id of another source", m.filter(~F.col("q_id").rlike("^S[23]-"))),
        ("id of no record", m.join(records.select(F.col("entity_id").alias("q_id")), "q_id", "left_anti")),
        ("match that is no candidate", m.join(c, ["source1_entity_id", "q_id"], "left_anti")),
    ]
    out = counted(*rules[0])
    for rule in rules[1:]:
        out = out.unionByName(counted(*rule))
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files of any size, read in pieces of a megabyte; one task reads a file."""

    def run(batches):
        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, length long, sha256 string")


def write_list_file(lists: DataFrame, entities: DataFrame, path: str) -> None:
    """``lists`` (source1_entity_id and more) as one tab-separated file at ``path``, in the order of ``entities`` (entity_id), read from one file.

    One task sorts and writes all rows, as a single file has it; an earlier file is replaced.
    """
    spark = lists.sparkSession
    place = entities.select(F.col("entity_id").alias("source1_entity_id"), F.monotonically_increasing_id().alias("_place"))
    rows = lists.join(place, "source1_entity_id").repartition(1).sortWithinPartitions("_place").drop("_place")
    folder = shared_path(spark, "list-file")
    write_tsv(rows.select(lists.columns), folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, source, target = spark._jsc.hadoopConfiguration(), hadoop.Path(folder), hadoop.Path(path)
    store, to = source.getFileSystem(conf), target.getFileSystem(conf)
    part = next(x.getPath() for x in store.listStatus(source) if x.getPath().getName().startswith("part-"))
    hadoop.FileUtil.copy(store, part, to, target, False, True, conf)
    store.delete(source, True)


def pack_archive(path: str, members: Mapping[str, str]) -> None:
    """A ZIP of ``members`` (name in it -> file), replacing an earlier one. All files must be there."""
    missing = [f for f in members.values() if not os.path.isfile(f)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    if os.path.exists(path):
        os.remove(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True, compresslevel=6) as archive:
        for name, file in members.items():
            archive.write(file, name)
    verify_archive(path, set(members))


def verify_archive(path: str, names: set[str]) -> None:
    """Every member's checksum, and exactly these members."""
    with zipfile.ZipFile(path) as archive:
        if (bad := archive.testzip()) is not None:
            raise ValueError(f"{bad} is damaged")
        if (found := set(archive.namelist())) != names:
            raise ValueError(f"missing {sorted(names - found)}, unexpected {sorted(found - names)}")
