"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, splitmix64
from .tokens import bpe_file, bpe_of, bpe_pattern
from .workers import tidy

PIECES = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item: items by falling length, each into the first bin with room.

    The leaves of a complete binary tree hold the bins' room and each inner node the larger of its
    children, so the first bin that fits is found in one walk from the root. Items of the full
    capacity take bins of their own, before all others, as first-fit decreasing has it.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    size = 1 << max(0, len(rest) - 1).bit_length()
    tree = [capacity] * (2 * size)
    sizes = lengths.tolist()
    for item in rest:
        need, node = sizes[item], 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = full + node - size, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pieces(docs: DataFrame, groups: int, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False, seed: int = 42) -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``capacity`` ids. Null text is empty; a document always has a piece.

    ``grp`` is drawn by the row's place in its partition, not by its content, so repeated rows spread.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent, pattern = spark.sparkContext.broadcast(bpe_file(vocabulary)), bpe_pattern()
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.array([end_id], dtype="<u4")

    def cut(batches):
        from pyspark import TaskContext

        bpe, at = bpe_of(sent.value, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            row, doc_ids = 0, batch.column(0).to_pylist()
            drawn = (splitmix64(np.arange(at, at + len(doc_ids), dtype=np.uint64) ^ np.uint64(seed << 20)) % np.uint64(groups)).tolist()
            at += len(doc_ids)
            for ids, bounds in bpe.batches(batch.column(1)):
                out: list[tuple] = []
                for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.concatenate((ids[low:high], end))
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity].tobytes()
                        out.append((drawn[row], doc_ids[row], start, len(part) // 4, zlib.crc32(part), len(own), *([part] if with_ids else ())))
                    row += 1
                columns = list(zip(*out, strict=True))
                types = [pa.int64()] * 6 + [pa.binary()] * with_ids
                names = ["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut, model=True), schema)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False, group_docs: int = 4096, seed: int = 42) -> DataFrame:
    """Pack whole ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    ``with_ids``, the ids themselves (little-endian unsigned 32-bit). A sequence lies in one group of about
    ``group_docs`` documents, so a task holds one group only. Text is never shuffled: the ids become
    pieces where they are read. Null text counts as empty (its one id is ``end_id``); a null doc_id stays
    null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, groups, capacity, end_id, vocabulary, with_ids, seed)

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        sequence = pa.array((group.column("grp").to_numpy() << 32) + bins)
        return group.drop_columns(["grp"]).append_column("sequence_id", sequence).append_column("offset", pa.array(offsets))

    out = PIECES.removeprefix("grp long, ") + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return cut.groupBy("grp").applyInArrow(fill, out)
