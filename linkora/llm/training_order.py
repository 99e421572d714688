"""Training-order materialisation: a keyed Feistel permutation gives every sequence its slot in fixed-stride shards."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, splitmix64, staged
from .tokens import bpe_file, bpe_of, bpe_pattern, largest_id


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of 0..n-1, keyed: a balanced Feistel network over the next even power of two, walked until inside.

    Walking the cycle (applying it again while the value is n or more) keeps it a permutation; the domain
    is below 4n, so an index takes fewer than four steps on average.
    """
    index = np.asarray(index, dtype=np.uint64)
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = splitmix64(np.arange(rounds, dtype=np.uint64) + splitmix64(np.array([key], dtype=np.uint64)))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (splitmix64(right ^ k) & mask)
        return left << shift | right

    out = once(index)
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = once(out[at])
    return out.astype(np.int64)


def inverse_feistel(slot: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Which sequence is in a slot: a reader that resumes needs no table."""
    slot = np.asarray(slot, dtype=np.uint64)
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = splitmix64(np.arange(rounds, dtype=np.uint64) + splitmix64(np.array([key], dtype=np.uint64)))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys[::-1]:
            left, right = right ^ (splitmix64(left ^ k) & mask), left
        return left << shift | right

    out = once(slot)
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = once(out[at])
    return out.astype(np.int64)


def _sequences(batches, bpe, length: int, end: np.ndarray):
    """The sequences of a partition: its texts' ids and end ids in a row, cut every ``length``, as 16-bit bytes; the last may be short."""
    held = np.zeros(0, "<u2")
    for batch in batches:
        for ids, bounds in bpe.batches(batch.column(0)):
            held = np.concatenate((held, np.insert(ids.astype("<u2"), bounds[1:], end)))
            whole = len(held) - len(held) % length
            yield [held[i : i + length].tobytes() for i in range(0, whole, length)]
            held = held[whole:]
    if len(held):
        yield [held.tobytes()]


def encoded(docs: DataFrame, length: int, end_id: int, vocabulary: bytes) -> DataFrame:
    """The stored sequences of ``docs`` (text): part (the input partition), at (their number in it), ids (16-bit, little-endian)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent, pattern, end = spark.sparkContext.broadcast(vocabulary), bpe_pattern(), np.array([end_id], "<u2")

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for found in _sequences(batches, bpe_of(sent.value, pattern), length, end):
            yield pa.record_batch([pa.array([part] * len(found), pa.int64()), pa.array(np.arange(at, at + len(found))), pa.array(found, pa.binary())], names=["part", "at", "ids"])
            at += len(found)

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return staged(texts.mapInArrow(run, "part long, at long, ids binary"), "sequences", "zstd")


class Recoder:
    """A sequence's 16-bit ids for the shuffle: frequent ids take one byte, most others two, and the bytes are compressed.

    ``rank[id]`` is the id's place by frequency. One stream has a byte for each id, two more the rest of the rarer ones.
    """

    ONE, THREE = 224, 255

    def __init__(self, rank: np.ndarray):
        self.rank, self.id_of, self.codec = rank, np.argsort(rank).astype("<u2"), pa.Codec("zstd", 3)
        self.far = (self.THREE - self.ONE) << 8  # ranks from ONE on that take two bytes

    def pack(self, ids: bytes) -> bytes:
        rank = self.rank[np.frombuffer(ids, "<u2")].astype(np.int64)
        rest = rank - self.ONE
        first = np.where(rest < 0, rank, np.where(rest < self.far, self.ONE + (rest >> 8), self.THREE)).astype(np.uint8)
        second = rest[(rest >= 0) & (rest < self.far)].astype(np.uint8)
        data = first.tobytes() + second.tobytes() + rank[rest >= self.far].astype("<u2").tobytes()
        return len(data).to_bytes(4, "little") + self.codec.compress(data, asbytes=True)

    def unpack(self, packed: bytes, n: int) -> bytes:
        """The ``n`` ids of a packed sequence."""
        data = np.frombuffer(self.codec.decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True), np.uint8)
        first, rank = data[:n], data[:n].astype(np.int64)
        two, three = np.flatnonzero((first >= self.ONE) & (first < self.THREE)), np.flatnonzero(first == self.THREE)
        rank[two] = self.ONE + ((rank[two] - self.ONE) << 8) + data[n : n + len(two)]
        rank[three] = data[n + len(two) : n + len(two) + 2 * len(three)].view("<u2")
        return self.id_of[rank].tobytes()


def ranks(sequences: DataFrame) -> np.ndarray:
    """The place of each 16-bit id by its frequency in the stored sequences, ties by id."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in sequences.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most 65536 rows
        counts[row.id] = row.n
    rank = np.empty(1 << 16, np.uint16)
    rank[np.argsort(-counts, kind="stable")] = np.arange(1 << 16)
    return rank


def materialise(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, pad_id: int = 0, per_shard: int = 4096, key: int = 42, most_tasks: int = 10_000, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of whole ``docs`` (text) as shards of fixed-stride sequences in training order.

    Texts of an input partition follow each other, each closed by ``end_id``, and are cut every ``length``
    ids; a partition's last sequence is padded with ``pad_id``. The i-th sequence of all goes to slot
    ``feistel(i)``. Shard k, ``path/shard-k.bin``, holds slots k * per_shard on, ``2 * length`` bytes each
    (little-endian unsigned 16-bit ids), so slot s is at byte ``2 * length * (s % per_shard)`` of shard
    ``s // per_shard`` and a reader resumes anywhere. Ids must be below 65536; a vocabulary with others is refused.

    Returns a row for each sequence, as written: slot, sequence, shard, byte_offset, n_ids (without padding), ids_crc32
    (with it). Null text is empty (its end id remains); repeated rows are written each; an empty table
    writes nothing; other columns are ignored.

    Texts are encoded once, into a stored table of sequences, and counted there; so the numbers stand whatever
    order a second read of the input would have. Each of up to ``most_tasks`` tasks gets a range of shards, in
    slot order, known beforehand; nothing is sampled. A shard is written by one task under a name of its attempt
    and renamed when whole, so a lost executor leaves no half shard.
    """
    spark, stride, data = docs.sparkSession, 2 * length, bpe_file(vocabulary)
    if max(largest_id(data), end_id, pad_id) >= 1 << 16:
        raise ValueError("ids of 65536 and more do not fit 16 bits")
    sequences = encoded(docs, length, end_id, data)
    n, firsts = 0, {}
    for row in sequences.groupBy("part").agg((F.max("at") + 1).alias("n")).orderBy("part").collect():  # a number for each input partition
        firsts[row.part], n = n, n + row.n
    rank = spark.sparkContext.broadcast(ranks(sequences))  # 128 kB

    def place(batches):
        recoder = Recoder(rank.value)
        for batch in batches:
            sequence = np.fromiter(map(firsts.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows) + batch.column(1).to_numpy()
            slot, sizes = feistel(sequence, n, key), pc.binary_length(batch.column(2)).to_numpy() // 2
            packed = list(map(recoder.pack, batch.column(2).to_pylist()))
            yield pa.record_batch([pa.array(slot), pa.array(sequence), pa.array(slot // per_shard), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["slot", "sequence", "shard", "size", "ids"])

    pad = np.array([pad_id], "<u2").tobytes()

    def write(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(root, recursive=True)
        recoder, shard, out, name = Recoder(rank.value), None, None, ""

        def close():
            if out:
                out.close()
                store.move(name, f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            rows = []
            for slot, sequence, to, size, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if to != shard:
                    close()
                    shard, name = to, f"{root}/.shard-{to:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name, compression=None, buffer_size=1 << 20)
                ids = recoder.unpack(ids, size) + pad * (length - size)
                out.write(ids)
                rows.append((slot, sequence, to, stride * (slot % per_shard), size, zlib.crc32(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["slot", "sequence", "shard", "byte_offset", "n_ids", "ids_crc32"])
        close()

    placed = sequences.mapInArrow(place, "slot long, sequence long, shard long, size long, ids binary")
    shards = max(1, -(-n // per_shard))
    tasks = min(shards, most_tasks)
    ordered = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("slot")
    return ordered.mapInArrow(write, "slot long, sequence long, shard long, byte_offset long, n_ids long, ids_crc32 long")


def materialised(docs: DataFrame, name: str = "training-order", **parameters) -> DataFrame:
    """:func:`materialise` into the shared folder, done; returns the manifest."""
    return staged(materialise(docs, shared_path(docs.sparkSession, name), **parameters), f"{name}-manifest")
