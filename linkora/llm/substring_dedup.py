"""Exact substring dedup by blockwise sorting of truncated suffixes under a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Suffixes are
truncated to ``length`` bytes and taken in buckets that are sorted one at a time. A precomputed cover
sample decides beforehand which suffixes can tie at all: positions whose residue (from the text's start)
is in a difference cover D modulo v. Whatever residues two suffixes have, some shift d < v puts both on
the sample; if they agree on ``length`` bytes, the sampled positions agree on ``length - v + 1``. So the
ranks (equal or alone) of the sampled positions, v/|D| times fewer than suffixes, rule out all suffixes
without a tied sample in reach, and only the rest enters the buckets.

Within a bucket suffixes are ordered by a key of their truncated text, not by the text: equality alone
counts here, and the order among different suffixes does not. The key has 96 bits, of two independent
polynomials, so it confuses two different strings with probability n^2 / 2^97 over n compared suffixes
(6e-11 for 3e9 of them, all positions of 3 GB). The sample's keys are shorter; an error there costs work only.

The same is done over words for passages of more than 50 words that another document has too: they are
reported, not removed.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, splitmix64, staged
from .hashing import hashed_words

SEGMENT = 1 << 19


@functools.lru_cache(4)
def difference_cover(p: int = 13) -> tuple[int, tuple[int, ...]]:
    """(v, D): Singer's perfect difference set for a prime p, v = p^2 + p + 1 and p + 1 residues.

    The exponents i for which x^i has no square term, x being a root of a primitive cubic over GF(p).
    """
    v, order = p * p + p + 1, p**3 - 1
    for c in range(1, p):
        for b in range(p):
            for a in range(p):
                at, found = (1, 0, 0), []
                for i in range(order):
                    if i and at == (1, 0, 0):
                        break
                    if at[2] == 0:
                        found.append(i)
                    top = at[2]
                    at = (c * top % p, (at[0] + b * top) % p, (at[1] + a * top) % p)
                else:
                    return v, tuple(sorted({i % v for i in found}))
    raise ValueError("p must be prime")


BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


@functools.lru_cache(4)
def _tables(length: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, and powers of an odd base and of its inverse modulo 2^64."""
    values = splitmix64(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE + (which << 20))) | np.uint64(1)
    base = BASES[which]
    inverse, one = pow(base, -1, 1 << 64), np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((one, np.full(SEGMENT + length, base, np.uint64))), dtype=np.uint64)
        back = np.cumprod(np.concatenate((one, np.full(SEGMENT, inverse, np.uint64))), dtype=np.uint64)
    return values, powers, back


def window_keys(data: np.ndarray, length: int, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """The 64-bit key of ``data[s : s + length]`` (bytes, or words by their hashes) for each of the ascending ``starts``."""
    values, powers, back = _tables(length, which)
    out = np.empty(len(starts), np.uint64)
    bounds = np.searchsorted(starts, np.arange(0, len(data) + SEGMENT, SEGMENT))
    with np.errstate(over="ignore"):
        for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if low == high:
                continue
            part = data[k * SEGMENT : (k + 1) * SEGMENT + length - 1]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((values[part] if part.dtype == np.uint8 else splitmix64(part ^ np.uint64(which))) * powers[: len(part)], out=sums[1:])
            at = starts[low:high] - k * SEGMENT
            out[low:high] = (sums[at + length] - sums[at]) * back[at]
    return splitmix64(out)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Strings:
    """Strings of ``length`` units, bytes or words, in texts ``ends[i-1]`` to ``ends[i]`` of ``data``; of ``texts`` alone."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, texts: list[int], length: int, p: int):
        self.data, self.ends, self.length, (self.v, self.cover) = data, ends, length, difference_cover(p)
        self.starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.used = [i for i in texts if self.ends[i] - self.starts[i] >= length]
        self.width = length - self.v + 1

    def sample(self) -> np.ndarray:
        """All cover positions with ``width`` units left in their text."""
        longest = max((int(self.ends[i] - self.starts[i]) for i in self.used), default=0)
        grid = (np.arange(0, longest, self.v)[:, None] + np.array(self.cover)).ravel()
        parts = [self.starts[i] + grid[: np.searchsorted(grid, self.ends[i] - self.starts[i] - self.width, "right")] for i in self.used]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of all suffixes that hold one of the tied samples ``at`` at a shift below v and have ``length`` units."""
        if not len(at):
            return at
        text = self.text_of(at)
        low = np.maximum(self.starts[text], at - self.v + 1)
        high = np.minimum(at, self.ends[text] - self.length) + 1
        keep = high > low
        n = len(self.data) + 1
        depth = np.bincount(low[keep], minlength=n) - np.bincount(high[keep], minlength=n)
        return np.flatnonzero(np.cumsum(depth) > 0)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which units the strings at ``starts`` cover."""
        n = len(self.data) + 1
        depth = np.bincount(starts, minlength=n) - np.bincount(starts + self.length, minlength=n)
        return np.cumsum(depth)[:-1] > 0


class Ranks:
    """Keys of a block against all blocks: distinct ones go out by bucket, and come back as one bit each.

    ``check`` is the second part of a key, 32 bits of another polynomial; without it 56 bits of the first are sent.
    A key is tied here if two different ``owner`` (by default, two places) have it. ``kind`` keeps sorts of keys apart.
    """

    def __init__(self, keys: np.ndarray, bits: int, kind: int, check: np.ndarray | None = None, owner: np.ndarray | None = None):
        self.kind, self.bits, wide = kind, bits, check is not None
        keys = keys if wide else keys >> np.uint64(8)
        order = np.argsort(keys, kind="stable")
        if wide and len(keys) and ((keys[order][1:] == keys[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
            order = np.lexsort((check, keys))  # stable as well
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        if wide:
            check = check[order]
            new[1:] |= check[1:] != check[:-1]
        first = np.flatnonzero(new)
        last = np.append(first, len(keys))[1:] - 1
        self.here = order[first] != order[last] if owner is None else owner[order[first]] != owner[order[last]]
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.keys, self.checks = keys[first], check[first] if wide else None
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64((64 if wide else 56) - bits)
        self.edges = [0, *np.searchsorted(self.keys, bounds).tolist(), len(self.keys)]

    def outgoing(self) -> list[tuple[int, bytes]]:
        whole = self.keys.astype("<u8").view(np.uint8).reshape(-1, 8)
        rows = whole[:, :7] if self.checks is None else np.concatenate((whole, self.checks.astype("<u4").view(np.uint8).reshape(-1, 4)), axis=1)
        return [(self.kind << 24 | b, rows[low:high].tobytes()) for b, (low, high) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)) if high > low]

    def tied(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each key given, whether another owner, here or in another block, has it."""
        elsewhere = np.zeros(len(self.keys), bool)
        for bucket, mask in answers.items():
            if bucket >> 24 == self.kind:
                low, high = self.edges[bucket & 0xFFFFFF], self.edges[(bucket & 0xFFFFFF) + 1]
                elsewhere[low:high] = np.unpackbits(np.frombuffer(mask, np.uint8), count=high - low)
        return (self.here | elsewhere)[self.inverse]


class Block:
    """The texts of one block, those in ``skip`` (copies of a text elsewhere) left out of all sampling; as bytes and as words."""

    def __init__(self, row: dict, length: int, p: int, words: int, words_p: int, bits: int):
        data, lengths, skip = np.frombuffer(row["data"], np.uint8), np.array(row["lengths"], np.int64), set(row["skip"] or ())
        ends, texts, self.bits = np.cumsum(lengths), [i for i in range(len(lengths)) if i not in skip], bits
        place, hashes = hashed_words(data, _SPACES, ends - lengths)
        self.n_words = np.diff(np.searchsorted(place, np.concatenate(([0], ends))))
        self.bytes = Strings(data, ends, texts, length, p)
        self.words = Strings(hashes, np.cumsum(self.n_words), texts, words, words_p)

    def sample_ranks(self) -> list[tuple[np.ndarray, Ranks]]:
        out = []
        for kind, x in enumerate((self.bytes, self.words)):
            at = x.sample()
            out.append((at, Ranks(window_keys(x.data, x.width, at), self.bits, kind)))
        return out

    def suffix_ranks(self, answers: dict[int, bytes]) -> list[tuple[np.ndarray, Ranks]]:
        """Suffixes in reach of tied samples. Bytes tie wherever else they are, words in another text only."""
        out = []
        for kind, (x, (at, ranks)) in enumerate(zip((self.bytes, self.words), self.sample_ranks(), strict=True)):
            starts = x.candidates(at[ranks.tied(answers)])
            check = window_keys(x.data, x.length, starts, 1).astype(np.uint32)
            out.append((starts, Ranks(window_keys(x.data, x.length, starts), self.bits, kind, check, x.text_of(starts) if kind else None)))
        return out


def sort_bucket(rows: pa.Table, size: int) -> pa.Table:
    """Sort one bucket's keys (of ``size`` bytes) of all blocks; a bit for each: does another block have it?"""
    blocks, blobs = rows.column("block").to_pylist(), rows.column("keys").to_pylist()
    counts = [len(b) // size for b in blobs]
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, size)
    padded = np.zeros((len(raw), 8), np.uint8)
    padded[:, : min(8, size)] = raw[:, :8]
    keys = padded.view("<u8").ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if size > 8:
        check = np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
        if (same & (check[order][1:] != check[order][:-1])).any():
            order = np.lexsort((check, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (check[order][1:] == check[order][:-1])
    tied = np.zeros(len(keys), bool)
    tied[order[1:]] = same
    tied[order[:-1]] |= same
    masks = [np.packbits(x).tobytes() for x in np.split(tied, np.cumsum(counts)[:-1])]
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": rows.column("bucket"), "mask": pa.array(masks, pa.binary())})


BLOCKS = "block long, doc_ids array<long>, lengths array<int>, digests array<binary>, data binary"


def _blocks(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Texts in blocks, written once as a table bucketed by block: later passes join it without moving text.

    A block holds texts of one input partition, in order, up to ``block_bytes`` (a longer text is a block of its own).
    """
    spark = docs.sparkSession
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def batch_of(held):
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((block, [i for i, _ in held], [len(t) for _, t in held], [hashlib.sha256(t).digest() for _, t in held], b"".join(t for _, t in held)), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                if held and size + len(text) > block_bytes:
                    yield batch_of(held)
                    block, held, size = block + 1, [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield batch_of(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, BLOCKS)
    name = f"text_blocks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (block BIGINT, doc_ids ARRAY<BIGINT>, lengths ARRAY<INT>, digests ARRAY<BINARY>, data BINARY) USING parquet CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{shared_path(spark, 'text-blocks')}'")
    rows.write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _answers(listed: list | None) -> dict[int, bytes]:
    return {x["bucket"]: x["mask"] for x in listed or ()}


def _exchange(blobs: DataFrame, name: str, size: int) -> DataFrame:
    """(block, answers) from (block, bucket, keys): each bucket is sorted in one task, and answers by block."""

    def run(rows: pa.Table) -> pa.Table:
        return sort_bucket(rows, size)

    masks = blobs.groupBy("bucket").applyInArrow(run, "block long, bucket int, mask binary")
    return staged(masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias(name)), name)


def remove_repeats(docs: DataFrame, length: int = 400, p: int = 13, words: int = 51, words_p: int = 5, block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Remove from whole ``docs`` (doc_id, text) each byte inside a ``length``-byte string that also starts elsewhere.

    Returns a row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (of the remaining bytes), n_shared_words (words inside a run of ``words`` that another row has too, however
    many bytes it has). Texts are UTF-8 bytes, null ones empty; strings never cross texts; overlaps count; all is
    judged on the input. Texts below ``length`` lose nothing; repeated rows are copies of each other and lose all
    (from ``length`` bytes on); an empty table gives no rows; other columns are ignored.

    Equal texts are found first, by digest: one of them stands for all in what follows. A block sends each
    distinct key once, so a passage in many texts costs a bucket one key for each block. A task holds one
    block or one bucket of about ``bucket_bytes`` keys; text moves once, into the blocks. A text longer than
    ``block_bytes`` is a block of its own and needs up to a hundred times its bytes of memory where it repeats.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 2000)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = max(4, (total // bucket_bytes).bit_length())
    blocks = _blocks(docs, block_bytes, max(1, min(10_000, -(-total // (8 * block_bytes)))))
    if length < 2 * difference_cover(p)[0] or words <= difference_cover(words_p)[0]:
        raise ValueError("the cover's period is too long for the strings")

    texts = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "digests", "lengths")).alias("at", "x")).select("block", "at", F.col("x.doc_ids").alias("doc_id"), F.col("x.digests").alias("digest"), F.col("x.lengths").alias("n_bytes"))
    texts = staged(texts, "texts")
    firsts = staged(texts.groupBy("digest").agg(F.min(F.struct("block", "at")).alias("first"), F.count("*").alias("copies")).select("digest", "copies", F.col("first.block").alias("block"), F.col("first.at").alias("at")), "first-texts")
    copied = firsts.filter("copies > 1").select("digest", F.col("block").alias("first_block"), F.col("at").alias("first_at"))
    skips = texts.join(copied, "digest").filter("block <> first_block or at <> first_at").groupBy("block").agg(F.collect_list("at").alias("skip"))
    skips = staged(skips, "skips")

    def blocks_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row, Block(row, length, p, words, words_p, bits)

    def sent(block: int, found: list[tuple[np.ndarray, Ranks]]) -> pa.RecordBatch:
        out = [x for _, ranks in found for x in ranks.outgoing()]
        return pa.record_batch([pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([k for _, k in out], pa.binary())], names=["block", "bucket", "keys"])

    def sample_out(batches):
        for row, block in blocks_of(batches):
            yield sent(row["block"], block.sample_ranks())

    def suffixes_out(batches):
        for row, block in blocks_of(batches):
            yield sent(row["block"], block.suffix_ranks(_answers(row["sample"])))

    def result(batches):
        for row, block in blocks_of(batches):
            answers = _answers(row["suffixes"])
            gone, shared = (x.covered(starts[ranks.tied(answers)]) for x, (starts, ranks) in zip((block.bytes, block.words), block.suffix_ranks(_answers(row["sample"])), strict=True))
            in_text = np.concatenate(([0], np.cumsum(shared)))
            in_text = in_text[block.words.ends] - in_text[block.words.starts]
            out = []
            for i, (low, high) in enumerate(zip(block.bytes.starts.tolist(), block.bytes.ends.tolist(), strict=True)):
                cut = gone[low:high]
                n = int(cut.sum())
                kept = block.bytes.data[low:high][~cut] if n else block.bytes.data[low:high]
                spans = int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)) if n else 0
                out.append((row["block"], i, n, spans, hashlib.sha256(kept.tobytes()).hexdigest(), int(block.n_words[i]), int(in_text[i])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "at", "n_removed", "n_spans", "kept_sha256", "n_words", "n_shared_words"])

    def beside(*more: DataFrame) -> DataFrame:
        out = blocks.select("block", "lengths", "data")
        for x in more:
            out = out.join(x.hint("shuffle_hash"), "block", "left")
        return out

    sample = _exchange(beside(skips).mapInArrow(sample_out, "block long, bucket int, keys binary"), "sample", 7)
    suffixes = _exchange(beside(skips, sample).mapInArrow(suffixes_out, "block long, bucket int, keys binary"), "suffixes", 12)
    found = beside(skips, sample, suffixes).mapInArrow(result, "block long, at int, n_removed long, n_spans long, kept_sha256 string, n_words long, n_shared_words long")
    by_digest = firsts.join(found, ["block", "at"]).drop("block", "at")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return texts.join(staged(by_digest, "results"), "digest").select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.when(whole, F.col("n_bytes").cast("long")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.col("n_shared_words")).alias("n_shared_words"),
    )
