"""SimHash near-dedup by anchor-point covering: fingerprints meet at the codewords of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, splitmix64, staged
from .components import components
from .workers import tidy

#: Each half of a fingerprint is covered by the [31,26] Hamming code (radius 1) and one free bit.
HALF, CODE = 32, 31
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of the text's word shingles. A bit is set if it is set in over half the shingles' hashes."""
    tokens = text.lower().split()  # of bytes: A-Z only, and exactly space and \\x09-\\x0D
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: len(tokens) - words])).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    low, high = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    at = np.arange(1 << 16)
    for i in range(CODE):
        (low if i < 16 else high)[(at >> (i % 16)) & 1 == 1] ^= i + 1
    return low, high


LOW, HIGH = _syndromes()


def error_patterns(radius: int) -> list[list[int]]:
    """For each syndrome, all errors of at most ``radius`` (up to 2) bits that lead from a word to a codeword."""
    out: list[list[int]] = [[0]] + [[1 << (s - 1)] if radius else [] for s in range(1, 32)]
    if radius == 2:
        for s in range(1, 32):
            out[s] += [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s]
    return out


NEAR, NEXT = error_patterns(2), error_patterns(1)


def anchors(fps: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) rows of all anchors within covering radius 1 plus 1 bit of a half; anchors as int64 keys.

    Of fingerprints with at most 3 bits apart one half has at most 1 bit apart; that half's nearest
    codeword of the one is then among the anchors of the other.
    """
    word = (fps >> np.uint64(HALF * half)).astype(np.uint32)
    syndrome = LOW[word & np.uint32(0xFFFF)] ^ HIGH[word >> np.uint32(16) & np.uint32(0x7FFF)]
    keys, rows = [], []
    for s in range(32):
        which = np.flatnonzero(syndrome == s)
        for error in NEAR[s] + [e | 1 << CODE for e in NEXT[s]]:
            keys.append((word[which] ^ np.uint32(error)).astype(np.int64) | np.int64(half << HALF))
            rows.append(fps[which])
    return np.concatenate(keys), np.concatenate(rows)


def links_within(fps: np.ndarray, bits: int, width: int = 16, small: int = 2048) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints are within ``bits`` bits: a forest, not all pairs.

    A large group is first split by each of its 16-bit blocks: with at most 3 bits apart, one of four agrees.
    """
    if len(fps) > small and bits < 64 // width:
        out = []
        for at in range(0, 64, width):
            block = (fps >> np.uint64(at)).astype(np.uint16)
            order = np.argsort(block, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(block[order])) + 1):
                if len(part) > 1:
                    out += links_within(part, bits, width, len(part))
        return out
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            found, rest = rest[near], rest[~near]
            out += [(int(at), int(x)) for x in found]
            queue.extend(found)
    return out


def _pairs_of_small_groups(key: np.ndarray, fps: np.ndarray, most: int, bits: int) -> np.ndarray:
    """Links between neighbours up to ``most`` places apart among rows sorted by key."""
    out = []
    for shift in range(1, min(most, len(key))):
        same = key[shift:] == key[:-shift]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= bits]
        out.append(np.stack([fps[at], fps[at + shift]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def compare_per_anchor(key: np.ndarray, fps: np.ndarray, bits: int, small: int = 48) -> np.ndarray:
    """Links (rows of two fingerprints) among those that share an anchor; a forest for each anchor's large group."""
    order = np.argsort(key, kind="stable")
    key, fps = key[order], fps[order]
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(bounds)
    large = sizes > small
    in_large = np.repeat(large, sizes)
    out = [_pairs_of_small_groups(key[~in_large], fps[~in_large], small, bits)]
    for a, n in zip(bounds[:-1][large].tolist(), sizes[large].tolist(), strict=True):
        found = links_within(np.unique(fps[a : a + n]), bits)
        if found:
            out.append(np.array(found, dtype=np.uint64))
    return np.concatenate(out)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two parts that were apart so far."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    for a, b in links.tolist():
        if (ra := root(a)) != (rb := root(b)):
            parent[ra] = rb
            out.append((a, b))
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of whole texts; fp is the fingerprint as a signed 64-bit value. Null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) if t else 0 for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _sub_keys(anchor: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four rows for each: the anchor mixed with each 16-bit block of the fingerprint, one of which a pair within 3 bits shares."""
    keys = [splitmix64(anchor.view(np.uint64) ^ splitmix64((fps >> np.uint64(at)) & np.uint64(0xFFFF) | np.uint64(at << 32))) for at in range(0, 64, 16)]
    return np.concatenate(keys).view(np.int64), np.tile(fps, 4)


def near_links(classes: DataFrame, bits: int = 3, heavy: int = 50_000, per_task: int = 20_000_000, at_once: int = 500_000) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that connect all within ``bits`` (at most 3) bits.

    An anchor of over ``heavy`` fingerprints is divided by the fingerprints' 16-bit blocks before it is compared,
    so that it is spread over tasks; with at most 3 bits apart one of four blocks agrees. A task gets about ``per_task``
    rows of 16 bytes, sorted by anchor, and holds ``at_once`` of them or the rows of one anchor.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the covering holds for up to 3 bits")

    def replicate(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                keys, rows = anchors(fps, half)
                yield pa.record_batch([pa.array(keys), pa.array(rows.view(np.int64))], names=["anchor", "fp"])

    def divide(batches):
        for batch in batches:
            keys, fps = _sub_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(fps.view(np.int64))], names=["anchor", "fp"])

    def compare(batches):
        # rows come sorted by anchor: whole anchors are compared, the last one waits for more rows
        keys, fps, n = [], [], 0

        def links(key, fp):
            found = np.array(forest(compare_per_anchor(key, fp, bits)), dtype=np.uint64).reshape(-1, 2)
            return pa.record_batch([pa.array(found[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            n += len(keys[-1])
            if n >= at_once:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield links(key[:whole], fp[:whole])
                keys, fps, n = [key[whole:]], [fp[whole:]], len(key) - whole
        if n:
            yield links(np.concatenate(keys), np.concatenate(fps))

    n_classes, spark = classes.count(), classes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-34 * n_classes // per_task))

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(compare), "a long, b long")

    spread = classes.select("fp").mapInArrow(tidy(replicate), "anchor long, fp long")
    if n_classes <= heavy:  # no anchor can hold more
        return compared(spread)
    many = staged(spread.groupBy("anchor").count().filter(F.col("count") > heavy).select("anchor"), "heavy-anchors")
    if many.isEmpty():
        return compared(spread)
    light, dense = spread.join(many, "anchor", "left_anti"), spread.join(many, "anchor", "left_semi")
    return compared(light).unionByName(compared(dense.mapInArrow(tidy(divide), "anchor long, fp long")))


def near_duplicates(docs: DataFrame, bits: int = 3, words: int = 3) -> DataFrame:
    """Group whole ``docs`` (doc_id, text) by linked fingerprints.

    Returns a row for each input row: doc_id, fp (signed 64-bit), fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links of at most ``bits`` bits). Texts without words, null ones too, have
    fingerprint 0 and are linked like others. Null ids take their component's id; repeated rows fall
    together; an empty table gives no rows; other columns are ignored.

    Equal fingerprints are one class before anything is compared, so copies cost one row; only a forest of
    links leaves an anchor.
    """
    fps = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = staged(near_links(classes, bits).distinct(), "links")
    # links between classes as links between their smallest ids; a class of null ids alone has none to give
    ids = classes.filter("least is not null")
    edges = found.join(ids.select(F.col("fp").alias("a"), F.col("least").alias("u")), "a").join(ids.select(F.col("fp").alias("b"), F.col("least").alias("v")), "b").select("u", "v")
    roots = components(edges)
    named = classes.join(roots, classes.least == roots.node, "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
