"""Near duplicates by exact Jaccard similarity of word shingles, checked on what SimHash links and on what shares a MinHash band.

Rows that SimHash links, and rows that share a band, are a group. A group of any size is compared in two steps, neither of which holds it
in one task: each row with the group's centre, then, where that leaves a group in several parts, the rows
apart from the centre's part with all others, in tiles of a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, splitmix64, staged
from .components import components
from .hashing import hashed_words
from .rows import NumberedRows
from .simhash import SEED, forest
from .workers import tidy

#: Two sets of Jaccard 0.8 meet in none of the bands with probability (1 - 0.8**5)**32, 3e-6; closer ones less often.
BANDS, ROWS = 32, 5
_DRAWN = splitmix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) ^ np.uint64(SEED << 32)).astype(np.uint32)
FACTORS, OFFSETS = (_DRAWN[: BANDS * ROWS] | np.uint32(1))[:, None], _DRAWN[BANDS * ROWS :][:, None]

#: A-Z to a-z; words are runs of other bytes than space and \\x09-\\x0D, as in simhash.fingerprint.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _chained(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of ``words`` words."""
    out = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        out = splitmix64(out ^ hashes[k : k + len(out)])
    return out


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word shingles; a text of fewer words is one shingle, one without none."""
    texts = [t or b"" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1])) if texts else ends
    place, hashes = hashed_words(_FOLDED[np.frombuffer(b"".join(texts), np.uint8)], _SPACES, starts)
    bounds = np.searchsorted(place, np.append(starts, ends[-1:])).tolist()
    chained, out = _chained(hashes, words), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.sort(chained[a : b - words + 1] if b - a >= words else _chained(hashes[a:b], b - a) if b > a else hashes[:0])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: of ``ROWS`` least values, each under a hash of its own."""
    least, values = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (FACTORS * values[at : at + 1024] + OFFSETS).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = splitmix64(key ^ column)
    return key


def links_of(sets: list[np.ndarray], share: int = 80, most: int = 256) -> list[tuple[int, int]]:
    """Pairs of places whose sets have a Jaccard similarity of at least ``share`` hundredths; of many sets a forest of them."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        if 100 * sizes.min() < share * sizes.max():
            return []
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= share * (sizes.sum() - both) else []
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    out: list[tuple[int, int]] = []
    for low in range(0, len(sets), most):
        # rows low.. of the matrix of intersection sizes, summed over blocks of shingles
        high = min(low + most, len(sets))
        common = np.zeros((high - low, len(sets)), np.float32)
        for first in range(0, len(values), 1024):
            a, b = np.searchsorted(ids, (first, first + 1024))
            which, row = np.unique(owner[a:b], return_inverse=True)
            own = np.flatnonzero((which >= low) & (which < high))
            if len(own):
                has = np.zeros((len(which), 1024), np.float32)
                has[row, ids[a:b] - first] = 1
                common[np.ix_(which[own] - low, which)] += has[own] @ has.T
        # exact in 64 bits: 100 * common >= share * (both sizes - common)
        x, y = np.nonzero((100 + share) * common.astype(np.int64) >= share * (sizes[low:high, None] + sizes[None, :]))
        found = np.stack([x + low, y], axis=1)
        out = forest(np.concatenate([np.array(out, np.int64).reshape(-1, 2), found[found[:, 0] < found[:, 1]]]))
    return out


def prints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(row, doc_id, digest of the set of shingles, bands) of ``docs`` (row, doc_id, text); null text has no shingles."""
    bounded_batches(docs.sparkSession, 1000, 8)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([band_keys(x) for x in sets] or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), bands], names=["row", "doc_id", "digest", "bands"])

    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "row long, doc_id long, digest binary, bands array<long>")


def band_groups(bands: DataFrame) -> DataFrame:
    """(key, row, centre): the rows of the bands that several rows of ``bands`` (row, bands) share, and the group's least row.

    Rows are counted before the shuffle, and the join back can be split at a hot key. Groups of the same rows (as the
    number, the least and two hashes of them tell) are one.
    """
    spread = bands.select(F.explode("bands").alias("key"), "row")
    groups = spread.groupBy("key").agg(F.min("row").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = staged(spread.join(groups.hint("merge"), "key").select("key", "row", "centre"), "band-members")
    hashes = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    signs = members.groupBy("key").agg(F.min("centre").alias("centre"), F.count("*").alias("n"), *hashes)
    return staged(members.join(signs.groupBy("centre", "n", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "members")


def with_groups(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """``bands`` (row, bands) with one band more: the component of the row in ``groups`` (doc_id, component_id), as :func:`simhash.near_duplicates` gives it for numbered rows."""
    own = groups.select(F.col("doc_id").alias("row"), F.xxhash64("component_id", F.lit("simhash")).alias("own"))
    return bands.join(own, "row").select("row", F.concat("bands", F.array("own")).alias("bands"))


def star_tiles(members: DataFrame, block: int) -> DataFrame:
    """(tile, row, first): each row with a centre of its groups, which is first; a centre of more than ``block`` rows has several tiles."""
    pairs = members.filter("row <> centre").select("row", "centre").distinct()
    counts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("tiles"))
    tile = lambda place: F.xxhash64("centre", place).alias("tile")
    centres = counts.select(F.col("centre").alias("row"), "centre", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("place"))
    others = pairs.join(counts, "centre").withColumn("place", F.pmod(F.xxhash64("row", F.lit(3)), F.col("tiles")).cast("int"))
    return centres.select(tile("place"), "row", F.lit(True).alias("first")).unionByName(others.select(tile("place"), "row", F.lit(False).alias("first")))


def linked_in_tiles(tiles: DataFrame, texts: DataFrame, hundredths: int, words: int) -> DataFrame:
    """(a, b) links of each of ``tiles`` (tile, row, first), whose rows one task holds: with its first row alone if it has one, else a forest of all."""

    def linked(batches):
        held, rows, sets, star = None, [], [], False

        def close():
            if len(rows) < 2:
                return []
            if star:
                return [(rows[i], rows[0]) for i in range(1, len(rows)) if links_of([sets[0], sets[i]], hundredths)]
            return [(rows[x], rows[y]) for x, y in links_of(sets, hundredths)]

        def batch_of(out):
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            out = []
            own = shingle_sets(batch.column(3).to_pylist(), words)
            for at, row, first, found in zip(*(batch.column(i).to_pylist() for i in range(3)), own, strict=True):
                if at != held:
                    out += close()
                    held, rows, sets, star = at, [], [], first
                rows.append(row)
                sets.append(found)
            yield batch_of(out)
        yield batch_of(close())

    held = tiles.join(texts.hint("merge"), "row").select("tile", "row", "first", F.col("text").cast("string").cast("binary").alias("text"))
    return held.repartition("tile").sortWithinPartitions("tile", F.desc("first"), "row").mapInArrow(tidy(linked), "a long, b long")


def rest_tiles(members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(tile, row, first) of the rows that share a band and are not yet in one part (``roots``: node, root).

    In each group the rows outside the centre's part meet each other and all of that part, in tiles of at most about
    two ``block`` rows: a row is sent once for each block of the rows outside, a row outside once for each block of the group.
    """
    part = lambda name: F.coalesce(F.col(f"{name}_root"), F.col(name))
    for name in ("row", "centre"):
        members = members.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), name, "left")
    members = staged(members.select("key", "row", (part("row") != part("centre")).alias("apart")), "parts")
    counts = members.groupBy("key").agg(F.count_if("apart").alias("n_apart"), F.count_if(~F.col("apart")).alias("n_main")).filter("n_apart > 0")
    rows = members.join(counts, "key")
    blocks = {x: F.ceil(F.col(f"n_{x}") / block).cast("int") for x in ("apart", "main")}
    place = lambda x: F.pmod(F.xxhash64("row", F.lit(3)), blocks[x]).cast("int")
    every = lambda x: F.sequence(F.lit(0), blocks[x] - 1)
    tile = lambda kind, low, high: F.xxhash64("key", F.lit(kind), low, high)
    outer = F.concat(F.transform(every("main"), lambda j: tile("main", place("apart"), j)), F.transform(every("apart"), lambda j: tile("apart", F.least(place("apart"), j), F.greatest(place("apart"), j))))
    inner = F.transform(every("apart"), lambda i: tile("main", i, place("main")))
    return rows.select("row", F.explode(F.when(F.col("apart"), outer).otherwise(inner)).alias("tile")).select("tile", "row", F.lit(False).alias("first"))


def similar_roots(bands: DataFrame, texts_of: Callable[[DataFrame], DataFrame], share: float = 0.8, words: int = 5, block: int = 1024) -> DataFrame:
    """(node, root) of the rows of ``bands`` (row, bands) that are linked, over others, to a smaller row.

    ``texts_of`` gives (row, text) of rows; only the candidates' texts are sent, and shingled again where they meet.
    """
    hundredths = round(100 * share)
    members = band_groups(bands)
    texts = staged(texts_of(members.select("row").distinct()), "candidates", "zstd")
    as_edges = lambda x: x.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(as_edges(linked_in_tiles(star_tiles(members, block), texts, hundredths, words)))
    links = staged(linked_in_tiles(staged(rest_tiles(members, roots, block), "tiles"), texts, hundredths, words).distinct(), "links")
    return roots if links.isEmpty() else components(as_edges(links).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def repeats(docs: NumberedRows, groups: DataFrame, share: float = 0.8, words: int = 5) -> DataFrame:
    """(row): the numbers of the rows of whole ``docs`` (doc_id, text) that go as near duplicates.

    Candidates are the rows that SimHash links over others (``groups``: doc_id, the row's number, and component_id) and those that share a band.
    They are linked where their sets of shingles of ``words`` words have a Jaccard similarity of at least ``share``,
    which is computed from the sets. Of each group of linked rows the one of the smallest doc_id stays, null ids last;
    of rows that share it, one. Rows of equal sets are one class before anything is compared; texts without words, null
    ones too, are one class. An empty table gives no rows; other columns are ignored.
    """
    sets = staged(prints(docs.rows.select(F.col(docs.number).alias("row"), "doc_id", "text"), words), "prints")
    classes = staged(sets.groupBy("digest").agg(F.min("row").alias("node")), "classes")
    firsts = sets.join(classes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")
    roots = similar_roots(with_groups(firsts.select("row", "bands"), groups), docs.texts, share, words)
    named = classes.join(roots, classes.node == roots.node, "left").select("digest", F.coalesce("root", classes.node).alias("root"))
    rows = staged(sets.select("row", "doc_id", "digest").join(named.hint("merge"), "digest").select("row", "doc_id", "root"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "row")
    stays = rows.groupBy("root").agg(F.min(order)["row"].alias("stays"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(stays, "root").filter("row <> stays").select("row")
