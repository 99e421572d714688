"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings of every word of the corpus and is stored once, for any number of test sets. It
is divided by document: a row is a segment, the inverted lists of a batch of documents, so building it
shuffles nothing. A search sends the test windows, in blocks of a bounded size, to the segments; each window's lists
are intersected, offset-adjusted, from its rarest term on. Terms are 64-bit hashes of words: of n different
words two share one with probability n^2 / 2^65, and a window of several words needs as many such accidents.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .hashing import hashed_words
from .workers import held, tidy

#: A-Z to a-z; every ASCII byte that is no letter or digit to a space; bytes over 0x7F belong to words.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_FOLDED = np.frombuffer(WORD_TABLE, np.uint8)
_OUTSIDE = np.arange(256) == 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all words of an array of binary texts, bounds of the texts in them); null has none."""
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    places, terms = hashed_words(_FOLDED[data], _OUTSIDE, offsets[:-1] - offsets[0])
    return terms, np.searchsorted(places, offsets - offsets[0])


@dataclass
class TestSet:
    """Windows over a vocabulary of ascending terms: ``terms[i]`` is a window's places in it, ``items[i]`` the items it comes from."""

    vocabulary: np.ndarray
    terms: list[tuple[int, ...]]
    items: list[list[str]]


def windows_of(benchmark: DataFrame, length: int = 13, most_bytes: int = 4 << 20) -> Iterator[TestSet]:
    """The distinct windows of ``length`` words of all items (item_id, text); an item of fewer words is one window.

    Items are taken in blocks of ``most_bytes`` of text, a test set each and one at a time, so that what the driver
    holds and the executors get is bounded (by a block and one item). Items without words have no window.
    """
    size, windows = 0, {}

    def closed() -> TestSet:
        vocabulary = np.unique(np.fromiter((t for w in windows for t in w), np.uint64))
        return TestSet(vocabulary, [tuple(np.searchsorted(vocabulary, np.array(w, np.uint64)).tolist()) for w in windows], [sorted(x) for x in windows.values()])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        terms = terms_of(pa.array([row.text and bytes(row.text)], pa.binary()))[0].tolist()
        if not terms:
            continue
        for at in range(max(1, len(terms) - length + 1)):
            windows.setdefault(tuple(terms[at : at + length]), set()).add(row.item_id)
        size += len(row.text)
        if size >= most_bytes:
            yield closed()
            size, windows = 0, {}
    if windows:
        yield closed()


INDEX = "doc_ids array<long>, rows array<long>, n_words array<long>, terms binary, counts binary, places binary"


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of whole ``docs`` (doc_id, text): a row for each segment, whose documents have numbers of their own in ``rows``.

    ``terms`` are a segment's terms, ascending (64 bits), ``counts`` the lengths of their lists and ``places`` the
    lists (32 bits, little-endian): ascending word numbers, counted through the segment's documents, as differences.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            terms, bounds = terms_of(batch.column(2))
            order = np.argsort(terms, kind="stable")
            known, first, counts = np.unique(terms[order], return_index=True, return_counts=True)
            places = np.diff(order, prepend=0)
            places[first] = order[first]
            columns = [[batch.column(0).to_pylist()], [batch.column(1).to_pylist()], [np.diff(bounds).tolist()], [known.astype("<u8").tobytes()], [counts.astype("<i4").tobytes()], [places.astype("<i4").tobytes()]]
            types = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_ids", "rows", "n_words", "terms", "counts", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    return staged(rows.mapInArrow(tidy(run), INDEX), "index", "zstd")


def documents(index: DataFrame) -> DataFrame:
    """doc_id, row and n_words of the documents of an index."""
    rows = index.select(F.explode(F.arrays_zip("doc_ids", "rows", "n_words")).alias("x"))
    return rows.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.rows").alias("row"), F.col("x.n_words").alias("n_words"))


def _found(vocabulary: np.ndarray, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``vocabulary`` a segment has, where among its terms)."""
    own = np.frombuffer(terms, "<u8")
    at = np.minimum(np.searchsorted(own, vocabulary), len(own) - 1)
    which = np.flatnonzero(own[at] == vocabulary) if len(own) else np.zeros(0, np.int64)
    return which, at[which]


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a test set occurs in the whole index; lists are not read."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                which, at = _found(sent.value, terms)
                total[which] += np.frombuffer(counts, "<i4")[at]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms", "counts").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


@dataclass
class Plan:
    """A test set's windows as arrays: terms and offsets of each from its rarest term on (padded by the last)."""

    vocabulary: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray
    items: list[list[str]]
    by_rarest: np.ndarray
    starts: np.ndarray


def plan_of(tests: TestSet, counts: np.ndarray) -> Plan:
    lengths = np.array([len(t) for t in tests.terms], np.int64)
    width = int(lengths.max())
    terms, offsets = np.zeros((len(lengths), width), np.int32), np.zeros((len(lengths), width), np.int32)
    for i, window in enumerate(tests.terms):
        order = sorted(range(len(window)), key=lambda k: (counts[window[k]], k))
        order += [order[-1]] * (width - len(order))
        terms[i], offsets[i] = [window[k] for k in order], order
    by_rarest = np.argsort(terms[:, 0], kind="stable")
    starts = np.searchsorted(terms[by_rarest, 0], np.arange(len(tests.vocabulary) + 1))
    return Plan(tests.vocabulary, lengths, terms, offsets, tests.items, by_rarest, starts)


def intersect(plan: Plan, terms: np.ndarray, places: np.ndarray, span: int, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) wherever all its terms stand within ``slop`` words of where the phrase has them.

    Without slop these are the exact phrases. Postings are sorted by (term, place), places below ``span``.
    """
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # every posting of a term that is some window's rarest, once for each such window
    per_posting = plan.starts[terms + 1] - plan.starts[terms]
    posting = np.repeat(np.arange(len(terms)), per_posting)
    within = np.arange(len(posting)) - np.repeat(np.cumsum(per_posting) - per_posting, per_posting)
    window, place = plan.by_rarest[plan.starts[terms[posting]] + within], places[posting]
    key = terms.astype(np.int64) * span + places
    for k in range(1, plan.terms.shape[1]):
        if not len(window):
            break
        wanted = plan.terms[window, k].astype(np.int64) * span + place - plan.offsets[window, 0] + plan.offsets[window, k]
        at = np.searchsorted(key, wanted - slop)
        keep = key[np.minimum(at, len(key) - 1)] - wanted
        keep = (keep >= -slop) & (keep <= slop)
        window, place = window[keep], place[keep]
    return window, place


HITS = "row long, items array<string>, spans array<struct<start:long,stop:long>>, near array<struct<item:string,place:long>>"
_SPANS, _NEAR = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.struct([("item", pa.string()), ("place", pa.int64())]))


def _by_document(first: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, which of ``places`` are in it)."""
    order = np.argsort(places, kind="stable")
    doc = np.searchsorted(first, places[order], "right") - 1
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(np.searchsorted(first, places[part[0]], "right") - 1), part


def search(index: DataFrame, tests: TestSet, slop: int = 3) -> DataFrame:
    """Look up a test set in ``index``. Returns a row for each document with a match: row, items, spans, near.

    ``spans`` are the maximal runs [start, stop) of words inside exact windows, ``items`` the items with occurring
    windows, sorted as strings. ``near`` are the places of the rarest terms of windows all of whose terms stand
    within ``slop`` words of where the phrase has them, with the windows' items (exact phrases among them).
    """
    sent = index.sparkSession.sparkContext.broadcast(pickle.dumps(plan_of(tests, term_counts(index, tests.vocabulary))))

    def matches(plan: Plan, rows, n_words, terms, counts, places):
        which, at = _found(plan.vocabulary, terms)
        counts, gap = np.frombuffer(counts, "<i4").astype(np.int64), int(plan.lengths.max()) + slop + 1  # a gap between two documents, so no window spans both
        stops = np.cumsum(counts)
        n = counts[at]
        if not len(n):
            return
        lists = np.frombuffer(places, "<i4").astype(np.int64)
        lists = lists[np.repeat(stops[at] - np.cumsum(n), n) + np.arange(n.sum())]
        ends = np.cumsum(n)
        sums = np.cumsum(lists)
        p = sums - np.repeat(np.concatenate(([0], sums[ends[:-1] - 1])), n)
        t = np.repeat(which, n)
        base = np.cumsum(n_words) - n_words  # each document's first word, here and with the gaps
        spread = base + gap * np.arange(len(base))
        p = p + gap * (np.searchsorted(base, p, "right") - 1 if (n_words > 0).all() else _owner(base, n_words, p))
        span = int(spread[-1] + n_words[-1] + 2 * gap)
        found: dict[int, list] = {}
        window, place = intersect(plan, t, p, span)
        start = place - plan.offsets[window, 0]
        for d, part in _by_document(spread, start):
            a, w = start[part] - spread[d], window[part]
            stop, edges = np.maximum.accumulate(a + plan.lengths[w]), []
            new = np.flatnonzero(np.concatenate(([True], a[1:] > stop[:-1])))
            edges = zip(a[new].tolist(), stop[np.append(new, len(a))[1:] - 1].tolist(), strict=True)
            found[d] = [sorted({x for k in np.unique(w).tolist() for x in plan.items[k]}), [{"start": x, "stop": y} for x, y in edges], []]
        window, place = intersect(plan, t, p, span, slop)
        for d, part in _by_document(spread, place):
            pairs = sorted({(x, y) for k, y in zip(window[part].tolist(), (place[part] - spread[d]).tolist(), strict=True) for x in plan.items[k]})
            found.setdefault(d, [[], [], []])[2] = [{"item": x, "place": y} for x, y in pairs]
        for d, out in found.items():
            yield rows[d], *out

    def run(batches):
        plan = held(pickle.loads, sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, n_words, terms, counts, places = (c[i].as_py() for c in batch.columns)
                out = list(zip(*matches(plan, rows, np.array(n_words, np.int64), terms, counts, places), strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.string()), _SPANS, _NEAR), strict=True)], names=["row", "items", "spans", "near"])

    return index.select("rows", "n_words", "terms", "counts", "places").mapInArrow(tidy(run, model=True), HITS)


def _owner(base: np.ndarray, n_words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which document has each word number; those without words own none."""
    own = np.flatnonzero(n_words > 0)
    return own[np.searchsorted(base[own], places, "right") - 1]


def _gathered(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, share: float = 0.05, slop: int = 3, most_bytes: int = 4 << 20, index: DataFrame | None = None) -> DataFrame:
    """Words of whole ``docs`` (doc_id, text) inside windows of ``benchmark`` (item_id, text).

    Returns a row for each input row: doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and
    n_hit >= share * n_words), n_near (places with a proximity match, see :func:`search`) and what they rest on:
    items, spans (of each block of test items), near. Null texts have no words; repeated rows get a row each; an empty
    table gives no rows, an empty benchmark no hits; other columns are ignored.

    The index is built once (or given: :func:`build_index` of the same documents); each block of test items (see
    :func:`windows_of`) is one search of it, and only matches are joined to the documents.
    """
    bounded_batches(docs.sparkSession)
    index = build_index(docs) if index is None else index
    parts = [staged(search(index, tests, slop), "matches") for tests in windows_of(benchmark, length, most_bytes)]
    parts = parts or [docs.sparkSession.createDataFrame([], HITS)]
    hits = functools.reduce(DataFrame.unionByName, parts).groupBy("row").agg(_gathered("items"), _gathered("spans"), _gathered("near"))
    found = documents(index).join(hits, "row", "left").withColumns({c: F.coalesce(c, F.array().cast(dict(hits.dtypes)[c])) for c in ("items", "spans", "near")})
    # spans of different blocks may overlap: each adds what is beyond all before it
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'at', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.stop - greatest(x.start, a.at)), 'at', greatest(a.at, x.stop)), a -> a.n)")
    found = found.withColumns({"n_hit": n_hit, "n_near": F.size(F.array_distinct(F.transform("near", lambda x: x.place))).cast("long")})
    inverse = round(1 / share)
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (inverse * F.col("n_hit") >= F.col("n_words"))})
