"""Language ID by cross-parsing: longest matches in a suffix automaton of each language's labelled text.

A text is cut greedily into phrases, each the longest string that occurs in a language's training text; the
language that needs the fewest, each weighed by the bits that point into its training text, wins. Phrases
run over whole texts and do not mind where words end. Texts are parsed as UTF-8 bytes, so transition tables stay
small for any script, and all blocks of a batch of texts are parsed in step.
"""

from __future__ import annotations

import functools
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import bounded_batches
from .workers import held, tidy

UNDETERMINED = "und"
#: Phrases end where a block of so many bytes of a text ends.
BLOCK = 2048
MARKS = range(0x300, 0x370)


class SuffixAutomaton:
    """The smallest automaton of all substrings of the added texts. ``next[state]``: character (or byte) -> state."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self._link, self._length = [-1], [0]

    def add(self, text: str | bytes) -> None:
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c: str | int) -> int:
        nxt, link, length = self.next, self._link, self._length

        def divided(p: int, q: int) -> int:
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            link[q] = copy
            return copy

        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else divided(last, q)
        new, p = len(nxt), last
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else divided(p, q)
        return new

    def phrases(self, text: str | bytes) -> int:
        """Phrases of the greedy cross-parsing: longest matches, and each character without one."""
        nxt, count, state = self.next, 0, 0
        for c in text:
            to = nxt[state].get(c)
            if to is None:
                count += state != 0
                to = nxt[0].get(c)
                if to is None:
                    count, to = count + 1, 0
            state = to
        return count + (state != 0)


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a combining mark, which belongs to a word but is no letter, else 0."""
    kinds = np.fromiter((2 * chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    kinds[MARKS.start : MARKS.stop] = 1
    return kinds


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of the texts in them, letters of each text): lower case, each run of other characters one space, a space in front.

    Null is empty. The bytes are UTF-8.
    """
    texts = ["\n" + (t or "").lower() for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    kinds = _kinds()[points]
    letters = np.concatenate(([0], np.cumsum(kinds == 2)))[np.concatenate(([0], ends))]
    inside = kinds > 0
    first = np.zeros(len(points), bool)
    first[ends[:-1]] = True
    first[:1] = True
    keep = inside | first
    keep[1:] |= inside[:-1]  # the first of a run of others, which the space in front is already
    kept = np.where(inside, points, 32)
    kept[first] = 10  # no other character is a line feed now
    data = np.frombuffer(kept[keep].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).copy()
    starts = np.flatnonzero(data == 10)
    data[starts] = 32
    return data, starts, np.diff(letters)


@dataclass
class Language:
    """A language's automaton as edges: from a state, over a byte, to a state."""

    name: str
    weight: float  # bits that point at a phrase: log2 of the training text's length
    states: int
    edges: tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class LanguageModel:
    languages: list[Language]


def learned(name: str, texts: list[str]) -> Language | None:
    """A language from its training texts; None without letters in them."""
    data, starts, letters = normalised(texts)
    if not letters.sum():
        return None
    automaton, whole = SuffixAutomaton(), data.tobytes()
    for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(whole)], strict=True):
        automaton.add(whole[a:b])
    edges = [(state, c, to) for state, out in enumerate(automaton.next) for c, to in out.items()]
    state, c, to = zip(*edges, strict=True)
    return Language(name, math.log2(2 + len(whole)), len(automaton.next), (np.array(state, np.int32), np.array(c, np.uint8), np.array(to, np.int32)))


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample(docs: DataFrame, rows_per_language: int = 240, chars_per_row: int = 400) -> dict[str, list[str]]:
    """Training texts of each language, from rows with a language and a text that are not held out.

    The sample is bounded: for each language the ``rows_per_language`` rows with the smallest hash of their id, and of each
    a run of at most ``chars_per_row`` characters from a place drawn by that hash. The languages' counts of such
    rows set how small a hash must be for a row to be shuffled at all, so that about four times the rows wanted are
    ranked, whatever the input's size.
    """
    top = 1 << 30
    text = F.col("text").cast("string")
    rows = docs.filter(F.col("lang").isNotNull() & (F.length(text) > 0) & (bucket_of(F.col("doc_id")) != 0)).select(
        F.col("lang").cast("string").alias("lang"), "doc_id", text.alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(top)).alias("share"))
    most = {r.lang: min(top, 4 * rows_per_language * top // r["count"]) for r in rows.groupBy("lang").count().collect()}  # a number for each language
    if not most:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("lang"))
    at = F.pmod(F.xxhash64("share", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars_per_row + 1)).cast("int") + 1
    drawn = rows.filter(F.col("share") < limit).select("lang", "doc_id", "share", F.substring(F.col("text"), at, F.lit(chars_per_row)).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("share", "doc_id", "text")
    chosen = drawn.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= rows_per_language)
    found: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "n").toLocalIterator():
        found.setdefault(row.lang, []).append(row.text)
    return found


def train(docs: DataFrame, rows_per_language: int = 240, chars_per_row: int = 400) -> LanguageModel:
    """A suffix automaton of each language's training text, bounded as :func:`sample` says."""
    found = sample(docs, rows_per_language, chars_per_row)
    return LanguageModel([x for name in sorted(found) if (x := learned(name, found[name]))])


class Parser:
    """The automata of a model as one transition table over the bytes that any of them has."""

    def __init__(self, model: LanguageModel):
        self.model = model
        used = np.unique(np.concatenate([x.edges[1] for x in model.languages] or [np.zeros(0, np.uint8)]))
        self.code = np.zeros(256, np.int32)  # 0: no language has the byte
        self.code[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        # the languages' states follow each other, and an edge is stored as where its end's row begins; 0 is no edge
        self.roots = np.cumsum([0] + [x.states for x in model.languages])[:-1] * self.width
        self.table = np.zeros(sum(x.states for x in model.languages) * self.width, np.int32)
        for root, x in zip(self.roots.tolist(), model.languages, strict=True):
            state, c, to = x.edges
            self.table[root + state * self.width + self.code[c]] = root + to * self.width

    def phrases(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) in each language: longest matches, and each byte without one."""
        sizes = np.diff(np.append(starts, len(data)))
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(starts)), blocks)
        lengths = np.minimum(BLOCK, np.repeat(sizes, blocks) - BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)))
        out = np.zeros((len(starts), len(self.roots)), np.int64)
        if not len(text) or not len(self.roots):
            return out
        order = np.argsort(-lengths, kind="stable")  # so that those still being parsed come first
        begin = np.cumsum(lengths) - lengths
        steps = np.arange(int(lengths.max()))[:, None]
        symbols = self.code[np.append(data, np.zeros(BLOCK, np.uint8))][begin[order][None, :] + steps].astype(np.uint8)
        active = np.searchsorted(-lengths[order], -np.arange(1, len(steps) + 1), "right")
        n, roots = len(text), self.roots.astype(np.int32)[:, None]
        state, count = np.repeat(roots, n, axis=1), np.zeros((len(roots), n), np.int32)
        for at, k in enumerate(active.tolist()):
            if k < n:  # drop the columns that have ended
                state_done, count_done = state[:, k:n], count[:, k:n]
                out_rows = text[order[k:n]]
                np.add.at(out, out_rows, (count_done + (state_done != roots)).T)
                state, count, n = state[:, :k], count[:, :k], k
            c = symbols[at, :k].astype(np.int32)
            to = self.table[state + c]
            again = self.table[roots + c]
            ended, none = to == 0, again == 0
            count += ended & (state != roots)
            count += ended & none
            state = np.where(ended, np.where(none, roots, again), to)
        np.add.at(out, text[order[:n]], (count + (state != roots)).T)
        return out

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the fewest phrases, weighed by the bits that point at one; ties go by name.

        The score is 1 less the ratio of the best to the next, 1 with one language only, 0 after a tie.
        """
        data, starts, letters = normalised(texts)
        costs = self.phrases(data, starts) * np.array([x.weight for x in self.model.languages])
        out = []
        for cost, n in zip(costs.tolist(), letters.tolist(), strict=True):
            if not n or not cost:
                out.append((UNDETERMINED, 0.0))
                continue
            best = min(range(len(cost)), key=cost.__getitem__)  # languages are in order of name
            others = cost[:best] + cost[best + 1 :]
            out.append((self.model.languages[best].name, 1 - cost[best] / min(others) if others else 1.0))
        return out


def parser_of(pickled: bytes) -> Parser:
    return Parser(pickle.loads(pickled))


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score"), chars: int = 4 << 20) -> DataFrame:
    """``docs`` with the language and the score added at the end as ``names``, from whole texts alone.

    ``und`` with score 0 where text is null or has no letters, or where nothing was learned. Each row is
    judged by itself: repeated rows agree, an empty table gives no rows, other columns are kept (columns of
    these two names are replaced; choose other names to keep them). Texts are parsed in runs of ``chars`` characters, a longer one by itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*names)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # bounded by sample()'s parameters and the number of languages
    at = docs.columns.index("text")

    def run(batches):
        parser = held(parser_of, sent.value)
        for batch in batches:
            out, some, size = [], [], 0
            for text in batch.column(at).to_pylist():
                some.append(text)
                size += len(text or "")
                if size >= chars:
                    out += parser.decide(some)
                    some, size = [], 0
            out += parser.decide(some) if some else []
            columns = [*batch.columns, pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(tidy(run, model=True), schema)
