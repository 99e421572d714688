"""Token counts by a linear longest-match automaton: a trie with failure links and popped-token counts."""

from __future__ import annotations

import base64
import functools
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches



class LongestMatch:
    """Greedy longest-match-first piece counts of a word, in one pass over its bytes.

    ``starts`` are the pieces that begin a word, ``inner`` those that continue one; each set is a trie under its own
    root. Each node v stands for a string; ``fail[v]`` is the node where matching goes on after the longest
    pieces that begin v's string are popped, and ``popped[v]`` how many they are. A node whose string has no
    piece in front has no failure link: the word has no pieces then.
    """

    START, INNER = 0, 1

    def __init__(self, starts: list[bytes], inner: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((self.START, starts), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    to = self.next[node].get(byte)
                    if to is None:
                        to = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = to
                ends[node] = node > self.INNER
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        # breadth first: a parent's link is known before its children's
        queue = deque((node, root, byte) for root in (self.START, self.INNER) for byte, node in self.next[root].items())
        while queue:
            node, parent, byte = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = self.INNER, 1
            else:
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and byte not in self.next[at]:
                    at, count = self.fail[at], count + self.popped[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][byte], count
            queue.extend((child, node, b) for b, child in self.next[node].items())

    def count(self, word: bytes) -> int:
        """The number of pieces; 0 for an empty word, -1 for one that has none."""
        nxt, fail, popped, at, count = self.next, self.fail, self.popped, self.START, 0
        if not word:
            return 0
        for byte in word:
            while (to := nxt[at].get(byte)) is None:
                if fail[at] < 0:
                    return -1
                count += popped[at]
                at = fail[at]
            at = to
        while at != self.INNER:
            if fail[at] < 0:
                return -1
            count += popped[at]
            at = fail[at]
        return count


def greedy(word: bytes, starts: set[bytes], inner: set[bytes]) -> int:
    """The same by definition: cut the longest piece off the front until nothing is left."""
    count, pieces = 0, starts
    while word:
        n = next((n for n in range(len(word), 0, -1) if word[:n] in pieces), 0)
        if not n:
            return -1
        word, count, pieces = word[n:], count + 1, inner
    return count


def byte_pieces(rank_file: bytes) -> tuple[list[bytes], list[bytes]]:
    """(starts, inner) of a byte-level rank file: entries with a space in front start a word, the others continue one.

    Single bytes do both, so that every word has pieces.
    """
    tokens = [base64.b64decode(line.split()[0]) for line in rank_file.splitlines() if line.strip()]
    starts = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | {t for t in tokens if len(t) == 1}
    return sorted(starts), sorted(t for t in tokens if t[:1] != b" ")


@functools.lru_cache(2)
def _memo(rank_file: bytes):
    automaton = LongestMatch(*byte_pieces(rank_file))

    class Memo(dict):
        def __missing__(self, word):
            if len(self) >= 400_000:
                self.clear()
            n = self[word] = abs(automaton.count(word))  # a word without pieces is one unknown token
            return n

    return Memo()


def rank_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    r"""Greedy word-piece counts of whole ``docs`` (doc_id, text).

    Returns a row for each input row: doc_id, n_words (runs of other bytes than space and \\x09-\\x0D), n_tokens
    (a word without pieces counts as one), longest_word (pieces of the word with most). Null and empty texts have 0; a very long word is counted in
    one pass; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(rank_file(vocabulary))  # the file's size, under 1 MB

    def run(batches):
        memo = _memo(sent.value)
        for batch in batches:
            words, tokens, longest = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(memo.__getitem__, (text or b"").split()))
                words.append(len(counts))
                tokens.append(sum(counts))
                longest.append(max(counts, default=0))
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, longest))], names=["doc_id", "n_words", "n_tokens", "longest_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word long")
