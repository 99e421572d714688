"""Byte-level BPE ids at memo speed.

A byte-level BPE never merges across a boundary between a non-space character and the space after it,
so a text that has single spaces only is encoded chunk by chunk, each distinct chunk once. Arrow splits a
batch and numbers its chunks; Python sees each distinct chunk of a batch once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import held

#: What the pattern's ``\\s`` means: Unicode white space (a fixed value; Python's own adds \\x1c-\\x1f).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer runs of white space never reach the pattern, whose backtracking would overflow on them.
RUN = 1000


def byte_alphabet() -> dict[str, int]:
    """Printable character of the vocabulary file -> byte (the rule of byte-level BPE files)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of texts as little-endian unsigned 32-bit values; a special token's string is that token's one id, as in the tokenizer file."""

    def __init__(self, vocabulary: bytes, pattern: str, memo: int = 600_000, longest: int = 64, part: int = 4 << 20):
        import tiktoken

        model, back = json.loads(vocabulary), byte_alphabet()
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        self.bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))
        self.memo: dict[str, bytes] = {}  # a chunk that follows a space -> its ids
        self.most, self.longest, self.part = memo, longest, part
        apart = [re.escape(x) for x in sorted(self.special, key=len, reverse=True)]
        self.specials = re.compile(f"({'|'.join(apart)})") if apart else None
        self.wide = re.compile(f"[{SPACE}]{{{RUN},}}")

    def _ordinary(self, text: str) -> list[int]:
        """Ids of a text without special tokens. All but the last character of a run of white space that does not end the text is one piece by the pattern."""
        if len(text) < RUN or not (runs := list(self.wide.finditer(text))):
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for run in runs:
            stop = run.end() - (run.end() < len(text))
            out += self.bpe.encode_ordinary(text[at : run.start()])
            out += self.bpe._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + self.bpe.encode_ordinary(text[at:])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if not self.specials:
            return self._ordinary(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._ordinary(part)
        return out

    def raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _learn(self, chunks: list[str], sizes: np.ndarray) -> list[bytes]:
        """The ids of chunks (of ``sizes`` bytes) that follow a space, encoded in one go: no piece holds parts of two."""
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(chunks)), dtype="<u4")
        stops = (4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes + 1)) + 1)).tolist()
        data = ids.tobytes()
        found = list(map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)))
        self.memo.update((c, f) for c, f in zip(chunks, found, strict=True) if len(c) <= self.longest)
        return found

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a special token's string; they are encoded by themselves."""
        out = np.zeros(len(texts), bool)
        for x in self.special:
            out |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return out

    def _coded(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of distinct chunks, which chunk stands where, bounds of the texts in that)."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        bounds, chunks, index = bounds - bounds[0], coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        words = chunks.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > self.most:
            self.memo.clear()
        parts = list(map(self.memo.get, words))
        unknown = np.fromiter((x is None for x in parts), bool, len(parts))
        # chunks that run on into the next one, and ones long enough to hold a wide run, are not encoded by themselves
        sizes = pc.binary_length(chunks).to_numpy().astype(np.int64)
        unsafe = unknown & (pc.match_substring_regex(chunks, f"^$|[{SPACE}]$").to_numpy(zero_copy_only=False) | (sizes >= RUN))
        missing = np.flatnonzero(unknown & ~unsafe)
        new = pc.take(chunks, pa.array(missing)).to_numpy(zero_copy_only=False).tolist()
        for i, ids in zip(missing.tolist(), self._learn(new, sizes[missing]) if new else (), strict=True):
            parts[i] = ids
        for i in np.flatnonzero(unsafe).tolist():
            parts[i] = b""
        # a text's first chunk follows no space, and its last one may end in one
        first, last = bounds[:-1], bounds[1:] - 1
        inside = unsafe[index]
        inside[last[last > first]] = False
        slow = np.logical_or.reduceat(inside, first) & (last > first) | self._whole(texts) if len(first) else np.zeros(0, bool)
        nothing = len(parts)
        parts.append(b"")
        for i, (a, b, bad) in enumerate(zip(first.tolist(), last.tolist(), slow.tolist(), strict=True)):
            if bad:
                index[a : b + 1] = nothing
                index[a] = len(parts)
                parts.append(self.raw(texts[i].as_py()))
            else:
                front, back = words[index[a]], words[index[b]]
                index[a] = len(parts)
                parts.append(self.raw(front))
                if b > a:
                    index[b] = len(parts)
                    parts.append(self.raw(" " + back))
        return parts, index, bounds

    def _slices(self, texts: pa.Array):
        """Runs of texts of about ``part`` bytes."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.part, "right"))
            to = max(at + 1, to)
            yield at, texts.slice(at, to - at)
            at = to

    def batches(self, texts: pa.Array):
        """(ids of a run of texts as one array, its bounds) for run after run; null has none."""
        for _, some in self._slices(texts):
            parts, index, bounds = self._coded(some)
            every = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            offsets = np.cumsum(lengths) - lengths
            here = lengths[index]
            sums = np.concatenate(([0], np.cumsum(here)))
            yield every[np.repeat(offsets[index] - sums[:-1], here) + np.arange(sums[-1])], sums[bounds]

    def ids(self, text: str) -> bytes:
        ids, _ = next(self.batches(pa.array([text], pa.string())))
        return ids.astype("<u4").tobytes()


def bpe_of(vocabulary: bytes, pattern: str) -> ByteBpe:
    """The worker's encoder, with what it has met so far."""
    return held(ByteBpe, vocabulary, pattern)


def largest_id(vocabulary: bytes) -> int:
    model = json.loads(vocabulary)
    return max(*model["model"]["vocab"].values(), *(x["id"] for x in model.get("added_tokens", ())))


def bpe_file(path: str | None = None) -> bytes:
    """The tokenizer file's bytes, read on the driver and sent to the executors (about 2 MB, the file's size)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
