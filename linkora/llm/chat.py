"""Chat formatting: a finite-state machine over roles and a declarative template; segments carry loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class Template:
    """Text before and after each role's text, and whether that text counts in the loss.

    ``other`` marks a role without an entry (or none): its name is written after it, before ``named``.
    A space stands between a text and the control string after it, so an escape can't run into one.
    """

    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>> ", " <</SYS>>", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("<s> ", " </s>", True),
        }
    )
    other: tuple[str, str, str] = ("<<ROLE>> ", " <</ROLE>> ", " <<END>>")

    def controls(self) -> list[str]:
        found = [x.strip() for before, after, _ in self.turns.values() for x in (before, after)]
        return sorted({*found, *(x.strip() for x in self.other)}, key=len, reverse=True)


#: state -> role -> next state; a role without an entry breaks the order and leads to that role's own state.
TRANSITIONS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ACCEPTING = {"assistant"}


class Codec:
    r"""Escaping that can be undone: a control string inside a text gets one more backslash before it."""

    def __init__(self, template: Template):
        self.template = template
        any_control = "|".join(map(re.escape, template.controls()))
        self._escape, self._unescape = re.compile(rf"(?<!\\)\\*(?:{any_control})"), re.compile(rf"(?<!\\)\\(\\*(?:{any_control}))")
        self.control = re.compile(rf"(?<!\\)(?:{any_control})")

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """A turn as (text, in the loss) segments."""
        turn, body = self.template.turns.get(role or ""), self.escape(text or "")
        if turn:
            return [(turn[0], False), (body, turn[2]), (turn[1], False)]
        before, named, after = self.template.other
        return [(before, False), (self.escape(role or ""), False), (named, False), (body, False), (after, False)]

    def read(self, chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
        """(role, text) turns of formatted text that comes in chunks; holds one turn at most."""
        opens = {before.strip(): role for role, (before, _, _) in self.template.turns.items()}
        mark, named, end = (x.strip() for x in self.template.other)
        text, searched, marks = "", 0, []
        for chunk in chunks:
            text += chunk
            while m := self.control.search(text, searched):
                searched = m.end()
                marks.append(m)
                if len(marks) < (3 if marks[0][0] == mark else 2):
                    continue
                if marks[0][0] == mark:
                    role, body = self.unescape(text[marks[0].end() + 1 : marks[1].start() - 1]), text[marks[1].end() + 1 : m.start() - 1]
                else:
                    role, body = opens[marks[0][0]], text[marks[0].end() + 1 : m.start() - 1]
                yield role, self.unescape(body)
                text, searched, marks = text[m.end() :], 0, []
            searched = max(searched, len(text) - 64) if not marks else max(marks[-1].end(), searched)


class Fsm:
    """Validates the order of roles; ``error`` names the first turn out of order."""

    def __init__(self):
        self.state, self.turns, self.error = "start", 0, None

    def step(self, role: str | None) -> None:
        following = TRANSITIONS.get(self.state, {}).get(role or "")
        if following is None and self.error is None:
            self.error = f"turn {self.turns}: {role} after {self.state}"
        self.state, self.turns = following or (role if role in TRANSITIONS else "start"), self.turns + 1

    def result(self) -> str | None:
        return self.error or (None if self.state in ACCEPTING else f"ends after {self.state}")


SEGMENTS = "conv_id long, seq long, turn_no long, segment string, loss boolean, order_error string"


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Format whole conversations (rows of conv_id, turn, role, text) into text segments with loss flags.

    Returns conv_id, seq (order in the conversation), turn_no, segment, loss, order_error (on the last
    segment: what is out of order, or null). Joined in order the segments are the conversation's formatted
    text. Turns go by ``turn``, null first, ties by role and text; null text is empty; a null or unknown
    role is written by name (null as the empty name); repeated rows are turns of their own; rows of a null
    conv_id are one conversation; an empty table gives no rows; other columns are ignored.

    Rows are sorted by conversation and stream through the machine, so a conversation of any length needs
    the memory of one turn.
    """
    bounded_batches(rows.sparkSession)
    codec = Codec(template or Template())
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("order_error", pa.string())])

    def run(batches):
        fsm, at, seq, held = None, object(), 0, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if fsm is None or conv != at:
                    if held:
                        out.append((*held[:5], fsm.result()))
                        held = None
                    fsm, at, seq = Fsm(), conv, 0
                for segment, loss in codec.segments(role, text):
                    if held:
                        out.append(held)
                    held, seq = (conv, seq, fsm.turns, segment, loss, None), seq + 1
                fsm.step(role)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)
        if held:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*held[:5], fsm.result()), schema, strict=True)], schema=schema)

    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, order_error string"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation, read from :func:`format_chats`' segments as they come from it (in order).

    The text is parsed back to turns by the template's control strings, the loss by its flags alone.
    """
    codec = Codec(template or Template())
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("order_error", pa.string())])

    class Reader:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.n, self.loss_n, self.chars, self.error = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, None

        def row(self):
            return (self.conv, self.n, self.turns.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars, self.error)

    def run(batches):
        reader, chunks = None, []

        def close(reader, chunks):
            for role, text in codec.read(iter(chunks)):
                reader.turns.update(f"{role}\n{text}\n".encode())
                reader.n += 1
            chunks.clear()

        last_turn = None
        for batch in batches:
            out = []
            for conv, seq, turn, segment, loss, error in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if reader is None or seq == 0:
                    if reader:
                        close(reader, chunks)
                        out.append(reader.row())
                    reader, last_turn = Reader(conv), turn
                elif turn != last_turn:
                    close(reader, chunks)  # a turn is complete; parse what has come
                    last_turn = turn
                chunks.append(segment)
                reader.chars += len(segment)
                reader.error = error or reader.error
                if loss:
                    plain = codec.unescape(segment)
                    reader.loss.update(plain.encode())
                    reader.loss_n += len(plain)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, schema, strict=True)], schema=schema)
        if reader:
            close(reader, chunks)
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(reader.row(), schema, strict=True)], schema=schema)

    return segments.mapInArrow(run, DIGESTS)
