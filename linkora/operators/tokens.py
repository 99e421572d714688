"""Blocking tokens of normalised records, with country and field in front, and their hashes."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the blocking vector and their weights.
FIELDS = {"name": 0.6, "addr": 0.3, "num": 0.1}
_SPACE = re.compile(r"\s+", re.ASCII)


def _words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def _prefixed(country: str | None, found: list[tuple[str, str]]) -> list[str | None]:
    """(kind, token) as country|kind|token, distinct and sorted; one null without a country."""
    if country is None:
        return [None] if found else []
    return sorted({f"{country}|{kind}|{t}" for kind, t in found})


def name_tokens(core: str, alias: str, country: str | None) -> list[str | None]:
    """Core words of 2 letters on, adjacent pairs, the core in one from 6 letters on, words of the first three alias parts."""
    tokens = _words(core)
    joined = "".join(tokens)
    found = [("n", t) for t in tokens if len(t) >= 2] + [("nb", f"{x}_{y}") for x, y in pairwise(tokens)] + [("nc", joined)] * (len(joined) >= 6)
    return _prefixed(country, found + [("n", t) for part in alias.split(" | ")[:3] for t in _words(part) if len(t) >= 2])


def _digits(t: str) -> bool:
    return t.isascii() and t.isdigit()


def addr_tokens(tokens: list[str], country: str | None) -> list[str | None]:
    """Words of 3 letters on, and each number with the word after it."""
    found = [("a", t) for t in tokens if len(t) >= 3 and not _digits(t)]
    return _prefixed(country, found + [("ab", f"{x}_{y}") for x, y in pairwise(tokens) if _digits(x) and not _digits(y)])


def num_tokens(tokens: list[str], country: str | None) -> list[str | None]:
    return _prefixed(country, [("#", t) for t in tokens if _digits(t)])


def _tokens():
    fields = ("tok_name", "tok_addr", "tok_num")

    @F.arrow_udf(f"struct<{', '.join(f'{f}: array<string>' for f in fields)}>")
    def run(core: pa.Array, alias: pa.Array, addr: pa.Array, country: pa.Array) -> pa.Array:
        found: tuple[list, list, list] = ([], [], [])
        for c, a, d, k in zip(core.to_pylist(), alias.to_pylist(), addr.to_pylist(), country.to_pylist(), strict=True):
            words = _words(d)
            for column, row in zip(found, (name_tokens(c, a, k), addr_tokens(words, k), num_tokens(words, k)), strict=True):
                column.append(row)
        return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in found], fields)

    return run


def hashed(token: Column, bits: int = 24) -> Column:
    """crc32 of the UTF-8 bytes, its low ``bits`` bits."""
    return F.crc32(token.cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))


def with_tokens(records: DataFrame) -> DataFrame:
    """Normalised ``records`` with the arrays tok_name, tok_addr and tok_num."""
    rows = records.withColumn("_tokens", _tokens()(*(F.col(c).cast("string") for c in ("core", "alias", "addr", "country"))))
    return rows.withColumns({c: F.col(f"_tokens.{c}") for c in ("tok_name", "tok_addr", "tok_num")}).drop("_tokens")


def exploded(records: DataFrame, bits: int | None = None) -> DataFrame:
    """(entity_id, country, field, tok): a row for each distinct token; ``bits`` hashes them to that many bits."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tok_{f}").alias("toks")) for f in FIELDS]))
    rows = records.select("entity_id", "country", fields.alias("f")).select("entity_id", "country", F.col("f.field").alias("field"), F.explode("f.toks").alias("tok"))
    return rows if bits is None else rows.withColumn("tok", hashed(F.col("tok"), bits)).distinct()
