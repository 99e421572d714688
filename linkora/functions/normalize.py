"""Normal forms of business names and addresses, a batch at a time."""

from __future__ import annotations

import functools
import operator
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionaries as D
from .romanize import is_non_latin, transliterate


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def repair_ocr(token: Column) -> Column:
    """Digits read for letters, in tokens that mix both and have two letters at least."""
    mixed = ~token.rlike("^([a-z]+|[0-9]+)$") & (F.length(F.regexp_replace(token, "[^a-z]", "")) >= 2)
    return F.when(mixed, F.translate(token, D.OCR_DIGITS, D.OCR_LETTERS)).otherwise(token)


_DOMAIN, _ALIAS = re.compile(D.DOMAIN, re.ASCII), re.compile(D.ALIAS, re.ASCII)
_INITIALS = re.compile(r"\b([a-z])\.(?=[a-z]\.)", re.ASCII)
_NAME_REST, _ADDRESS_REST = re.compile("[^a-z0-9/ ]"), re.compile("[^a-z0-9 ]")
_BETWEEN = re.compile("(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])")
_ZEROS = re.compile("^0+(?=[0-9])")
_REPAIRS = str.maketrans(D.OCR_DIGITS, D.OCR_LETTERS)
_LEGAL, _DROPPED, _STATES = frozenset(D.LEGAL), frozenset(D.ADDRESS_DROPPED), D.state_names()


@functools.lru_cache(50_000)
def _name_token(token: str) -> str:
    """:func:`repair_ocr` and the abbreviations, of a token of a-z and 0-9."""
    if not token.isalpha() and not token.isdigit() and sum(map(str.isalpha, token)) >= 2:
        token = token.translate(_REPAIRS)
    return D.NAME_ABBREVIATIONS.get(token, token)


def name_forms(text: str) -> tuple[str, str, str]:
    """(full, core, alias) of a name in ASCII: parts between alias markers; cores are parts without legal words, where others are left.

    The core is the first of the longest parts, the alias all of them.
    """
    s = text.lower()
    if "." in s:
        s = _INITIALS.sub(r"\1", _DOMAIN.sub(r" \1 ", s).replace("&", " and ").replace("+", " "))
    else:
        s = s.replace("&", " and ").replace("+", " ")
    s = _ALIAS.sub(" | ", _NAME_REST.sub(" ", s)).replace("/", " ")
    parts = [tokens for part in s.split("|") if (tokens := [_name_token(t) for t in part.split()])]
    cores = [[t for t in part if t not in _LEGAL] or part for part in parts]
    return " ".join(" ".join(part) for part in parts), " ".join(max(cores, key=len, default=[])), " | ".join(map(" ".join, cores))


@functools.lru_cache(50_000)
def _address_part(part: str) -> str:
    return " ".join(D.ADDRESS_ABBREVIATIONS.get(t, t) for t in _ADDRESS_REST.sub(" ", part).split() if t not in _DROPPED)


def address_form(text: str, country: str | None) -> str:
    """The normal form of an address in ASCII; states by the country's table, if it has one."""
    states = _STATES.get(country, {})
    s = " ".join(states.get(c, c) for part in text.lower().replace("##", " ").split(",") if (c := _address_part(part)))
    return " ".join(_ZEROS.sub("", t) for t in _BETWEEN.sub(" ", s).split())


def _forms(learned: dict[str, str] | None):
    @F.arrow_udf("struct<name: string, core: string, alias: string, addr: string>")
    def run(names: pa.Array, addresses: pa.Array, countries: pa.Array) -> pa.Array:
        latin = lambda s: s if s.isascii() else transliterate(s, learned)
        rows = zip(names.to_pylist(), addresses.to_pylist(), countries.to_pylist(), strict=True)
        found = [(*name_forms(latin(n)), address_form(latin(a), c)) for n, a, c in rows]
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.StructArray.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["name", "core", "alias", "addr"])

    return run


def skeleton(text: Column) -> Column:
    """Without vowels and spaces, repeats of a letter once."""
    return F.regexp_replace(F.regexp_replace(text, "[aeiouy ]", ""), r"(.)\1+", "$1")


def components(text: Column) -> Column:
    """The non-blank comma components, trimmed and in lower case."""
    return F.filter(F.transform(F.split(text, ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")


def last_component(text: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(text, ","), -1)))


def normalized(records: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """``records`` (business_name, business_address, country) with name, core, alias, addr and nonlatin added.

    Text of any script is put in Latin letters first, tokens of other scripts by the ``learned`` table.
    """
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    rows = records.withColumn("_forms", _forms(learned)(name, addr, F.col("country").cast("string")))
    return rows.withColumns({**{c: F.col(f"_forms.{c}") for c in ("name", "core", "alias", "addr")}, "nonlatin": is_non_latin(name)}).drop("_forms")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)
