"""Compatibility characters: tables from rules, user tables, and their columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables
from ..sources.dictionaries import directory
from .convert import translate


class MappingError(ValueError):
    """A faulty line of a mapping text."""


def parse_mapping(text: str, allowed=None, what: str = "mapping") -> dict[str, str]:
    """`source<TAB>target`, one character each; errors name the line."""
    out = {}
    for n, line in enumerate(text.lstrip("﻿").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = line.split("\t")
        if len(parts) != 2:
            raise MappingError(f"{what}, line {n}: expected two columns")
        source, target = (p.strip() for p in parts)
        if len(source) != 1 or len(target) != 1:
            raise MappingError(f"{what}, line {n}: expected one character in each column")
        if allowed is not None and not allowed(source):
            raise MappingError(f"{what}, line {n}: U+{ord(source):04X} is not allowed as a source")
        out[source] = target
    return out


def is_compat_ideograph(c: str) -> bool:
    return "\uf900" <= c <= "\ufaff" or "\U0002f800" <= c <= "\U0002fa1f"


def compat_from_text(text: str) -> dict[str, str]:
    return parse_mapping(text, is_compat_ideograph, "compatibility ideographs")


def extended_from_text(text: str) -> dict[str, str]:
    return parse_mapping(text, lambda c: c > "\x7f", "extended characters")


@lru_cache(maxsize=2)
def compat_table() -> dict[str, str]:
    return tables.compat_ideographs()


@lru_cache(maxsize=8)
def _extended(path: str | None) -> dict[str, str]:
    own = tables.unicode_compat()
    if path:
        for f in sorted(directory(path).glob("*.txt")):
            if f.stem.lower().replace("_", "").startswith("unicodecompat"):
                own = own | extended_from_text(f.read_text(encoding="utf-8-sig"))
    return own


def extended_table(path: str | None = None) -> dict[str, str]:
    found = directory(path)
    return _extended(str(found) if found else None)


def full_table(path: str | None = None) -> dict[str, str]:
    """Both tables in one pass: no chaining, compatibility ideographs win."""
    return extended_table(path) | compat_table()


def normalize_compat(col: Column, extended: bool = False, table: Mapping[str, str] | None = None) -> Column:
    return translate(col, dict(table) if table is not None else full_table() if extended else compat_table())


def normalize_unicode_compat(col: Column) -> Column:
    return translate(col, extended_table())


def normalize_scalar(col: Column) -> Column:
    """Exactly one character in, one out; anything else is an error."""
    return F.when(F.assert_true(F.char_length(col) == 1, F.lit("expected exactly one character")).isNull(), normalize_compat(col))


def normalize_text(text: str | None, extended: bool = False) -> str:
    return (text or "").translate(str.maketrans(full_table() if extended else compat_table()))
