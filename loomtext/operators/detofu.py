"""Fallbacks for rare characters that fonts lack, in one pass: a fallback may itself be a key."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from enum import IntEnum
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources.dictionaries import directory
from .convert import translate


class Level(IntEnum):
    """The first Unicode extension whose characters are replaced."""

    B = 1
    C = 2
    D = 3
    E = 4
    F = 5
    G = 6
    H = 7
    I = 8  # noqa: E741

    @classmethod
    def parse(cls, name: str | None) -> Level:
        key = (name or "").strip().lower()
        if key == "all":
            return cls.B
        if (m := re.fullmatch("(?:ext-?)?([b-i])", key)) is not None:
            return cls[m[1].upper()]
        raise ValueError(f"unknown level: {name!r}")


#: Planes' blocks of the extensions, for characters without a table entry of their own.
BLOCKS = ((0x20000, 0x2A6DF, Level.B), (0x2A700, 0x2B73F, Level.C), (0x2B740, 0x2B81F, Level.D), (0x2B820, 0x2CEAF, Level.E), (0x2CEB0, 0x2EBEF, Level.F), (0x30000, 0x3134F, Level.G), (0x31350, 0x323AF, Level.H), (0x2EBF0, 0x2EE5F, Level.I))

# ---- fixed values: a few well-known fallbacks; a directory's table adds the others -----------------
SEED = "𬴂 騑 E|𠀾 𠁞 B|𠁞 𠀾 B"


def extension_of(c: str) -> Level | None:
    return next((level for a, b, level in BLOCKS if a <= ord(c) <= b), None)


def parse_entries(text: str) -> list[tuple[str, str, Level]]:
    """`rare<TAB>fallback<TAB>extension[<TAB>more]`; short lines and unknown extensions are skipped."""
    out = []
    for line in text.lstrip("﻿").splitlines():
        parts = [p.strip() for p in line.strip().split("\t")]
        if line.startswith("#") or len(parts) < 3 or not parts[0] or not parts[1]:
            continue
        try:
            out.append((parts[0][0], parts[1][0], Level.parse(parts[2])))
        except ValueError:
            continue
    return out


@lru_cache(maxsize=8)
def _builtin(path: str | None) -> tuple[tuple[str, str, Level], ...]:
    own = [(a, b, Level[c]) for a, b, c in (x.split() for x in SEED.split("|"))]
    if path:
        for f in sorted(directory(path).glob("*ofu*.txt")):
            own += parse_entries(f.read_text(encoding="utf-8-sig"))
    return tuple(own)


def builtin_entries(path: str | None = None) -> tuple[tuple[str, str, Level], ...]:
    found = directory(path)
    return _builtin(str(found) if found else None)


@dataclass(frozen=True)
class DeTofu:
    """A level's table with custom changes: files respect the level, pairs do not."""

    level: Level
    table: Mapping[str, str]

    @classmethod
    def builtin(cls, level: Level | str = Level.B, path: str | None = None) -> DeTofu:
        level = Level.parse(level) if isinstance(level, str) else level
        return cls(level, {a: b for a, b, x in builtin_entries(path) if x >= level})

    def with_text(self, text: str) -> DeTofu:
        return DeTofu(self.level, {**self.table, **{a: b for a, b, x in parse_entries(text) if x >= self.level}})

    def with_pairs(self, pairs: Mapping[str, str | None]) -> DeTofu:
        return DeTofu(self.level, {**self.table, **{k[0]: v[0] for k, v in pairs.items() if k and v}})

    def column(self, col: Column) -> Column:
        return translate(col, {k: v for k, v in self.table.items() if k != v})

    def text(self, text: str | None) -> str:
        return (text or "").translate(str.maketrans(dict(self.table)))


def detofu(col: Column, level: Level | str = Level.B, pairs: Mapping[str, str] | None = None) -> Column:
    return DeTofu.builtin(level).with_pairs(pairs or {}).column(col)


def entries_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, int(x), i) for i, (a, b, x) in enumerate(builtin_entries())], "tofu string, fallback string, level int, ord long")
