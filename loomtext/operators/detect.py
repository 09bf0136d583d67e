"""Variant detection and single-character conversion, always with the default dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dictionaries import load
from .convert import translate
from .matcher import merged

CLAMP_UNITS, MOST_GRAPHEMES = 500, 100
#: Left out before looking at characters; \x0B is spelled out since \v means more in Java.
IGNORED = "[!-/:-@\\[-`{-~\\t\\n\\x0B\\f\\r 0-9A-Za-z_著]"


def st_table() -> dict[str, str]:
    return {k: v for k, v in merged([load()["st_characters"]]).items() if len(k) == 1}


def ts_table() -> dict[str, str]:
    return {k: v for k, v in merged([load()["ts_characters"]]).items() if len(k) == 1}


def st(col: Column) -> Column:
    """Simplified to Traditional, character by character."""
    return translate(col, st_table())


def ts(col: Column) -> Column:
    return translate(col, ts_table())


def conversion_changes_text(col: Column, converted: Column) -> Column:
    return ~col.eqNullSafe(converted)


def clamp(col: Column) -> Column:
    """The first 500 UTF-16 units, a character never split."""
    raw = F.encode(F.substring(col, 1, CLAMP_UNITS), "UTF-16LE")
    cut = F.substring(raw, 1, 2 * CLAMP_UNITS)
    high = F.conv(F.hex(F.substring(cut, 2 * CLAMP_UNITS, 1)), 16, 10).cast("int")
    split = (F.octet_length(raw) > 2 * CLAMP_UNITS) & high.between(0xD8, 0xDB)
    return F.decode(F.when(split, F.substring(cut, 1, 2 * CLAMP_UNITS - 2)).otherwise(cut), "UTF-16LE")


def zho_check(col: Column, null_as_zero: bool = True) -> Column:
    """1 Traditional, 2 Simplified, 0 neither; mixed text counts as Traditional."""
    left = F.regexp_replace(clamp(col), IGNORED, "")
    head = F.regexp_extract(left, f"^\\X{{0,{MOST_GRAPHEMES}}}", 0)
    out = F.when(ts(head) != head, 1).when(st(head) != head, 2).otherwise(0)
    return F.when(col.isNull(), F.lit(0) if null_as_zero else F.lit(None)).otherwise(out).cast("int")
