"""DuckDB forms of the conversions, built from the same dictionaries."""

from __future__ import annotations

from collections.abc import Mapping

from ..operators.convert import token_pattern
from ..operators.matcher import SEGMENT_EXCLUSIVE, SEGMENT_INCLUSIVE, is_scalar


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def translate(expr: str, table: Mapping[str, str]) -> str:
    keys = sorted(table, key=lambda k: (table[k] == "", k))
    return f"translate({expr}, {text(''.join(keys))}, {text(''.join(table[k] for k in keys))})" if keys else expr


def round_sql(expr: str, table: Mapping[str, str]) -> str:
    if not table:
        return expr
    if is_scalar(table):
        return translate(expr, table)
    found = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in table.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({expr}, {text(token_pattern(table))}, 1), lambda z: coalesce({found}[z], z)), '')"


def rounds_sql(expr: str, rounds) -> str:
    for table in rounds:
        expr = round_sql(expr, table)
    return expr


def segments_sql(expr: str, inclusive: bool) -> str:
    return f"regexp_extract_all({expr}, {text(SEGMENT_INCLUSIVE if inclusive else SEGMENT_EXCLUSIVE)}, 0)"


def units_sql(expr: str) -> str:
    """Length in UTF-16 units."""
    return rf"(length({expr}) + len(regexp_extract_all({expr}, '[\x{{10000}}-\x{{10FFFF}}]')))"


def dict_rows(slots: Mapping[str, Mapping[str, str]]) -> str:
    """VALUES (slot, key, value, ord)."""
    rows = [f"({text(s)}, {text(k)}, {text(v)}, {i})" for s, own in slots.items() for i, (k, v) in enumerate(own.items())]
    return f"(VALUES {', '.join(rows)}) AS d(slot, key, value, ord)"
