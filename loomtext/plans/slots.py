"""Dictionary slots, and specs that change them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum


class Slot(Enum):
    """A dictionary's role. Values are stable numbers; 16 and 17 are retired."""

    ST_CHARACTERS = 0
    ST_PHRASES = 1
    ST_PUNCTUATIONS = 2
    TS_CHARACTERS = 3
    TS_PHRASES = 4
    TS_PUNCTUATIONS = 5
    TW_PHRASES = 6
    TW_PHRASES_REV = 7
    TW_VARIANTS = 8
    TW_VARIANTS_PHRASES = 9
    TW_VARIANTS_REV = 10
    TW_VARIANTS_REV_PHRASES = 11
    HK_VARIANTS = 12
    HK_VARIANTS_PHRASES = 13
    HK_VARIANTS_REV = 14
    HK_VARIANTS_REV_PHRASES = 15
    JPS_CHARACTERS = 18
    JPS_CHARACTERS_REV = 19
    JPS_PHRASES = 20
    HK_PHRASES = 21
    HK_PHRASES_REV = 22

    @property
    def label(self) -> str:
        return self.name.lower()

    @classmethod
    def parse(cls, name: str) -> Slot:
        """By label, case and separators ignored; numbers and retired names are errors."""
        key = re.sub(r"[_\-\s]", "", name or "").lower()
        for slot in cls:
            if key and key == slot.label.replace("_", ""):
                return slot
        raise ValueError(f"unknown dictionary slot: {name!r}")


class Mode(Enum):
    APPEND = "append"
    OVERRIDE = "override"


@dataclass(frozen=True)
class CustomSpec:
    """Entries for a slot: files in order, then pairs; later keys win. A null value deletes matched text."""

    slot: Slot
    mode: Mode = Mode.APPEND
    paths: tuple[str, ...] = ()
    pairs: Mapping[str, str | None] = field(default_factory=dict)

    def __post_init__(self):
        if not self.paths and not self.pairs:
            raise ValueError("a custom dictionary needs a path or pairs")

    @classmethod
    def parse(cls, token: str) -> CustomSpec:
        """`slot:append|override:path`; the path may hold colons."""
        parts = [p.strip() for p in (token or "").split(":", 2)]
        if len(parts) < 3 or not all(parts):
            raise ValueError(f"expected slot:mode:path, got {token!r}")
        try:
            mode = Mode(parts[1].lower())
        except ValueError:
            raise ValueError(f"unknown mode: {parts[1]!r}") from None
        return cls(Slot.parse(parts[0]), mode, (parts[2],))
