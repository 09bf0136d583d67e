"""Greedy leftmost longest match over an ordered list of dictionaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np

from ..functions.tables import DELIMITERS, IDS_ARITY

#: Longer keys never match (length masks have 64 bits).
MOST_UNITS = 64
#: Texts shorter than this, in UTF-16 units, are matched across delimiters.
LINEAR_UNITS = 8000
MOST_IDS_DEPTH = 16

_IDS = re.compile("[⿰-⿿]")


def char_class(chars: str) -> str:
    """The inside of a character class, neighbours as ranges: engines test a class range by range."""
    out, codes = [], sorted(set(map(ord, chars)))
    while codes:
        n = next((i for i in range(1, len(codes)) if codes[i] != codes[0] + i), len(codes))
        a, b = re.escape(chr(codes[0])), re.escape(chr(codes[n - 1]))
        out.append(a if n == 1 else a + b if n == 2 else f"{a}-{b}")
        codes = codes[n:]
    return "".join(out)


_D = char_class(DELIMITERS)
SEGMENT_INCLUSIVE = f"(?s)[^{_D}]+[{_D}]?|[{_D}]"
SEGMENT_EXCLUSIVE = f"(?s)[^{_D}]+|[{_D}]"
#: Stands between texts that are converted together; a noncharacter, so no key or text should hold it.
BETWEEN = "\U0010ffff"
#: Characters that are converted together.
TOGETHER = 1 << 20


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "￿" for c in text)


def merged(dicts: Sequence[Mapping[str, str]]) -> dict[str, str]:
    """One dictionary: length is a property of the key, so between equal keys the first dictionary wins."""
    out: dict[str, str] = {}
    for d in dicts:
        for k, v in d.items():
            if k and units(k) <= MOST_UNITS:
                out.setdefault(k, v)
    return {k: v for k, v in out.items() if k != v or len(k) > 1}


def is_scalar(table: Mapping[str, str]) -> bool:
    """Whether one character-by-character translation does it."""
    return all(len(k) == 1 and len(v) <= 1 for k, v in table.items())


def is_split_sensitive(table: Mapping[str, str]) -> bool:
    """Whether cutting at delimiters changes results: a key holds one before its end, or is one."""
    return any(c in DELIMITERS for k in table for c in (k[:-1] or k))


def ids_end(text: str, start: int) -> int:
    """End of the complete description sequence that starts here, or -1. Leaves count UTF-16 units, as upstream
    tools do, so an outer character takes two; a cut inside one moves to its end."""
    stack, pos = [1], start
    half = False
    while stack:
        if pos >= len(text) or len(stack) - 1 > MOST_IDS_DEPTH:
            return -1
        c = text[pos]
        if half or c > "￿":
            half = not half
            pos += not half
            arity = 0
        else:
            arity = IDS_ARITY[ord(c) - 0x2FF0] if "⿰" <= c <= "⿿" else 0
            pos += 1
        stack[-1] -= 1
        if arity:
            stack.append(arity)
        while stack and stack[-1] == 0:
            stack.pop()
    return pos + half


def ids_split(text: str) -> list[tuple[bool, str]]:
    """(is description sequence, part) in order."""
    out, last = [], 0
    at = _IDS.search(text)
    while at:
        i = at.start()
        end = ids_end(text, i)
        if end < 0:
            at = _IDS.search(text, i + 1)
            continue
        if i > last:
            out.append((False, text[last:i]))
        out.append((True, text[i:end]))
        last = end
        at = _IDS.search(text, end)
    if last < len(text):
        out.append((False, text[last:]))
    return out


class Round:
    """A compiled dictionary: single characters by a table, longer keys by their first two characters."""

    def __init__(self, table: Mapping[str, str]):
        self.table = dict(table)
        self.scalar = is_scalar(self.table)
        self.sensitive = is_split_sensitive(self.table)
        singles = {k: v for k, v in self.table.items() if len(k) == 1}
        self.even = all(len(v) == 1 for v in singles.values())  # lengths stay, so a table of code points does it
        self.scan = re.compile("[" + "".join(map(re.escape, singles)) + "]").sub if singles else None
        top = max([0xFFFF, *(ord(k) for k in singles), *(ord(c) for k in self.table for c in k[:2])]) + 1
        if self.even:
            self.codes = np.arange(top + 1, dtype="<u4")
            for k, v in singles.items():
                self.codes[ord(k)] = ord(v)
        starts: dict[str, set[int]] = {}
        for k in self.table:
            if len(k) > 1:
                starts.setdefault(k[:2], set()).add(len(k))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in starts.items()}
        self.first = np.zeros(top + 1, bool)  # the last place stands for all characters beyond
        self.first[[ord(c[0]) for c in starts]] = True
        self.pairs = np.array(sorted(ord(c[0]) << 21 | ord(c[1]) for c in starts), np.uint64)

    def apply(self, text: str) -> str:
        if self.scalar and not self.sensitive:
            return self.match(text)
        if self.sensitive and len(text) * 2 >= LINEAR_UNITS and units(text) >= LINEAR_UNITS:
            return "".join(s if s in DELIMITERS else self.match(s) for s in re.findall(SEGMENT_INCLUSIVE, text))
        return text if len(text) == 1 and text in DELIMITERS else self.match(text)

    def _phrases(self, text: str, codes: np.ndarray, low: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, value) of longer keys from left to right, the longest at each place."""
        at = np.flatnonzero(self.first[low[:-1]])
        if not len(at):
            return []
        pair = codes[at].astype(np.uint64) << np.uint64(21) | codes[at + 1]
        where = np.searchsorted(self.pairs, pair)
        where[where == len(self.pairs)] = 0
        get, lengths = self.table.get, self.lengths
        out, end = [], 0
        for i in at[self.pairs[where] == pair].tolist():
            if i >= end:
                for size in lengths[text[i : i + 2]]:
                    if (v := get(key := text[i : i + size])) is not None and len(key) == size:
                        end = i + size
                        out.append((i, end, v))
                        break
        return out

    def match(self, text: str) -> str:
        if len(text) < 64 and self.scalar:
            return self._singles(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = np.minimum(codes, len(self.first) - 1)
        found = self._phrases(text, codes, low) if len(self.pairs) and len(codes) > 1 else []
        if self.scan and self.even:
            new = self.codes[low]
            beyond = low == len(self.first) - 1
            if beyond.any():
                new[beyond] = codes[beyond]
            text = new.tobytes().decode("utf-32-le", "surrogatepass")
        if not found:
            return text if self.even else self._singles(text)
        out, last = [], 0
        for a, b, v in found:
            out += (text[last:a] if self.even else self._singles(text[last:a]), v)
            last = b
        return "".join([*out, text[last:] if self.even else self._singles(text[last:])])

    def _singles(self, text: str) -> str:
        table = self.table
        return self.scan(lambda m: table[m[0]], text) if self.scan else text


class Pipeline:
    """Rounds one after the other."""

    def __init__(self, rounds: Sequence[Mapping[str, str]], preserve_ids: bool = False):
        self.rounds = [Round(t) for t in rounds if t]
        self.preserve_ids = preserve_ids

    @property
    def scalar(self) -> bool:
        return not self.preserve_ids and all(r.scalar and not r.sensitive for r in self.rounds)

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        for r in self.rounds:
            if self.preserve_ids and _IDS.search(text):
                text = "".join(part if keep else r.apply(part) for keep, part in ids_split(text))
            else:
                text = r.apply(text)
        return text

    def all(self, texts: Sequence[str | None]) -> list[str | None]:
        """Every text converted. Where no rule looks at a text's length, many go through a round together."""
        if self.preserve_ids or any(r.sensitive for r in self.rounds):
            return list(map(self, texts))
        out: list[str | None] = []
        for part in _parts(texts, TOGETHER):
            joined = BETWEEN.join([x or "" for x in part])
            if joined.count(BETWEEN) != len(part) - 1:
                out += map(self, part)
                continue
            for r in self.rounds:
                joined = r.match(joined)
            out += [x if x is None else y for x, y in zip(part, joined.split(BETWEEN))]
        return out


def _parts(texts: Sequence[str | None], most: int):
    """Runs of texts that hold about so many characters together."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


@lru_cache(maxsize=64)
def pipeline_for(rounds: tuple[tuple[tuple[str, str], ...], ...], preserve_ids: bool) -> Pipeline:
    """Compiled pipelines of this process, by content."""
    return Pipeline([dict(r) for r in rounds], preserve_ids)
