"""Paragraph reflow of extracted CJK text.

Lines go through an ordered list of rules; each may end the paragraph that is being gathered, emit the line by
itself, or add it. Everything about one line (its punctuation, brackets and quotes) is found once, in `Line`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import tables as t
from .matcher import char_class, units

LONG_BUFFER = 120
_TITLE = re.compile(t.TITLE_HEADING)
_INDENT = re.compile(f"[{t.SPACES}]{{2}}")
_CLOSERS = frozenset(t.DIALOG.values())
_QUOTE_OF = {v: k for k, v in t.DIALOG.items()}
_BRACKET_CLOSERS = frozenset(t.BRACKETS.values())
_LONGEST_KEY = max(map(len, t.METADATA_KEYS))
_NUMBER = f"[{t.LIST_NUMBERS}]"
_CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_LIST = re.compile(f"[{re.escape(t.LIST_BULLETS)}][{t.SPACES}]|\\({_NUMBER}{{1,2}}\\)|（{_NUMBER}{{1,2}}）|{_NUMBER}{{1,2}}(?:[)）、]|\\.[ {_CJK}])")
_LIST_CLOSER = re.compile(f"{_NUMBER}{{1,2}}[)）]")
_SPACE_RUN = re.compile(f"[{t.SPACES}]+")
_RUNS = re.compile(f"(?P<cjk>[{_CJK}]+)|(?P<letters>[A-Za-z]+)|(?P<bracket>[{re.escape(''.join(t.BRACKETS) + ''.join(_BRACKET_CLOSERS))}])")
_BRACKET = re.compile(f"[{re.escape(''.join(t.BRACKETS) + ''.join(_BRACKET_CLOSERS))}]")
_QUOTE = re.compile(f"[{''.join(t.DIALOG)}{''.join(_QUOTE_OF)}{''.join(t.ALSO_CLOSE)}]")
#: Characters kept of a paragraph's start and end, more than any rule looks at.
HEAD, TAIL = 8, 8
LETTERS_AHEAD = 4


# ---- predicates on text


def is_cjk(c: str) -> bool:
    return "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"


def trim(s: str) -> str:
    return s.strip(t.SPACES)


def all_cjk(s: str, spaces: bool = False) -> bool:
    body = "".join(c for c in s if c not in t.SPACES) if spaces else s
    return bool(body) and all(map(is_cjk, body))


def all_ascii(s: str) -> bool:
    return bool(s) and s.isascii()


def all_digits(s: str) -> bool:
    """ASCII or full-width digits, spaces aside."""
    body = s.replace(" ", "")
    return bool(body) and all(c in "0123456789０１２３４５６７８９" for c in body)


def mixed_cjk_ascii(s: str) -> bool:
    """Both CJK and letters or digits are met before anything that is neither nor neutral."""
    cjk = latin = False
    for c in s:
        if c in t.NEUTRAL_MARKS:
            continue
        if c.isascii() and c.isalnum() or "０" <= c <= "９":
            latin = True
        elif is_cjk(c):
            cjk = True
        else:
            return False
        if cjk and latin:
            return True
    return False


def mostly_cjk(s: str) -> bool:
    """As much CJK as letters, which are never ahead by more than LETTERS_AHEAD."""
    return Shape(s).mostly_cjk


def unclosed_bracket(s: str) -> bool:
    """Brackets that do not nest or do not close."""
    stack = []
    for c in _BRACKET.findall(s):
        if c in t.BRACKETS:
            stack.append(t.BRACKETS[c])
        elif not stack or stack.pop() != c:
            return True
    return bool(stack)


def unclosed_quote(s: str) -> bool:
    open_: Counter[str] = Counter()
    for c in _QUOTE.findall(s):
        if c in t.DIALOG:
            open_[c] += 1
            continue
        q = _QUOTE_OF.get(c) or t.ALSO_CLOSE[c]
        if not open_[q]:
            return True
        open_[q] -= 1
    return any(open_.values())


def is_divider(s: str) -> bool:
    """At least three marks of one kind, and nothing else but spaces."""
    body = "".join(c for c in s if c not in t.SPACES)
    return len(body) >= 3 and any(all(c in group for c in body) for group in t.DIVIDER_GROUPS)


def ends_like_sentence(s: str, level: int = 2) -> bool:
    """Level 3 strict, 2 also colons and ellipses in CJK text, 1 also semicolons."""
    return Shape(s).ends_like_sentence(level)


def is_bracket_paragraph(s: str) -> bool:
    """Wholly inside one pair of brackets around mostly CJK text."""
    return Shape(s).in_one_bracket


class Shape:
    """What the rules ask of a text, kept up while text is added, so that no question reads the text again."""

    def __init__(self, text: str = ""):
        self.units = self.balance = self.ahead = self.depth = 0
        self.has_cjk = self.crossed = self.sunk = False
        self.brackets: list[str] = []
        self.head = self.tail = ""
        self.add(text)

    def add(self, s: str) -> None:
        self.units += units(s)
        if len(self.head) < HEAD:
            self.head = (self.head + s).lstrip(t.SPACES)[:HEAD]
        self.tail = _SPACE_RUN.sub(" ", self.tail + _end_of(s))[-TAIL:]
        first = self.head[:1]
        closer = t.BRACKETS.get(first)
        for kind, run in _telling_runs(s):
            if kind == "cjk":
                self.has_cjk = True
                self.balance -= len(run)
            elif kind == "letters":
                self.balance += len(run)
                self.ahead = max(self.ahead, self.balance)
            elif run in t.BRACKETS:
                self.brackets.append(t.BRACKETS[run])
                self.depth += run == first
            else:
                self.crossed |= not self.brackets or self.brackets.pop() != run
                if run == closer:
                    self.depth -= 1
                    self.sunk |= self.depth < 0

    @property
    def mostly_cjk(self) -> bool:
        return self.has_cjk and self.balance <= 0 and self.ahead <= LETTERS_AHEAD

    @property
    def open_bracket(self) -> bool:
        """Brackets that do not nest or do not close."""
        return self.crossed or bool(self.brackets)

    @property
    def last(self) -> str:
        return self.tail.rstrip()[-1:]

    @property
    def in_one_bracket(self) -> bool:
        closed = self.last and t.BRACKETS.get(self.head[:1]) == self.last
        return bool(closed) and self.mostly_cjk and self.depth == 0 and not self.sunk

    def ends_like_sentence(self, level: int = 2) -> bool:
        body = self.tail.rstrip()
        inner = body[:-1].rstrip()
        if not body:
            return False
        last, mark = body[-1], inner[-1:]
        quoted = bool(mark) and (last in _CLOSERS or last in "）)")
        if last in t.STRONG_ENDS or quoted and mark in t.STRONG_ENDS:
            return True
        if level < 2 and last in "；：;:":
            return True
        if not self.mostly_cjk:
            return False
        if quoted and mark == "." and is_cjk(inner[:-1].rstrip()[-1:] or " "):
            return True
        if level >= 3:
            return last in ".:" and is_cjk(body[-2:-1] or " ")
        return last in "：…" or body.endswith("...")


def _telling_runs(s: str) -> Iterator[tuple[str, str]]:
    """Runs of CJK and of letters, and single brackets, in order."""
    return ((m.lastgroup, m[0]) for m in _RUNS.finditer(s))


def _end_of(s: str) -> str:
    """The end of a long text, far enough back to hold TAIL characters whatever spaces stand between."""
    n = TAIL
    while n < len(s) and len(_SPACE_RUN.sub(" ", s[-n:])) <= TAIL:
        n *= 2
    return s[-n:]


def is_metadata(s: str) -> bool:
    """A short `key: value` line with a known key."""
    body = s.lstrip(t.SPACES)
    if not body or units(s) > 30:
        return False
    at = next((i for i, c in enumerate(body) if c in t.METADATA_SEPARATORS), -1)
    value = body[at + 1 :].lstrip(t.SPACES)
    if at <= 0 or at > _LONGEST_KEY or not value:
        return False
    return trim(body[:at]) in t.METADATA_KEYS and value[0] not in t.DIALOG


def is_heading(s: str) -> bool:
    s = trim(s)
    if not s or s.startswith("=== ") and s.endswith("===") or unclosed_bracket(s) or unclosed_quote(s):
        return False
    last, size = s[-1], units(s)
    if len(s) >= 3 and t.BRACKETS.get(s[0]) == last and mostly_cjk(s):
        return True
    most = 16 if all_ascii(s) or mixed_cjk_ascii(s) else 8
    if last in t.COLONS and size <= most and len(s) > 1 and all_cjk(s[:-1]):
        return True
    comma = any(c in t.COMMAS for c in s)
    if last in "）)" and not comma:
        return True
    if last in t.CLAUSE_ENDS or comma or size > most:
        return False
    if s.isascii():
        return s.isdigit() or any(c.isalpha() for c in s)
    return True


# ---- repeats inside a line


def collapse_words(words: list[str]) -> list[str]:
    """The first phrase of up to 8 words that stands three times or more in a row is left once."""
    n = len(words)
    for start in range(n):
        for size in range(1, min(8, n - start) + 1):
            phrase, end = words[start : start + size], start + size
            while words[end : end + size] == phrase:
                end += size
            if end - start >= 3 * size:
                return words[: start + size] + words[end:]
    return words


def collapse_word(word: str) -> str:
    """A word made of one unit of 4 to 10 characters, three times or more, becomes the unit."""
    if 4 <= len(word) <= 100:
        for size in range(4, min(10, len(word) // 3) + 1):
            if len(word) % size == 0 and word == word[:size] * (len(word) // size):
                return word[:size]
    return word


def collapse_repeats(line: str) -> str:
    words = [w for w in re.split("[ \t]", line) if w]
    return " ".join(map(collapse_word, collapse_words(words))) if words else line


# ---- reflow


class Line:
    """A line as the rules see it."""

    def __init__(self, raw: str, text: str):
        self.raw, self.text = raw, text
        self.probe = text.lstrip(" 　")
        self.body = text.rstrip(t.SPACES)
        self.last = self.body[-1:]

    @cached_property
    def opens_dialog(self) -> bool:
        return self.text.lstrip(t.SPACES)[:1] in t.DIALOG

    @cached_property
    def is_list(self) -> bool:
        return bool(_LIST.match(self.text.lstrip(t.SPACES)))

    @cached_property
    def closes_dialog(self) -> bool:
        return self.last in _CLOSERS and bool(self.last)

    @cached_property
    def open_bracket(self) -> bool:
        if not self.is_list:
            return unclosed_bracket(self.text)
        body = self.text.lstrip(t.SPACES)
        return unclosed_bracket(_LIST_CLOSER.sub("", body, count=1) if _LIST_CLOSER.match(body) else body)

    @cached_property
    def open_quote(self) -> bool:
        return unclosed_quote(self.text)

    @cached_property
    def complete(self) -> bool:
        return bool(self.last) and (self.last in t.STRONG_ENDS or self.last in t.COLONS or self.last == "…" or self.body.endswith(".."))


class Paragraphs:
    """The paragraph being gathered and those that are done."""

    def __init__(self):
        self.done: list[str] = []
        self.parts: list[str] = []
        self.shape = Shape()
        self.quotes: Counter[str] = Counter()

    def add(self, line: Line) -> None:
        self.parts.append(line.text)
        self.shape.add(line.text)
        for c in _QUOTE.findall(line.text):
            if c in t.DIALOG:
                self.quotes[c] += 1
            elif (q := _QUOTE_OF.get(c)) and self.quotes[q]:
                self.quotes[q] -= 1

    def resume(self, text: str, quotes: str) -> None:
        """Goes on with a paragraph that was left open."""
        self.parts, self.shape, self.quotes = [text] if text else [], Shape(text), Counter(quotes)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def end(self) -> None:
        if self.parts:
            self.done.append(self.text)
        self.parts, self.shape = [], Shape()
        self.quotes.clear()

    def alone(self, line: Line) -> None:
        self.end()
        self.done.append(line.text)

    def restart(self, line: Line) -> None:
        self.end()
        self.add(line)

    @property
    def in_dialog(self) -> bool:
        return any(self.quotes.values())

    @property
    def in_bracket(self) -> bool:
        return self.shape.open_bracket

    @property
    def last(self) -> str:
        return self.shape.last


def _blank(p: Paragraphs, header: bool) -> None:
    """A blank line ends a paragraph only where the text does, unless pages are marked."""
    if p.parts and not header and (p.in_dialog or p.in_bracket or p.last and p.last not in t.STRONG_ENDS):
        return
    p.end()


def _splits_as_heading(p: Paragraphs, line: Line) -> bool:
    if not p.parts or not p.last and not p.in_bracket:
        return True
    if p.in_bracket or p.last in t.COMMAS:
        return False
    goes_on = all_cjk(line.text, spaces=True) or line.last in t.COLONS or line.last in ("）", ")")
    return not goes_on or p.last in t.CLAUSE_ENDS


def _start(p: Paragraphs, line: Line) -> None:
    """A line that opens a dialog or a list item."""
    closed = not line.open_bracket and not line.open_quote
    if closed and (line.opens_dialog and line.closes_dialog):
        p.alone(line)
        return
    if closed and line.is_list and line.complete:
        quotes = p.quotes.copy()
        p.alone(line)
        p.quotes = quotes  # a list item leaves an open dialog as it is
        return
    follows_item = line.is_list and bool(_LIST.match(p.shape.head))
    ended = p.last and p.last not in t.COMMAS and not is_cjk(p.last) and not p.in_dialog and not p.in_bracket
    quotes = p.quotes.copy()
    if p.parts and (follows_item or ended):
        p.end()
        p.quotes = quotes
    if line.opens_dialog:
        p.quotes = Counter()
    p.add(line)


def _close_dialog(p: Paragraphs, line: Line) -> None:
    mark = line.body[:-1].rstrip(t.SPACES)[-1:] or p.last
    strong = bool(mark) and mark in t.CLAUSE_ENDS
    bracket = p.in_bracket
    p.add(line)
    if not p.in_dialog and strong and (not bracket or line.open_bracket or p.shape.units > LONG_BUFFER):
        p.end()


def take(p: Paragraphs, line: Line, header: bool) -> None:
    if is_divider(line.probe):
        p.alone(line)
        return
    line = Line(line.raw, collapse_repeats(line.text))
    if not line.text:
        _blank(p, header)
        return
    page = line.text.startswith("=== ") and line.text.endswith("===")
    if page or _TITLE.match(line.probe) or is_metadata(line.probe) or is_heading(line.probe) and _splits_as_heading(p, line):
        p.alone(line)
        return
    if line.opens_dialog or line.is_list:
        _start(p, line)
        return
    plain_end = not p.in_dialog and not line.closes_dialog and not line.open_quote and line.complete
    if p.parts:
        if plain_end and (p.shape.units > LONG_BUFFER or not p.in_bracket):
            p.add(line)
            p.end()
        elif line.closes_dialog:
            _close_dialog(p, line)
        elif not p.in_dialog and (p.shape.ends_like_sentence() and not p.in_bracket or p.shape.in_one_bracket or _INDENT.match(line.raw)):
            p.restart(line)
        else:
            p.add(line)
    elif plain_end and not line.open_bracket:
        p.alone(line)
    else:
        p.restart(line)


def paragraphs(text: str | None, header: bool = False) -> list[str]:
    if not text or not trim(text):
        return []
    p = Paragraphs()
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        take(p, Line(raw, raw.rstrip(t.SPACES).lstrip(" ")), header)
    p.end()
    return p.done


def reflow_text(text: str | None, header: bool = False, compact: bool = False) -> str:
    return ("\n" if compact else "\n\n").join(paragraphs(text, header))


def reflow(col: Column, header: bool = False) -> Column:
    """array<string>: the paragraphs of each document; null stays null."""

    @pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: paragraphs(x, header), na_action="ignore")

    return run(col)


def reflow_joined(col: Column, header: bool = False, compact: bool = False) -> Column:
    return F.array_join(reflow(col, header), "\n" if compact else "\n\n")


def reflow_rows(df: DataFrame, col: str, header: bool = False) -> DataFrame:
    """One row for each paragraph."""
    return df.select(*[c for c in df.columns if c != col], F.posexplode(reflow(F.col(col), header)).alias("para_no", "para"))


# ---- line predicates in SQL functions


def metadata_key(col: Column) -> Column:
    """The key of a metadata line, null for other lines."""
    sep, quotes = re.escape(t.METADATA_SEPARATORS), "".join(t.DIALOG)
    space = char_class(t.SPACES)
    m = lambda g: F.regexp_extract(col, f"(?s)^[{space}]*([^{sep}]+)[{sep}][{space}]*([^{space}])", g)
    key = F.regexp_replace(m(1), f"[{space}]+$", "")
    ok = (F.octet_length(F.encode(col, "UTF-16LE")) <= 2 * 30) & key.isin(*sorted(t.METADATA_KEYS)) & (F.instr(F.lit(quotes), m(2)) == 0)
    return F.when(ok, key)


def is_divider_line(col: Column) -> Column:
    body = F.regexp_replace(col, f"[{char_class(t.SPACES)}]", "")
    return body.rlike("^(?:[\\x{2500}-\\x{257F}]{3,}|[-=_~～]{3,}|[*＊★☆]{3,})$")


def collapse_token(col: Column) -> Column:
    """A single word that is one unit of 4 to 10 characters repeated."""
    hit = F.char_length(col).between(4, 100) & col.rlike("^(.{4,10}?)\\1{2,}$")
    return F.when(hit, F.regexp_replace(col, "^(.{4,10}?)\\1{2,}$", "$1")).otherwise(col)


def cjk_counts(col: Column) -> Column:
    """struct(cjk, ascii_letters, digits, other)."""
    n = lambda keep: F.char_length(F.regexp_replace(col, f"[^{keep}]", ""))
    cjk, letters, digits = n(_CJK), n("A-Za-z"), n("0-9０-９")
    return F.struct(cjk.alias("cjk"), letters.alias("ascii_letters"), digits.alias("digits"), (F.char_length(col) - cjk - letters - digits).alias("other"))
