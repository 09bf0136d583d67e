"""Dictionaries: text files, JSON, compressed JSON, CBOR and Parquet; immutable sets of slots.

Small tables come with the package. Larger ones are read from a directory of tab-separated text files, given as a
parameter, by the session's spark.loomtext.dicts or by LOOMTEXT_DICTS, or are given to provide(); a file belongs to the slot that its name spells (case, underscores and `Shinjitai`
aside). Slots that neither has are empty, apart from a small seed of Simplified characters.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..plans.slots import CustomSpec, Mode, Slot

ENV, SETTING = "LOOMTEXT_DICTS", "spark.loomtext.dicts"


def parse_dictionary(text: str) -> dict[str, str]:
    """`key<TAB>value [more]` lines; blank lines, `#` lines and lines without a tab are skipped, later keys win."""
    out: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        line = line.strip(tables.SPACES)
        if not line or line.startswith("#") or "\t" not in line:
            continue
        key, _, value = line.partition("\t")
        key, value = key.strip(tables.SPACES), value.strip(tables.SPACES).split(" ", 1)[0].strip(tables.SPACES)
        if key and value:
            out[key] = value
    return out


def read_dictionary(path: str | Path) -> dict[str, str]:
    return parse_dictionary(Path(path).read_text(encoding="utf-8-sig"))


def _slot_of(stem: str) -> Slot | None:
    try:
        return Slot.parse(re.sub("shinjitai", "s", stem, flags=re.I))
    except ValueError:
        return None


@dataclass(frozen=True)
class Dictionaries:
    """All slots; changing one gives a new object."""

    slots: Mapping[str, Mapping[str, str]]

    def __post_init__(self):
        full = {s.label: MappingProxyType(dict(self.slots.get(s.label) or {})) for s in Slot}
        object.__setattr__(self, "slots", MappingProxyType(full))

    def __getitem__(self, slot: str | Slot) -> Mapping[str, str]:
        return self.slots[slot.label if isinstance(slot, Slot) else slot]

    def __reduce__(self):
        return Dictionaries, ({k: dict(v) for k, v in self.slots.items()},)

    def with_custom(self, *specs: CustomSpec | None) -> Dictionaries:
        """Specs in order; for each its files, then its pairs. The receiver stays as it is."""
        slots = {k: dict(v) for k, v in self.slots.items()}
        for spec in specs:
            if spec is None:
                continue
            own: dict[str, str] = {}
            for path in spec.paths:
                own |= read_dictionary(path)
            own |= {k: v if v is not None else "" for k, v in spec.pairs.items() if k}
            label = spec.slot.label
            slots[label] = own if spec.mode is Mode.OVERRIDE else slots[label] | own
        return Dictionaries(slots)

    def require(self, *labels: str) -> Dictionaries:
        for label in labels:
            if not self.slots[label]:
                raise ValueError(f"dictionary slot {label} is empty")
        return self

    # ---- forms

    def to_json(self, indent: int | None = 2, ascii_only: bool = False) -> str:
        return json.dumps({k: dict(v) for k, v in self.slots.items()}, ensure_ascii=ascii_only, indent=indent)

    @classmethod
    def from_json(cls, text: str | bytes) -> Dictionaries:
        """Unknown members are ignored; a slot may be a map or an object whose `dict` is the map."""
        slots = {}
        for k, v in json.loads(text).items():
            if (slot := _slot_of(k)) is not None and isinstance(v, dict):
                inner = next((v[n] for n in ("dict", "Dict") if isinstance(v.get(n), dict)), v)
                slots[slot.label] = {a: b for a, b in inner.items() if isinstance(b, str)}
        return cls(slots)

    def to_zstd(self, level: int = 19) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(self.to_json(indent=None).encode())

    @classmethod
    def from_zstd(cls, raw: bytes) -> Dictionaries:
        import zstandard

        return cls.from_json(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read())

    def to_cbor(self) -> bytes:
        return cbor_dumps({k: dict(v) for k, v in self.slots.items()})

    @classmethod
    def from_cbor(cls, raw: bytes) -> Dictionaries:
        return cls.from_json(json.dumps(cbor_loads(raw)))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(label, k, v, i) for label, own in self.slots.items() for i, (k, v) in enumerate(own.items())]
        return spark.createDataFrame(rows, "slot string, key string, value string, ord long")

    @classmethod
    def from_df(cls, df: DataFrame) -> Dictionaries:
        """From (slot, key, value, ord); of repeated keys the last counts. A dictionary is driver-sized by nature."""
        slots: dict[str, dict[str, str]] = {}
        for r in df.orderBy("slot", "ord").toLocalIterator():
            slots.setdefault(r.slot, {})[r.key] = r.value
        return cls(slots)

    def write_parquet(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> Dictionaries:
        return cls.from_df(spark.read.parquet(path))

    def save(self, path: str | Path) -> None:
        """By suffix: .json, .zstd or .zst, .cbor."""
        path = Path(path)
        suffix = path.suffix.lower()
        if suffix == ".json":
            path.write_text(self.to_json(), encoding="utf-8")
        elif suffix in (".zst", ".zstd"):
            path.write_bytes(self.to_zstd())
        elif suffix == ".cbor":
            path.write_bytes(self.to_cbor())
        else:
            raise ValueError(f"unknown dictionary format: {suffix!r}")

    @classmethod
    def load(cls, path: str | Path) -> Dictionaries:
        path = Path(path)
        raw = path.read_bytes()
        match path.suffix.lower():
            case ".json":
                return cls.from_json(raw)
            case ".zst" | ".zstd":
                return cls.from_zstd(raw)
            case ".cbor":
                return cls.from_cbor(raw)
        raise ValueError(f"unknown dictionary format: {path.suffix!r}")


def decode_surrogate_pairs(text: str) -> str:
    r"""Escaped pairs like 𠮷 as the characters that they stand for; all else stays."""
    return re.sub(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", lambda m: chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), text)


# ---- CBOR of maps, texts and numbers (RFC 8949)


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, fmt in ((24, ">B"), (25, ">H"), (26, ">I"), (27, ">Q")):
        if n < 1 << 8 * struct.calcsize(fmt):
            return bytes([major << 5 | code]) + struct.pack(fmt, n)
    raise ValueError("number too large")


def cbor_dumps(x) -> bytes:
    if isinstance(x, bool) or x is None:
        return {False: b"\xf4", True: b"\xf5", None: b"\xf6"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, Mapping):
        return _head(5, len(x)) + b"".join(cbor_dumps(k) + cbor_dumps(v) for k, v in x.items())
    if isinstance(x, Iterable):
        x = list(x)
        return _head(4, len(x)) + b"".join(map(cbor_dumps, x))
    raise TypeError(type(x).__name__)


def cbor_loads(raw: bytes):
    f = io.BytesIO(raw)

    def item():
        first = f.read(1)[0]
        major, n = first >> 5, first & 31
        if major == 7:
            return {20: False, 21: True, 22: None, 23: None}[n]
        endless = n == 31
        if 24 <= n <= 27:
            n = int.from_bytes(f.read(1 << n - 24), "big")
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            part = b"" if endless else f.read(n)
            while endless and (more := item()) is not _BREAK:
                part += more if isinstance(more, bytes) else more.encode()
            return part if major == 2 else part.decode()
        if major == 6:
            return item()
        many = iter(int, 1) if endless else range(n)
        if major == 4:
            out = []
            for _ in many:
                if peek():
                    break
                out.append(item())
            return out
        table = {}
        for _ in many:
            if peek():
                break
            k = item()
            table[k] = item()
        return table

    def peek() -> bool:
        at = f.tell()
        if f.read(1) == b"\xff":
            return True
        f.seek(at)
        return False

    return item()


_BREAK = object()


# ---- where dictionaries come from


def builtin() -> dict[str, dict[str, str]]:
    return {
        "st_punctuations": tables.pairs(tables.ST_PUNCTUATIONS),
        "ts_punctuations": tables.pairs(tables.TS_PUNCTUATIONS),
        "tw_variants": tables.pairs(tables.TW_VARIANTS),
        "tw_variants_rev": tables.pairs(tables.TW_VARIANTS_REV),
        "tw_variants_phrases": tables.pairs(tables.TW_VARIANTS_PHRASES),
        "hk_variants": tables.pairs(tables.HK_VARIANTS),
        "hk_variants_rev": tables.pairs(tables.HK_VARIANTS_REV),
        "hk_phrases": tables.pairs(tables.HK_PHRASES),
        "hk_phrases_rev": tables.pairs(tables.HK_PHRASES_REV),
        "st_characters": tables.seed(),
        "ts_characters": tables.seed(reverse=True),
    }


def directory(path: str | None = None) -> Path | None:
    session = SparkSession.getActiveSession()
    path = path or (session and session.conf.get(SETTING, None)) or os.environ.get(ENV)
    return Path(path) if path else None


_provided: Dictionaries | None = None


def provide(dicts: Dictionaries | None) -> None:
    """What load() gives from now on where no path is named; None goes back to the tables and the directory. Plans
    take their dictionaries when they are made, so those made before stay as they are."""
    global _provided
    _provided = dicts


@lru_cache(maxsize=8)
def _load(path: str | None) -> Dictionaries:
    slots = builtin()
    if path:
        for f in sorted(Path(path).glob("*.txt")):
            if (slot := _slot_of(f.stem)) is not None:
                slots[slot.label] = read_dictionary(f)
    return Dictionaries(slots)


def load(path: str | None = None) -> Dictionaries:
    """Built-in tables, replaced slot by slot by what the directory has."""
    if path is None and _provided is not None:
        return _provided
    found = directory(path)
    return _load(str(found) if found else None)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of dictionary files that only Spark reaches; the last of repeated keys counts, by line."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("ord", "line"))
    line = F.trim(F.regexp_replace("line", "^﻿|[\\s　]+$|^\\s+", ""))
    rows = lines.withColumn("line", line).where("line <> '' AND line NOT LIKE '#%' AND line LIKE '%\t%'")
    key = F.trim(F.split_part("line", F.lit("\t"), F.lit(1)))
    value = F.trim(F.substring_index(F.trim(F.expr("substring(line, instr(line, '\t') + 1)")), " ", 1))
    rows = rows.select("file", "ord", key.alias("key"), value.alias("value")).where("key <> '' AND value <> ''")
    return rows.groupBy("file", "key").agg(F.max_by("value", "ord").alias("value"))
