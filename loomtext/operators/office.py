"""Office and EPUB packages: a package is a binary value, converted whole or entry by entry."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.dictionaries import Dictionaries
from .convert import rounds_of
from .matcher import pipeline_for

FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")

# ---- fixed values: entries and attributes of the formats -------------------------------------------

#: Which entries hold text, by format, on lower-cased names with forward slashes.
ENTRIES = {
    "docx": r"^word/document\.xml$",
    "xlsx": r"^xl/sharedstrings\.xml$|^xl/worksheets/.*\.xml$",
    "pptx": r"^ppt/(?:(?:.*/)?slide[^/]*|.*(?:notesslide|slidemaster|slidelayout|comment).*)\.xml$",
    "odt": r"^content\.xml$",
    "ods": r"^content\.xml$",
    "odp": r"^content\.xml$",
    "epub": r"\.(?:xhtml|html|opf|ncx)$",
}

#: What names a font, by format: kept as it is when fonts are to be kept.
FONTS = {
    "docx": r'(?:w:eastAsia|w:ascii|w:hAnsi|w:cs)="[^"]*"',
    "xlsx": r'val="[^"]*"',
    "pptx": r'typeface="[^"]*"',
    "odt": r"(?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=(?:\"[^\"]*\"|'[^']*')",
    "ods": r"(?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=(?:\"[^\"]*\"|'[^']*')",
    "odp": r"(?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=(?:\"[^\"]*\"|'[^']*')",
    "epub": r"font-family\s*:\s*[^;\"']+",
}

# ---- packages

_INLINE = re.compile(r"""(<(?:\w+:)?c\b[^>]*\bt\s*=\s*["']inlineStr["'][^>]*>)(.*?)(</(?:\w+:)?c>)""", re.S)
_INLINE_TEXT = re.compile(r"(<(?:\w+:)?t\b[^>]*>)(.*?)(</(?:\w+:)?t>)", re.S)


class OfficeError(ValueError):
    """A package that cannot be converted."""


def parse_format(name: str | None) -> str:
    key = (name or "").strip().lower().lstrip(".")
    if key not in FORMATS:
        raise OfficeError(f"unsupported format: {name!r}")
    return key


def entry_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("\\"), F.lit("/")))


def is_text_entry(name: Column, fmt: Column) -> Column:
    """The entry selection as a SQL predicate."""
    out = F.lit(False)
    for f, pattern in ENTRIES.items():
        out = F.when(fmt == f, entry_name(name).rlike(pattern)).otherwise(out)
    return out


def _outside(text: str, keep: re.Pattern, convert: Callable[[str], str]) -> str:
    """Converts what lies between matches of keep."""
    out, last = [], 0
    for m in keep.finditer(text):
        out += [convert(text[last : m.start()]), m[0]]
        last = m.end()
    return "".join([*out, convert(text[last:])])


def convert_entry(text: str, fmt: str, name: str, convert: Callable[[str], str], keep_font: bool = False) -> str:
    own = name.replace("\\", "/").lower()
    if fmt == "xlsx" and own.startswith("xl/worksheets/"):
        inner = lambda m: m[1] + convert(m[2]) + m[3]
        return _INLINE.sub(lambda m: m[1] + _INLINE_TEXT.sub(inner, m[2]) + m[3], text)
    return _outside(text, re.compile(FONTS[fmt]), convert) if keep_font else convert(text)


def convert_package(raw: bytes, fmt: str, convert: Callable[[str], str], keep_font: bool = False) -> bytes:
    """The package with its text entries converted; times, folders and other entries stay. An EPUB's mimetype comes
    first and is stored."""
    fmt = parse_format(fmt)
    if not raw:
        raise OfficeError("empty package")
    wanted, done, out = re.compile(ENTRIES[fmt]), 0, io.BytesIO()
    try:
        source = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise OfficeError(f"not a package: {e}") from e
    with source, zipfile.ZipFile(out, "w") as target:
        infos = source.infolist()
        if fmt == "epub":
            first = [i for i in infos if i.filename == "mimetype"]
            if not first:
                raise OfficeError("an EPUB needs a mimetype entry")
            infos = first[:1] + [i for i in infos if i.filename != "mimetype"]
        for info in infos:
            data = b"" if info.is_dir() else source.read(info)
            new = zipfile.ZipInfo(info.filename, info.date_time)
            new.external_attr = info.external_attr
            new.compress_type = zipfile.ZIP_STORED if info.is_dir() or info.filename == "mimetype" else zipfile.ZIP_DEFLATED
            if not info.is_dir() and wanted.search(info.filename.replace("\\", "/").lower()):
                data = convert_entry(data.decode("utf-8-sig"), fmt, info.filename, convert, keep_font).encode()
                done += 1
            target.writestr(new, data)
    if not done:
        raise OfficeError("no entry was converted")
    return out.getvalue()


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, content) of package files; the format is the suffix."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("format"), "content").where(F.col("format").isin(*FORMATS))


def explode_entries(packages: DataFrame) -> DataFrame:
    """(path, format, idx, name, content, stored): one row for each entry."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    rows = [(r.path, r.format, i, e.filename, b"" if e.is_dir() else z.read(e), e.compress_type == zipfile.ZIP_STORED) for i, e in enumerate(z.infolist())]
                yield pd.DataFrame(rows, columns=["path", "format", "idx", "name", "content", "stored"])

    return packages.select("path", "format", "content").mapInPandas(run, "path string, format string, idx int, name string, content binary, stored boolean")


def convert_packages(packages: DataFrame, config: str, punctuation: bool = False, keep_font: bool = False, dicts: Dictionaries | None = None) -> DataFrame:
    """(path, format, success, message, content): failures are rows with a message."""
    rounds = tuple(tuple(r.items()) for r in rounds_of(config, punctuation, dicts) if r)

    @pandas_udf("success boolean, message string, content binary")
    def run(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
        convert, out = pipeline_for(rounds, False), []
        for raw, f in zip(content, fmt):
            try:
                out.append((True, "converted", convert_package(raw, f, convert, keep_font)))
            except (OfficeError, UnicodeDecodeError, zipfile.BadZipFile) as e:
                out.append((False, str(e), None))
        return pd.DataFrame(out, columns=["success", "message", "content"])

    return packages.withColumn("r", run("content", "format")).select("path", "format", "r.success", "r.message", "r.content")


def write_packages(converted: DataFrame, folder: str, root: str | None = None) -> None:
    """Each successful package under its path below `root`, or under its base name: a sibling temporary file,
    checked, then moved into place. Two packages for one name are an error, before anything is written.

    The folder is one that all executors share.
    """
    name = F.regexp_extract("path", "[^/]+$", 0)
    if root is not None:
        below = root.rstrip("/") + "/"
        name = F.when(F.col("path").startswith(below), F.expr(f"substring(path, {len(below) + 1})"))
    rows = converted.withColumn("target", name)
    wrong = rows.groupBy("target").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1 OR target IS NULL OR target = '' OR concat('/', target, '/') LIKE '%/../%'").first()
    if wrong is not None:
        raise OfficeError(f"{wrong['n']} packages for the name {wrong['target']!r}, such as {wrong['path']!r}")

    def run(rows):
        for r in rows:
            path = os.path.join(folder, r.target)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            save(r.content, path)

    os.makedirs(folder, exist_ok=True)
    rows.where("success").select("target", "content").foreachPartition(run)


def save(raw: bytes, path: str) -> None:
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
        with zipfile.ZipFile(temp) as z:
            if z.testzip() is not None:
                raise OfficeError("the package written is damaged")
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
