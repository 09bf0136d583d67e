"""Text with encodings, and extracted pages."""

from __future__ import annotations

import codecs
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_ALIASES = {"unicode": "utf-16le", "utf8": "utf-8", "utf16": "utf-16le", "utf-16": "utf-16le", "utf32": "utf-32le", "utf-32": "utf-32le", "sjis": "shift_jis", "shift-jis": "shift_jis", "gb2312": "gbk"}


def codec(name: str | None) -> str:
    key = (name or "utf-8").strip().lower()
    return codecs.lookup(_ALIASES.get(key, key)).name


def decode(col: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text by any codec, a byte-order mark left out. UTF-8 and UTF-16 stay in SQL functions."""
    name = codec(encoding)
    if name in ("utf-8", "utf-16-le", "utf-16-be"):
        text = F.decode(col, {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}[name])
        return F.regexp_replace(text, "^\\x{FEFF}", "")

    @pandas_udf("string")
    def run(s):
        return s.map(lambda b: bytes(b).decode(name, "replace").removeprefix("﻿"), na_action="ignore")

    return run(col)


def encode(col: Column, encoding: str = "utf-8") -> Column:
    """Text as bytes, with a byte-order mark for UTF-16 and UTF-32. UTF-8 and UTF-16 stay in SQL functions."""
    name = codec(encoding)
    if name == "utf-8":
        return F.encode(col, "UTF-8")
    if name in ("utf-16-le", "utf-16-be"):
        big = name.endswith("be")
        return F.concat(F.lit(codecs.BOM_UTF16_BE if big else codecs.BOM_UTF16_LE), F.encode(col, "UTF-16BE" if big else "UTF-16LE"))
    mark = {"utf-32-le": codecs.BOM_UTF32_LE, "utf-32-be": codecs.BOM_UTF32_BE}.get(name, b"")

    @pandas_udf("binary")
    def run(s):
        return s.map(lambda x: mark + x.encode(name, "replace"), na_action="ignore")

    return run(col)


def read_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, text): whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode(F.col("content"), encoding).alias("text"))


def write_text(df: DataFrame, col: str, path: str) -> None:
    df.select(col).write.text(path)


def write_encoded(df: DataFrame, col: str, folder: str, encoding: str = "utf-8") -> None:
    """One file for each row, in a folder that all executors share; each is written aside and moved into place."""
    rows = df.select(encode(F.col(col), encoding).alias("content"))
    os.makedirs(folder, exist_ok=True)

    def run(part):
        for r in part:
            own = os.path.join(folder, f".part-{uuid.uuid4().hex}")
            with open(own, "wb") as f:
                f.write(r.content)
            os.replace(own, os.path.join(folder, os.path.basename(own)[1:] + ".txt"))

    rows.foreachPartition(run)


def assemble_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", header: bool = False) -> DataFrame:
    """(doc, text): pages in order, each followed by a blank line; blank pages leave one. With headers each page
    begins with `=== [Page i/n] ===`."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^[\\r\\n ]+|[\\r\\n ]+$", "")
    rows = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("b")))).alias("ps"))
    blank = lambda x: F.regexp_replace(x["b"], "[\\s\\x{3000}\\x{85}\\x{A0}]", "") == ""
    head = lambda i: F.concat(F.lit("=== [Page "), (i + 1).cast("string"), F.lit("/"), F.size("ps").cast("string"), F.lit("] ===\n")) if header else F.lit("")
    parts = F.transform("ps", lambda x, i: F.concat(head(i), F.when(blank(x), F.lit("\n")).otherwise(F.concat(x["b"], F.lit("\n\n")))))
    return rows.select(doc, F.array_join(parts, "").alias("text"))
