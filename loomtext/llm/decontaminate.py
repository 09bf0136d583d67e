"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams against every document.

Defined results. Null or empty text, or a text without words: no words, nothing hit. A benchmark row with a
null item_id or without words is ignored; repeated item_ids count as one item. Every row of the documents
gives one row, repeated doc_ids included. An empty benchmark or an empty table gives clean or no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import batches_by_bytes, documents, gram_hashes, quoted, released, settled, word_hashes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # as bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing

#: Windows of one broadcast; a larger benchmark is scanned in as many slices as it needs.
SLICE_WINDOWS = 250_000


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.lower())


def benchmark_windows(benchmark: DataFrame, n: int = 8) -> DataFrame:
    """(item, window, size): every run of n words of an item, or all its words where it has fewer."""

    def run(batches):
        for b in batches:
            items, windows, sizes = [], [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                size = min(n, len(w))
                for i in range(len(w) - size + 1 if w else 0):
                    items.append(item)
                    windows.append(b" ".join(w[i : i + size]))
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary()), pa.array(sizes, pa.int32())], ["item", "window", "size"])

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(released(run), "item string, window binary, size int").distinct()


class Windows:
    """A slice of the benchmark: sorted hashes by window size to find candidates, exact windows to verify them."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = {}
        sizes: dict[int, set[bytes]] = {}
        for item, window, size in rows:
            self.items.setdefault(bytes(window), []).append(item)
            sizes.setdefault(size, set()).add(bytes(window))
        self.hashes = {}
        for size, found in sorted(sizes.items()):
            self.hashes[size] = np.unique(np.concatenate([gram_hashes(word_hashes(w.split(b" ")), size) for w in found]))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of verified windows, and the items that they belong to."""
        spans, items = [], set()
        h = word_hashes(words)
        for size, known in self.hashes.items():
            g = gram_hashes(h, size)
            at = np.searchsorted(known, g)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == g).tolist():
                if found := self.items.get(b" ".join(words[p : p + size])):
                    spans.append((p, p + size))
                    items.update(found)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_FOUND = T.StructType(
    [
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("n_words", T.LongType()),
    ]
)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 8, carry: list[str] | None = None, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """The carried columns with found = (hit_items, hit_spans in words, n_words); an own column of that name goes."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "found"]
    return scanned(docs, benchmark, n, carry, slice_windows).select("row.*", "found")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some ranges of its words; the bytes around them stay."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    pieces, last = [], 0
    for a, b in spans:
        pieces.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*pieces, raw[last:]]).decode("utf-8", "replace")


def scanned(docs: DataFrame, benchmark: DataFrame, n: int, carry: list[str], slice_windows: int = SLICE_WINDOWS, cut: bool = False) -> DataFrame:
    """(row, text, found): row holds the carried columns, text is null or, with cut, the text without its hit words.

    The broadcast is bounded by slice_windows: a benchmark with more windows goes over the documents slice by
    slice, each with its own bounded broadcast, and every slice adds to what earlier ones found.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n)
    total = windows.count()
    slices = max(1, -(-total // slice_windows))
    if slices > 1:
        windows = settled(windows)
    out = docs.select(F.struct(*map(quoted, carry)).alias("row"), "text", F.lit(None).cast(_FOUND).alias("found"))
    for i in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == i)
        index = spark.sparkContext.broadcast(Windows([(r.item, r.window, r.size) for r in part.toLocalIterator()]))

        last = i == slices - 1

        def run(batches, index=index, last=last):
            own = index.value
            for b in batches_by_bytes(batches, "text"):
                found, left = [], []
                for text, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = words_of(text)
                    spans, items = own.find(words)
                    if before:
                        spans += [(s["start"], s["end"]) for s in before["hit_spans"]]
                        items |= set(before["hit_items"])
                    spans = merged(spans)
                    found.append({"hit_items": sorted(items), "hit_spans": [{"start": a, "end": z} for a, z in spans], "n_words": len(words)})
                    if last:
                        left.append(None if not cut or text is None else without(text, spans) if spans else text)
                texts = pa.array(left, pa.string()) if last else b.column(1)
                yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(found, b.schema.field(2).type)], schema=b.schema)

        out = out.mapInArrow(released(run), out.schema)
        if not last:
            out = settled(out)
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 8, most_items: int = 2) -> DataFrame:
    """docs without those that hold windows of most_items or more items; hit words are cut out of the others.

    A document that loses words keeps the bytes around them; clean documents stay as they are.
    """
    kept = scanned(docs, benchmark, n, [c for c in docs.columns if c != "text"], cut=True).where(F.size("found.hit_items") < most_items)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("found.hit_spans") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), carry=["doc_id"])
    hit = F.aggregate("found.hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    n_items = F.size("found.hit_items").cast("long")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("found.hit_items", ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


OP1_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT rid, i, dw.m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
