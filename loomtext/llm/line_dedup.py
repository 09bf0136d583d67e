"""Line dedup over levelled sorted runs of line hashes.

The store holds runs: tables of (key hash, first doc_id), bucketed and sorted by the hash, so that a merge join
reads a run without shuffling or sorting it. A new batch is reduced to its first document for each key, anti-joined
with every run, and what is new becomes a run of level 0. A level that has `fanout` runs is merged into one run of
the next level, so a store of n batches holds about fanout x log(n) runs.

Batches are given in order of doc_id; then the runs together hold the smallest document of every key. The lines of
a document are then looked up in the runs. Keys of very many documents would fill one bucket of that join: they are
found in a sample, looked up once in the runs, and joined by a broadcast.

Defined results. Text is split at \\n; null or empty text is one empty line. A key is a line without [\\x20\\x09-\\x0D]
at both ends, A-Z lower-cased; keys of fewer than 10 code points are never dropped. Rows with one doc_id count as one
document; a null doc_id comes after all others. Every input row gives one output row. Own columns n_lines and
n_dropped go.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import LAST_ID, batches_by_bytes, documents, ids_of, quoted, released, row_of, scratch, settled

SPACE = b" \t\n\v\f\r"
LEAST = 10
#: A key is hot from so many documents on, or from a HOT_KEYS-th of all keys' documents if that is more. One row of
#: SAMPLED (by a hash) shows which; a key that is missed or found too much changes no result.
HOT_ROWS, HOT_KEYS, SAMPLED = 2000, 10_000, 32


def key_of(line: bytes) -> bytes | None:
    """The key of a line, None where it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < LEAST or not key.isascii() and len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return key


def line_keys(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id): the distinct keys of each row, as 128-bit hashes."""

    def run(batches):
        for b in batches_by_bytes(batches, "text"):
            digests, counts = [], []
            for text in b.column(1).to_pylist():
                own = {xxhash.xxh3_128_digest(k) for x in (text or "").encode().split(b"\n") if (k := key_of(x)) is not None}
                digests += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.repeat(ids_of(b.column(0)), counts))], ["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "h1 long, h2 long, doc_id long")


class Runs:
    """Levelled sorted runs of (h1, h2, doc_id) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, "h1", "h2")
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", scratch(self.spark)).option("compression", "zstd").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: its keys that no run has yet, with their smallest document."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for run in self.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(new))
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = self.spark.table(level[0])
            for name in level[1:]:
                merged = merged.unionByName(self.spark.table(name))  # no key is in two runs
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(merged))
            self.levels[i] = []
            for name in level:
                self._drop(name)

    def close(self) -> None:
        """Drops all runs."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []

    def _drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"])
        self.spark.sql(f"DROP TABLE {name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def earlier(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose key a smaller document holds."""
        found = None
        for run in self.runs():
            hit = keys.join(run.withColumnRenamed("doc_id", "first").hint("merge"), ["h1", "h2"]).where("first < doc_id").drop("first")
            found = hit if found is None else found.unionByName(hit)
        return keys.limit(0) if found is None else found


def hot_keys(keys: DataFrame, hot_rows: int, sampled: int) -> DataFrame:
    """(h1, h2): keys that many documents hold, as a sample of the rows shows; at most about HOT_KEYS."""
    part = keys.where(F.pmod(F.xxhash64("h1", "h2", "doc_id"), F.lit(sampled)) == 0)
    most = max(hot_rows, keys.count() // HOT_KEYS) // sampled
    return settled(part.groupBy("h1", "h2").count().where(F.col("count") > most).select("h1", "h2"))


def gone_lines(docs: DataFrame, batches: int, fanout: int, hot_rows: int, sampled: int) -> DataFrame:
    """(doc_id, gone): hashes of the lines of each document that a smaller one holds, null ids as LAST_ID."""
    keys = settled(line_keys(docs))
    bounds = keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({min(int(b), LAST_ID - 1) for b in bounds})
    runs = Runs(docs.sparkSession, fanout)
    for low, high in zip([None, *edges], [*edges, None]):
        part = keys
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    hot = hot_keys(keys, hot_rows, sampled)
    early = runs.earlier(keys.join(F.broadcast(hot), ["h1", "h2"], "left_anti"))
    for run in runs.runs():
        first = run.withColumnRenamed("doc_id", "first").join(F.broadcast(hot), ["h1", "h2"])
        early = early.unionByName(keys.join(F.broadcast(first), ["h1", "h2"]).where("first < doc_id").drop("first"))
    gone = settled(early.groupBy("doc_id").agg(F.collect_set("h1").alias("gone")))  # at most the lines of a document
    runs.close()
    return gone


def deduped(docs: DataFrame, batches: int = 4, fanout: int = 4, hot_rows: int = HOT_ROWS, sampled: int = SAMPLED) -> DataFrame:
    """(row, kept, n_lines, n_dropped): row holds docs' columns, kept the text that stays (null where text is null and
    nothing goes)."""
    gone = gone_lines(docs, batches, fanout, hot_rows, sampled).withColumnRenamed("doc_id", "id")
    rows = docs.select(row_of(docs), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"))
    rows = rows.join(gone, "id", "left").select("row", "text", "gone")

    def run(parts):
        for b in batches_by_bytes(parts, "text"):
            kept, n, dropped = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = (text or "").encode().split(b"\n")
                n.append(len(lines))
                if not gone:
                    kept.append(text)
                    dropped.append(0)
                    continue
                gone, left = set(gone), []
                for x in lines:
                    k = key_of(x)
                    if k is None or int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True) not in gone:
                        left.append(x)
                kept.append(b"\n".join(left).decode("utf-8", "replace"))
                dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    more = T.StructType.fromDDL("kept string, n_lines long, n_dropped long")
    return rows.mapInArrow(released(run), T.StructType([rows.schema["row"], *more]))


def line_dedup(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """docs with kept text, n_lines and n_dropped; the parameters are those of deduped()."""
    out = deduped(docs, *args, **kwargs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in own], "n_lines", "n_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT rid, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT rid, k.doc_id, i, line, (f.key IS NOT NULL AND k.doc_id > f.first) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
