"""Quality rules: base signals of a text and a hashed n-gram log-likelihood ratio.

The model holds two multinomials over hashed byte n-grams: one of labelled good documents (the trusted target),
one of the whole raw corpus. A document's score is the mean log ratio over its n-grams, so it does not depend on
length. Every document is compared with one threshold: the middle of the gap that best splits good from bad labels
among documents that pass the base rules, and never above the score below which `most_lost` of the good fall.

Counts and threshold are those of all documents and all labels. Up to BROADCAST_ROWS labelled ids are broadcast; more
meet the documents in a shuffle. The driver holds counts by bucket and by range of scores, never labels or scores.

Defined results. Null text counts as empty: no words, so base_failed. Rows without doc_id are scored but never
labelled. Without labels every ratio is 0 and only the base rules decide. Empty tables give no
rows. Every input row gives one output row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import batches_by_bytes, documents, gram_hashes, quoted, released, settled, word_hashes

#: Labelled ids that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Ranges of scores in one unit. Scores lie within a few units, so the driver gets some ten thousand ranges on any input,
#: and one range holds a small part of the scores.
RANGES = 1 << 14
N, BUCKETS = 4, 1 << 15
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


def base_signals(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    packed = raw.translate(None, SPACE)
    chars = int(np.count_nonzero((np.frombuffer(packed, np.uint8) & 0xC0) != 0x80))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    repeated = 0
    if len(words) >= 6:
        g = gram_hashes(word_hashes(words), 5)
        order = np.sort(g)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.flatnonzero(np.isin(g, twice))
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def buckets_of(raw: bytes) -> np.ndarray:
    """The bucket of every n-gram of bytes; a shorter text has none."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < N:
        return np.empty(0, np.int64)
    v = np.zeros(len(b) - N + 1, np.uint32)
    for i in range(N):
        v |= b[i : len(b) - N + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    v *= np.uint32(2654435761)
    v ^= v >> np.uint32(15)
    v *= np.uint32(2246822519)
    return (v >> np.uint32(32 - 15)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # by bucket
    threshold: float

    def score(self, raw: bytes) -> float:
        at = buckets_of(raw)
        return float(self.ratio[at].mean()) if len(at) else 0.0


def _raw(text) -> bytes:
    return (text or "").encode()


def ratio_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p, q = target + 0.5, raw + 0.5
    return np.log(p / p.sum()) - np.log(q / q.sum())


def threshold_of(scored: DataFrame, most_lost: float, ranges: int = RANGES) -> float:
    """The score that best splits good from bad (a lost good counts twice), in the middle of the gap that it lies in;
    at most the score below which most_lost of the good fall. scored is (score, good); the driver gets a row for each
    range of scores, and scores are counted up within their ranges."""
    scored = scored.select(F.floor(F.col("score") * ranges).alias("range"), "score", F.col("good").cast("long").alias("g"), (~F.col("good")).cast("long").alias("b"))
    held = scored.groupBy("range").agg(F.sum("g"), F.sum("b"), F.max("score")).orderBy("range").collect()
    starts, n_good, n_bad, last = [], 0, 0, None
    for at, g, b, top in held:
        starts.append((at, n_good, n_bad, last))
        n_good, n_bad, last = n_good + g, n_bad + b, top
    if not n_good:
        return -np.inf
    nth = min(int(most_lost * n_good), n_good - 1)
    starts = scored.sparkSession.createDataFrame(starts, "range long, good_before long, bad_before long, last double")
    order = Window.partitionBy("range").orderBy("score")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cuts = scored.groupBy("range", "score").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).join(F.broadcast(starts), "range")
    cuts = cuts.select(
        "score",
        "g",
        (F.col("good_before") + F.coalesce(F.sum("g").over(before), F.lit(0))).alias("lost"),
        (F.col("bad_before") + F.coalesce(F.sum("b").over(before), F.lit(0))).alias("caught"),
        F.coalesce(F.lag("score").over(order), "last", "score").alias("below"),
    )
    gain = F.col("caught") / F.lit(max(1, n_bad)) - 2 * (F.col("lost") / F.lit(n_good))
    by_loss, best = cuts.agg(
        F.max(F.when((F.col("lost") <= nth) & (F.col("lost") + F.col("g") > nth), F.col("score"))),
        F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("minus"), "below")),  # the first of equal gains
    ).first()
    return min(by_loss, (best.below - best.minus) / 2) if n_bad else by_loss


def fit(docs: DataFrame, labels: DataFrame, most_lost: float = 0.01, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    known = settled(known.selectExpr("doc_id", "quality = 1 AND toxic = 0 AS good", "quality").where("good OR quality = 0").drop("quality"))
    few = known.count() <= broadcast_rows
    known = known.hint("broadcast" if few else "shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows without an id are not joined: a shuffle would send them all to one task
    flagged = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    flagged = flagged.unionByName(rows.where("doc_id IS NULL").select("text", F.lit(False).alias("good")))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches_by_bytes(batches, "text"):
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(buckets_of(_raw(text)), minlength=BUCKETS)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = flagged.mapInArrow(released(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, r, t in settled(counts).collect():  # at most BUCKETS rows
        raw[k], target[k] = r, t
    model = Model(ratio_of(raw, target), -np.inf)
    if not target.any():
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for b in batches_by_bytes(batches, "text"):
            ids, s = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = _raw(text)
                n_words, _, _, _, n_repeat = base_signals(raw)
                if n_words < 10 or 100 * n_repeat > 20 * n_words:
                    continue  # the base rules decide
                ids.append(doc)
                s.append(held.value.score(raw))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    # many labels: all texts are scored where they lie, and only ids and scores are shuffled
    wanted = rows.join(known, "doc_id", "left_semi") if few else rows.where("doc_id IS NOT NULL")
    scored = wanted.mapInArrow(released(scores), "doc_id long, score double").join(known, "doc_id").select("score", "good")
    return Model(model.ratio, threshold_of(settled(scored), most_lost))


_SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_KINDS = dict.fromkeys(_SIGNALS, T.LongType()) | {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "score": T.DoubleType()}
_VERDICT = T.StructType([T.StructField(k, v) for k, v in _KINDS.items()])


def assess(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns with the signals, score, base_failed and kept; own columns of these names go."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in _VERDICT.names]
    return assessed(docs, model, carry).select("row.*", *_VERDICT.names)


def assessed(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """(row, signals, base_failed, kept, score): row holds the carried columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*map(quoted, docs.columns if carry is None else carry)).alias("row"), "text")

    def run(batches):
        model = held.value
        for b in batches_by_bytes(batches, "text"):
            signals, scores = [], []
            for x in b.column(1).to_pylist():
                raw = _raw(x)
                signals.append(base_signals(raw))
                scores.append(model.score(raw))
            s = np.array(signals, np.int64).reshape(-1, 5)
            failed = (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])
            kept = ~failed & (np.array(scores) >= model.threshold)
            more = [*(pa.array(s[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *more], ["row", *_VERDICT.names])

    return rows.mapInArrow(released(run), T.StructType([rows.schema["row"], *_VERDICT]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
