"""Suffix-array dedup: byte strings that also start in an earlier document, by distributed prefix doubling.

Ranks of prefixes are doubled until a string is unique or the threshold length is reached: grams of 24 bytes are
ranked first, pairs of ranks at growing offsets then stand for longer strings, and whatever is unique drops out.
Ranks are hashes (96 bits), so equal strings get equal ranks on all tasks without a global numbering; each round
is a shuffle by rank and a sort inside its buckets. Sorting every byte position would move more than 16 times the
text in each round, so the first round ranks only sampled positions that every repeated string is bound to hold
(see repeats.py), and the last round ranks all starts whose sampled position is still undecided.

Defined results. Null text counts as empty. Documents with one doc_id are not earlier than each other, a null
doc_id comes after all others. Strings are judged on the input. Every input row gives one output row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._util import LAST_ID, documents
from .repeats import HOT_RUNS, Block, Rule, repeated


def suffix_dedup(docs: DataFrame, length: int = 50, gram: int = 24, with_text: bool = True, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (bytes: a cut may split a character)."""
    rule = Rule(length, gram, words=False, ordered=False, hot_runs=hot_runs)

    def finish(b: Block, hit: np.ndarray) -> pa.Table:
        rows = []
        for text, a, z in zip(b.texts, b.offs[:-1], b.offs[1:]):
            own = hit[a:z]
            spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1))
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if spans else text
            rows.append((len(text), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        n, removed, spans, digest, kept = zip(*rows)
        cols = [pa.array(b.ids, mask=b.ids == LAST_ID), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.Table.from_arrays(cols, names)

    return repeated(docs, rule, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), with_text=False)


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT rid, doc_id, i, substring(h, 2 * i - 1, 100) AS win FROM (SELECT rid, doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (win) WHERE s.doc_id > f.first),
r AS (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS run FROM c),
spans AS (SELECT rid, run, min(p) AS a, max(p) AS b FROM r GROUP BY rid, run),
o AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
g AS (SELECT rid, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last FROM o GROUP BY rid),
k AS (SELECT o.rid, string_agg(substring(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head FROM o JOIN d USING (rid) GROUP BY o.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)
"""
