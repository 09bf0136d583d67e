"""Substring dedup: windows of words that started before, found with suffix automata of reference shards.

The corpus is its own reference, so a shard is not broadcast to all documents (shards x documents would grow with
the square of the input): repeats.py routes the runs of words that share an anchor to one shard. There a suffix
automaton takes the runs in order of (doc_id, start), and each run is streamed through it for matching statistics
before it is added: a window is covered where the longest match that ends with it has at least its length.
Anchors with more than MOST_RUNS different runs (boilerplate with ever new neighbours) would make one shard grow
with the input; their windows are aggregated under hashes of their own instead, with the same result.

Defined results. Words are runs of bytes other than space and 09-0D. Null or empty text: no words. Among rows with
one doc_id the earlier start counts as earlier; equal (doc_id, start) do not cover each other. A null doc_id comes
after all others. Every input row gives one output row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._util import LAST_ID, documents
from .repeats import HOT_RUNS, Block, Rule, repeated

MOST_RUNS = 64


class SuffixAutomaton:
    """Of several sequences; link and length by state, transitions as dicts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def statistics(self, sequence):
        """Length of the longest suffix of each prefix that occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (q := nxt[state].get(c)) is not None:
                state = q
                matched += 1
            yield matched


def shard(window: int):
    """Resolver for the runs of one anchor in order of their position."""

    def resolve(runs: list[list[int]]) -> list[list[int]]:
        automaton, out = SuffixAutomaton(), []
        for run in runs:
            out.append([i - window + 1 for i, n in enumerate(automaton.statistics(run)) if n >= window])
            automaton.add(run)
        return out

    return resolve


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, most_runs: int = MOST_RUNS, with_text: bool = True, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (words joined by one space)."""
    rule = Rule(window, gram, words=True, ordered=True, most_runs=most_runs, hot_runs=hot_runs)

    def finish(b: Block, hit: np.ndarray) -> pa.Table:
        kept, n, removed = [], [], []
        for words, a, z in zip(b.words, b.offs[:-1], b.offs[1:]):
            own = hit[a:z]
            kept.append(b" ".join([w for w, x in zip(words, own.tolist()) if not x]) if own.any() else b" ".join(words))
            n.append(len(words))
            removed.append(int(own.sum()))
        cols = [pa.array(b.ids, mask=b.ids == LAST_ID), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return repeated(docs, rule, finish, schema, shard(window))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False)


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT win, min((doc_id, i)) AS first FROM s GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM s JOIN f USING (win) WHERE (s.doc_id, s.i) > f.first),
g AS (SELECT rid, list(p) AS gone FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
