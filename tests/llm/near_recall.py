"""Links that near duplicates lose on a table, against all links by exact prefix filtering:

    python tests/llm/near_recall.py /root/testdata/check_h/documents.parquet

A pair that reaches the similarity must share one of the rarest shingles of each set, as many as may be missing and
one more, so comparing all pairs that do finds every link. For tables that fit on one machine.
"""

from __future__ import annotations

import os
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


def links(sets: list[np.ndarray], percent: int):
    """Pairs of positions of sets whose similarity reaches percent."""
    shingle, count = np.unique(np.concatenate(sets), return_counts=True)
    order = np.empty(len(shingle), np.int64)
    order[np.lexsort((shingle, count))] = np.arange(len(shingle))
    ranks = [np.sort(order[np.searchsorted(shingle, s)]) for s in sets]
    whole = [set(r.tolist()) for r in ranks]
    index: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(ranks[i])
        head = ranks[i][: n - -(-percent * n // 100) + 1].tolist()
        for j in {j for s in head for j in index[s] if 100 * len(whole[j]) >= percent * n}:
            both = len(whole[i] & whole[j])
            if 100 * both >= percent * (n + len(whole[j]) - both):
                yield i, j
        for s in head:
            index[s].append(i)


def main(path: str, n: int = 4, percent: int = 80) -> None:
    from pyspark.sql import SparkSession

    from loomtext.llm import near_dedup
    from loomtext.llm._util import ids_of, small_batches

    spark = SparkSession.builder.master("local[6]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    small_batches(spark)
    docs = spark.read.parquet(path).select("doc_id", "text")
    found = near_dedup.near_duplicates(docs, n, percent).toPandas()
    component = dict(zip(found["id"], found["component_id"]))
    table = docs.toPandas()
    first: dict[bytes, tuple[int, np.ndarray]] = {}
    for i, text in zip(ids_of(pa.array(table["doc_id"])).tolist(), table["text"]):
        s = near_dedup.shingles((text or "").encode(), n)
        if len(s) and i < first.get(s.tobytes(), (i + 1,))[0]:
            first[s.tobytes()] = (i, s)
    ids, sets = zip(*first.values())
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    total = lost = 0
    for a, b in links(list(sets), percent):
        total += 1
        lost += component[ids[a]] != component[ids[b]]
        x, y = find(a), find(b)
        if x != y:
            low, high = sorted((x, y), key=lambda k: ids[k])
            root[high] = low
    wrong = sum(component[ids[i]] != ids[find(i)] for i in range(len(ids)))
    print(f"{len(table)} documents, {len(ids)} different sets, {total} links, {lost} lost, {wrong} sets in another component")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
