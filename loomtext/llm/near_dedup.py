"""Near-duplicate documents: an LSH forest over MinHash signatures, confirmed on full shingle sets.

A signature of 128 values gives 32 orders of the documents: by its values from each fourth one on. Spark sorts the
orders by range, so that documents with long common prefixes are neighbours; two documents of similarity 0.8 share a
prefix of at least DEPTH values in some order but for a probability of (1 - 0.8^4)^32, about 4e-8.

1. Equal sets are one class; only classes go on.
2. Each sorted part is walked once. Runs of neighbours with a common prefix of DEPTH values are regions; a region of
   more than DENSE classes is parted by ever longer prefixes, each part to the depth that it needs. A class asks
   for the smallest class of its part and for the neighbour with which it has the longest common prefix; of all
   orders the most frequent of each kind is confirmed on full sets. Confirmed links give first components.
3. A region that lies in one component is done, as more links inside change nothing. In all others every class
   outside the region's largest component meets the region's classes of other components, chunk by chunk: first on
   signatures (ALIKE equal values of 128; at similarity 0.8 fewer have a probability of about 5e-8), then, where
   those are alike, on full sets. A chunk tells one link for each component that a class belongs to, never its
   pairs. Nothing is capped.

Defined results. Words are runs of bytes other than space and 09-0D, A-Z lower-cased. Text without words (or null) has an empty set
and is linked with nothing. Each row is judged by its own text; a null doc_id comes after all others, and rows
with equal doc_ids are one node of the result. Every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import LAST_ID, batches_by_bytes, documents, gram_hashes, ids_of, join2, mix, quoted, released, row_of, settled, word_hashes
from .components import components

VALUES, DEPTH, DEEPEST = 128, 4, 12
ORDERS = VALUES // DEPTH
DENSE, CHUNK, ALIKE = 64, 1000, 76
#: Rows that are walked together.
WALK_ROWS = 1 << 16
#: Ids of one broadcast; beyond it texts are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    g = gram_hashes(h, n) if len(h) >= n else join2(gram_hashes(h, len(h)), np.full(1, len(h), np.uint64))
    return np.unique(g)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 values, one row for each (non-empty) set."""
    out = np.empty((len(sets), VALUES), np.uint32)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) < 60_000):
            size += len(sets[b])
            b += 1
        x = np.concatenate(sets[a:b])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]], dtype=np.int64)]).astype(np.int64)
        for i in range(VALUES):
            out[a:b, i] = np.minimum.reduceat(x * _FACTORS[i] + _ADDS[i], at) >> np.uint64(32)
        a = b
    return out


def signed(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, s1, s2, sig): the set's size, 128-bit hash and signature."""

    def run(batches):
        for b in batches_by_bytes(batches, "text", 2 << 20):
            sets = [shingles((t or "").encode(), n) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(b.column(0))), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["id", "n_shingles", "s1", "s2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), "id long, n_shingles long, s1 long, s2 long, sig binary")


def ordered(classes: DataFrame) -> DataFrame:
    """(place, rep): in every order the number of the order and the first DEEPEST values, two bytes of each."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(n, VALUES).astype(">u2")
            row = np.empty((n, ORDERS, 1 + 2 * DEEPEST), np.uint8)
            row[:, :, 0] = np.arange(ORDERS)
            for i in range(ORDERS):
                own = np.take(sig, np.arange(i * DEPTH, i * DEPTH + DEEPEST), axis=1, mode="wrap")
                row[:, i, 1:] = own.view(np.uint8).reshape(n, -1)
            place = pa.FixedSizeBinaryArray.from_buffers(pa.binary(row.shape[2]), n * ORDERS, [None, pa.py_buffer(row.tobytes())])
            yield pa.RecordBatch.from_arrays([place.cast(pa.binary()), pa.array(np.repeat(b.column(0).to_numpy(), ORDERS))], ["place", "rep"])

    return classes.select("rep", "sig").mapInArrow(released(run), "place binary, rep long")


def regions(place: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows the common prefix with the row before, the smallest class of each row's part, and the neighbour
    with the longest common prefix (the row's own class where there is none)."""
    n = len(rep)
    same = place[1:] == place[:-1]
    values = same[:, 1::2] & same[:, 2::2]
    lcp = np.where(values.all(axis=1), DEEPEST, values.argmin(axis=1)) * same[:, 0]
    lcp = np.concatenate([[0], lcp]).astype(np.int8)
    part = np.empty(n, np.int64)
    open_ = np.ones(n, bool)
    for depth in range(DEPTH, DEEPEST + 1):
        own = np.cumsum(lcp < depth)
        done = open_ & ((np.bincount(own)[own] <= DENSE) | (depth == DEEPEST))
        part[done] = own[done] * (DEEPEST + 1) + depth
        open_ &= ~done
        if not open_.any():
            break
    names, of = np.unique(part, return_inverse=True)
    head = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(head, of, rep)
    after = np.append(lcp[1:], 0)
    near = rep.copy()
    left = (lcp >= DEPTH) & (lcp >= after)
    right = (after >= DEPTH) & ~left
    near[left] = rep[np.flatnonzero(left) - 1]
    near[right] = rep[np.flatnonzero(right) + 1]
    return lcp, head[of], near


def walked(orders: DataFrame) -> DataFrame:
    """(rep, key, head, near) of sorted parts: key names the region; rows that are alone in theirs are left out, but
    for the ends of what was walked together, whose region may go on elsewhere."""

    def walk(place: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        lcp, head, near = regions(place, rep)
        met = lcp >= DEPTH
        met[:-1] |= met[1:].copy()
        met[[0, -1]] = True
        base = np.ascontiguousarray(place[:, 1 : 1 + 2 * DEPTH]).view("<u8").ravel()
        key = join2(mix(place[:, 0].astype(np.uint64) + np.uint64(1)), base).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (rep, key, head, near)], ["rep", "key", "head", "near"])

    def run(batches):
        kept: list = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            kept.append((raw, b.column(1).to_numpy()))
            size += b.num_rows
            if size >= WALK_ROWS:
                place, rep = (np.concatenate(x) for x in zip(*kept))
                yield walk(place, rep)
                kept, size = [(place[-1:], rep[-1:])], 1  # the last row is the next part's first neighbour
        if size > 1 or kept:
            yield walk(*(np.concatenate(x) for x in zip(*kept)))

    rows = orders.repartitionByRange("place", "rep").sortWithinPartitions("place", "rep")
    return rows.mapInArrow(released(run), "rep long, key long, head long, near long")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, set): the packed sets of the documents named; their number decides how they are found."""
    ids = settled(ids.select("id").distinct())
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text").join(ids, "id", "left_semi")

    def sets(batches):
        for b in batches_by_bytes(batches, "text"):
            own = [shingles((t or "").encode(), n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["id", "set"])

    return rows.mapInArrow(released(sets), "id long, set binary")


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity, as settled links."""
    pairs = settled(pairs)
    full = sets_of(docs, pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))), n)
    u, v = full.select(F.col("id").alias("u"), F.col("set").alias("a")), full.select(F.col("id").alias("v"), F.col("set").alias("b"))

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = 0
                if len(a) and len(b) and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b")
    return settled(met.mapInArrow(released(check), "u long, v long"))


def best_pairs(found: DataFrame) -> DataFrame:
    """(u, v): each class with the head and with the neighbour that it met in most orders."""
    other = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("head").alias("other")), F.struct(F.lit(1).alias("kind"), F.col("near").alias("other"))))
    rows = found.select("rep", other.alias("x")).select("rep", "x.*").where("rep != other").repartition("rep")
    met = rows.groupBy("rep", "kind", "other").agg(F.count("*").alias("n"))
    best = met.groupBy("rep", "kind").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"))
    return best.select(F.greatest("rep", "other").alias("u"), F.least("rep", "other").alias("v")).distinct()


def alike(members: list, askers: list) -> tuple[set[int], set[int]]:
    """Members and askers (id, root, signature) that have many values in common with one of another root."""
    sig = lambda rows: np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(len(rows), VALUES)
    theirs, roots = sig(members), np.array([r[1] for r in members])
    hit, asked = np.zeros(len(members), bool), set()
    for (own, root, _), values in zip(askers, sig(askers)):
        met = (roots != root) & ((theirs == values).sum(axis=1) >= ALIKE)
        if met.any():
            hit |= met
            asked.add(own)
    return {members[i][0] for i in np.flatnonzero(hit).tolist()}, asked


def compare(members: list, askers: list, percent: int) -> tuple[list[int], list[int]]:
    """Links between askers and members (id, root, set), one for each asker and root met."""
    ids, roots, sets = zip(*[(i, root, np.frombuffer(x, "<u8")) for i, root, x in members])
    size = np.array(list(map(len, sets)))
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    o = np.argsort(every, kind="stable")
    every, owner = every[o], owner[o]
    u, v = [], []
    for own, root, x in askers:
        s = np.frombuffer(x, "<u8")
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        met = {root}
        for i in np.flatnonzero((both > 0) & (100 * both >= percent * (size + len(s) - both))).tolist():
            if roots[i] not in met:
                met.add(roots[i])
                u.append(max(own, ids[i]))
                v.append(min(own, ids[i]))
    return u, v


def meeting(rows: DataFrame, payload: DataFrame, meet: Callable, schema: str) -> DataFrame:
    """meet(members, askers) of every chunk of the regions of rows (key, rep, root) that have several roots; payload
    (id, value) is what members and askers bring along. Chunks are sorted, and read one after the other."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("roots")).where("roots > 1")
    chunks = lambda c: F.ceil(c / CHUNK).cast("int")
    open_ = open_.select("key", "main", chunks(F.col("n")).alias("parts"), chunks(F.col("n") - F.col("most")).alias("asks"))
    member = rows.join(open_, "key").join(payload, F.col("rep") == F.col("id")).drop("id")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    ask = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("asks")).cast("int")
    # every chunk of a region meets every chunk of its askers
    as_member = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda i: F.struct(part.alias("part"), i.alias("ask"), F.lit(False).alias("asking")))
    as_asker = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), ask.alias("ask"), F.lit(True).alias("asking")))
    both = F.concat(as_member, F.when(F.col("root") != F.col("main"), as_asker).otherwise(F.array().cast("array<struct<part:int,ask:int,asking:boolean>>")))
    dealt = member.select("key", F.explode(both).alias("c"), "rep", "root", "value").select("key", "c.part", "c.ask", "c.asking", "rep", "root", "value")
    fields = [(x.split()[0], pa.int64()) for x in schema.split(", ")]

    def run(batches):
        group, members, askers = None, [], []
        out: list[tuple] = []

        def table():
            cols = list(zip(*out)) if out else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])

        for b in batches:
            for key, part, ask, asking, rep, root, value in zip(*(c.to_pylist() for c in b.columns)):
                if (key, part, ask) != group:
                    if members and askers:
                        out += meet(group[0], members, askers)
                    group, members, askers = (key, part, ask), [], []
                (askers if asking else members).append((rep, root, value))
            if len(out) > 10_000:
                yield table()
                out = []
        if members and askers:
            out += meet(group[0], members, askers)
        yield table()

    keys = ["key", "part", "ask"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), schema)


def open_links(docs: DataFrame, classes: DataFrame, found: DataFrame, roots: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links between components that share regions (rep, key)."""
    rows = found.select("rep", "key").distinct().join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rows = settled(rows)

    def by_signature(key, members, askers):
        return [(key, i) for group in alike(members, askers) for i in group]

    near = meeting(rows, classes.select(F.col("rep").alias("id"), F.col("sig").alias("value")), by_signature, "key long, rep long")
    near = settled(near.distinct().join(rows, ["key", "rep"]))

    def by_sets(key, members, askers):
        return zip(*compare(members, askers, percent))

    full = sets_of(docs, near.select(F.col("rep").alias("id")), n).withColumnRenamed("set", "value")
    return settled(meeting(near, full, by_sets, "u long, v long").where("u != v").distinct())


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): ids with null as LAST_ID."""
    base = settled(signed(docs, n))
    classes = settled(base.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "sig")).alias("m")).select("s1", "s2", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig")))
    found = settled(walked(ordered(classes)))
    roots = components(confirmed(docs, best_pairs(found), n, percent))
    more = open_links(docs, classes, found, roots, n, percent)
    if not more.isEmpty():
        # links between components: their roots are nodes of a smaller graph
        root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        more = more.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
        joined = components(more).withColumnRenamed("root", "top")
        roots = roots.unionByName(joined.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
        roots = roots.join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = classes.select("s1", "s2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    full = base.where("n_shingles > 0").select("id", "n_shingles", "s1", "s2").join(found, ["s1", "s2"]).select("id", "n_shingles", "component_id")
    return full.unionByName(base.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))


#: A text that has words.
WORDED = r"[^\x20\x09-\x0D]"


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, null last. Rows without words stay.

    Rows that share a doc_id, or have none, are nodes of their own, named by a hash of doc_id and text.
    """
    doc_id = F.col("doc_id").cast("long")
    shared = settled(docs.groupBy(doc_id.alias("shared")).count().where("count > 1 OR shared IS NULL").select("shared"))
    many = shared.count()
    if not many:
        gone = near_duplicates(docs, n, percent).where("id != component_id").select("id")
        return docs.join(gone, doc_id == gone["id"], "left_anti")
    if many <= MOST_BROADCAST:
        shared = F.broadcast(shared)
    same = doc_id.eqNullSafe(shared["shared"])
    # above the ids of most tables, as heads are best the smallest ids
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    alone = docs.join(shared, same, "left_anti").withColumn("__node", doc_id)
    met = docs.join(shared, same, "left_semi").withColumn("__node", hashed)
    worded = F.coalesce(F.col("text").rlike(WORDED), F.lit(False))
    # of rows with one doc_id and text the least by the other columns stays
    one = met.where(worded).groupBy("__node").agg(F.min(row_of(docs)).alias("__row")).select("__row.*", "__node")
    nodes = settled(alone.unionByName(one).unionByName(met.where(~worded)))
    found = settled(near_duplicates(nodes.select(F.col("__node").alias("doc_id"), "text"), n, percent).where("n_shingles > 0").select("id", "component_id"))
    order = F.struct(doc_id.isNull(), doc_id, F.col("id"))
    stay = found.join(nodes.select("__node", "doc_id"), F.col("id") == F.col("__node")).groupBy("component_id").agg(F.min(order).alias("first")).select("first.id")
    gone = found.select(F.col("id").alias("gone")).join(stay, F.col("gone") == F.col("id"), "left_anti")
    return nodes.join(gone, F.col("__node") == gone["gone"], "left_anti").select(*map(quoted, docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), n=4)
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), "n_shingles", back("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS c FROM r GROUP BY node) m USING (doc_id)
"""
