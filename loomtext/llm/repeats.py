"""Windows that occurred before: the exchange that substring and suffix-array dedup share.

A text is a sequence of symbols (bytes or words) and a window is a run of `window` neighbouring symbols. For every
document the windows that also start earlier are wanted. Shipping every window would cost many times the input,
so positions are sampled consistently: each window is represented by the smallest hashed gram inside it (its
anchor), so that equal windows always have equal anchors, and neighbouring windows with one anchor travel
together as a run. Three passes over blocks of documents, each followed by a shuffle of packed arrays:

1. Each block sends its distinct (anchor, run) pairs with their first position. Anchors that occur once drop out.
   A run that occurs earlier as a whole is answered at once; a run that shares its anchor with different runs is
   sent for again, and only by the block that holds its first occurrence.
2. Those runs are resolved one rank further: either as ranks of whole windows, or by a resolver that the caller
   gives (see substring_dedup). Both answers go back to the block.
3. Each block marks what its answers cover.

Keys are aggregated in the block before they are sent, so a passage that a third of all documents share is one
entry for each block, and every window shared by many documents is aggregated under its own hash. An anchor with
more than HOT_RUNS different runs in one block (a common gram with ever new neighbours) is sent as one mark; every
block then sends that anchor's windows under their own hashes, which lie in different buckets. So no bucket gets
more than HOT_RUNS entries of one anchor from a block. Tasks unpack a bucket in parts of about PART_ENTRIES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from ._util import block_count, blocked, gram_hashes, ids_of, join2, mix, released, settled, texts_of, word_hashes

#: Windows whose anchors are found together; the low bits of a number hold a position among them.
STEP, _BITS = 1 << 20, 21
_LOW = np.uint64((1 << _BITS) - 1)
_HIGH = np.uint64(((1 << 64) - 1) ^ ((1 << _BITS) - 1))
HOT_RUNS, PART_ENTRIES = 16, 1 << 18
_U16 = np.uint64(16)
RUN, WINDOW, CONTENT = 1, 2, 3  # kinds of answers and of second requests
_REQUEST = "bucket int, kind int, block int, key binary, fp binary, doc binary, start binary, flag binary, size binary, content binary"
_ANSWER = "block int, kind int, ident binary, doc binary, start binary, status binary"


@dataclass(frozen=True)
class Rule:
    window: int
    gram: int  # for bytes a multiple of 8
    words: bool
    ordered: bool  # an earlier start in the same document counts too
    most_runs: int = 0  # anchors with at most so many runs go to the resolver
    hot_runs: int = HOT_RUNS  # anchors with more different runs in a block are sent as a mark


# ---- packing


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _thin(a: np.ndarray, kind: str) -> bytes:
    """Slowly growing numbers: differences, compressed."""
    a = a.astype(np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, prepend=np.int64(0)).astype(kind).tobytes())


def _unthin(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind), dtype=np.int64)


def _cuts(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array, and its end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), [len(a)]]) if len(a) else np.zeros(1, np.int64)


# ---- blocks


def _lanes(raw: bytes) -> np.ndarray:
    """The 8 bytes from every position on as one number."""
    n = len(raw) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        part = out[i::8]
        part[:] = np.frombuffer(raw, "<u8", count=len(part), offset=i)
    return out


class Block:
    """The documents of a block in order of doc_id, as one sequence of symbols."""

    def __init__(self, table: pa.Table, rule: Rule):
        ids = ids_of(table["doc_id"])
        self.order = np.argsort(ids, kind="stable")
        texts = texts_of(table["text"])
        self.rule, self.ids, self.texts = rule, ids[self.order], [texts[i] for i in self.order]
        if rule.words:
            self.words = [t.split() for t in self.texts]
            sizes = list(map(len, self.words))
            self.symbols = word_hashes([w for x in self.words for w in x])
            self.gram = gram_hashes(self.symbols, rule.gram)
        else:
            self.raw = b"".join(self.texts)
            sizes = list(map(len, self.texts))
        self.offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._runs()
        self._name()

    def grams(self, a: int, b: int) -> np.ndarray:
        """Hashes of the grams that start at a, ..., b - 1."""
        if self.rule.words:
            return self.gram[a:b]
        lanes = _lanes(self.raw[a : b - 1 + self.rule.gram])
        out = mix(lanes[: b - a])
        for i in range(8, self.rule.gram, 8):
            out = join2(out, lanes[i : i + b - a])
        return out

    def grams_at(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the grams that start at given positions."""
        if self.rule.words:
            return self.gram[at]
        if not len(at):
            return np.empty(0, np.uint64)
        lanes = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.raw, np.uint8), 8)
        lane = lambda i: np.ascontiguousarray(lanes[at + i]).view("<u8").ravel()
        out = mix(lane(0))
        for i in range(8, self.rule.gram, 8):
            out = join2(out, lane(i))
        return out

    def _runs(self) -> None:
        """first and last window, anchor, document, key and fp of every run."""
        w = self.rule.window
        need = w - self.rule.gram + 1  # grams in a window
        m = int(self.offs[-1]) - w + 1
        found = []
        for s in range(0, m, STEP):
            e = min(m, s + STEP)
            gram = self.grams(s, min(m, e + need) + need - 1)  # and those of runs that go on behind the step
            low = (gram[: e + need - 1 - s] & _HIGH) | np.arange(e + need - 1 - s, dtype=np.uint64)
            span = 1
            while span * 2 <= need:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < need:
                low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
            at = (low & _LOW).astype(np.int64) + s
            valid = np.ones(e - s, bool)
            i, j = np.searchsorted(self.offs, s, "right") - 1, np.searchsorted(self.offs, e + w, "left")
            for a, b in zip(self.offs[i:j].tolist(), self.offs[i + 1 : j + 1].tolist()):
                valid[max(0, max(a, b - w + 1) - s) : max(0, b - s)] = False
            change = at[1:] != at[:-1]
            new, end = valid.copy(), valid.copy()
            new[1:] &= ~valid[:-1] | change
            end[:-1] &= ~valid[1:] | change
            first, last = np.flatnonzero(new), np.flatnonzero(end)
            key, fp = self._named(lambda x: gram[x], at[first] - s, first, last)
            found.append((first + s, last + s, at[first], key, fp))
        first, last, anchor, key, fp = map(np.concatenate, zip(*found)) if found else (*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)
        doc = np.searchsorted(self.offs, first, "right") - 1
        # runs that a step has cut
        goes_on = (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1) & (doc[1:] == doc[:-1])
        head, tail = np.concatenate([[True], ~goes_on])[: len(first)], np.concatenate([~goes_on, [True]])[: len(first)]
        self.first, self.last, self.anchor, self.doc, self.key, self.fp = first[head], last[tail], anchor[head], doc[head], key[head], fp[head]
        if len(cut := np.flatnonzero(last[head] != self.last)):
            _, self.fp[cut] = self._named(self.grams_at, self.anchor[cut], self.first[cut], self.last[cut])

    def _named(self, grams: Callable, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, k = self.rule.window, self.rule.gram
        size = last - first + w
        fp = mix(size.astype(np.uint64))
        for t in range(0, 2 * w - k, k):  # as far as the longest run goes, so that equal runs have equal names anywhere
            fp = join2(fp, grams(np.minimum(first + t, first + size - k)))
        return grams(anchor), fp >> _U16

    def _name(self) -> None:
        key = self.key
        self.ident = join2(key >> _U16, self.fp)
        self.start = self.first - self.offs[self.doc]
        # runs of anchors that have many different runs here
        _, one = np.unique(self.ident, return_index=True)
        keys, of = np.unique(key, return_inverse=True)
        self.hot = (np.bincount(of[one], minlength=len(keys)) > self.rule.hot_runs)[of]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, document, key and fp of every window of some runs, its rank made from ranks at growing offsets."""
        which = np.sort(which)
        first = self.first[which]
        cuts = np.flatnonzero(np.diff(first // STEP, prepend=-1))
        parts = [self._windows(which[a:b]) for a, b in zip(cuts, [*cuts[1:], len(which)])]
        return tuple(map(np.concatenate, zip(*parts)))

    def _windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, k = self.rule.window, self.rule.gram
        n = self.last[which] - self.first[which] + 1
        at = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        a, b = int(self.first[which[0]]), int(self.last[which[-1]]) + 1
        if 8 * len(at) > b - a:
            near = self.grams(a, b + w - k)
            grams = lambda x: near[x - a]
        else:
            grams = self.grams_at
        key = grams(at)
        fp = mix(key)
        for t in [*range(k, w - k, k), w - k]:
            more = grams(at + t)
            key, fp = join2(key, more), join2(more, fp)
        return at, np.repeat(self.doc[which], n), key, fp >> _U16


def _request(kind: int, block: int, buckets: int, rule: Rule, ids, start, key, fp, content=None, hot=None) -> list[dict]:
    """Rows for each bucket of the distinct entries, first occurrences only; of hot keys one entry as a mark."""
    e = np.lexsort((start, ids)) if rule.ordered else np.arange(len(ids))  # rows may share an id
    ids, start, key, fp, place = ids[e], start[e], key[e], fp[e], e
    ident = join2(key >> _U16, fp)
    o = np.argsort(ident, kind="stable")
    c = _cuts(ident[o])
    if len(c) < 2:
        return []
    first, last = o[c[:-1]], o[c[1:] - 1]
    again = ids[first] != ids[last]
    if rule.ordered:
        again |= start[first] != start[last]
    by = np.argsort(first)
    first, again = first[by], again[by]
    marked = np.zeros(len(first), bool)
    if hot is not None and hot.any():
        marked = hot[place[first]]
        _, one = np.unique(key[first[marked]], return_index=True)
        stay = ~marked
        stay[np.flatnonzero(marked)[one]] = True
        first, again, marked = first[stay], again[stay], marked[stay]
    bucket = ((key[first] & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)
    o = np.argsort(bucket, kind="stable")
    c = _cuts(bucket[o])
    rows = []
    for a, b in zip(c[:-1], c[1:]):
        e = first[o[a:b]]
        row = {"bucket": int(bucket[o[a]]), "kind": kind, "block": block, "key": _six(key[e] >> _U16), "fp": _six(fp[e]), "doc": _thin(ids[e], "<i8")}
        row["start"] = start[e].astype("<u4").tobytes() if rule.ordered else b""
        row["flag"] = np.packbits(again[o[a:b]]).tobytes() + np.packbits(marked[o[a:b]]).tobytes()
        row["size"] = row["content"] = b""
        if content is not None:
            parts = [content(i) for i in place[e].tolist()]
            row["size"] = np.array(list(map(len, parts)), "<u2").tobytes()
            row["content"] = np.concatenate(parts).astype("<u8").tobytes()
        rows.append(row)
    return rows


def _in_parts(table: pa.Table, rule: Rule) -> Iterator[dict[str, np.ndarray]]:
    """The entries of a bucket by ranges of their keys, about PART_ENTRIES at a time; row is the row of the table."""
    rows = table.select(["block", "key", "fp", "doc", "start", "flag"]).to_pylist()
    bits = (sum(len(r["key"]) for r in rows) // 6 // PART_ENTRIES).bit_length()
    for part in range(1 << bits):
        cols: dict[str, list] = {k: [] for k in ("block", "key", "fp", "doc", "start", "again", "hot", "row", "place")}
        for i, r in enumerate(rows):
            key = _unsix(r["key"])
            n, half = len(key), len(r["flag"]) // 2
            pick = np.flatnonzero(key >> np.uint64(48 - bits) == part)
            flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)[pick] for x in (r["flag"][:half], r["flag"][half:])]
            start = np.frombuffer(r["start"], "<u4").astype(np.int64)[pick] if rule.ordered else np.zeros(len(pick), np.int64)
            full = lambda x, kind: np.full(len(pick), x, kind)
            for k, v in zip(cols, (full(r["block"], np.int32), key[pick], _unsix(r["fp"])[pick], _unthin(r["doc"], "<i8")[pick], start, *flags, full(i, np.int32), pick)):
                cols[k].append(v)
        yield {k: np.concatenate(v) for k, v in cols.items()}


def _answers(kind: int, block, ident, doc, start, status) -> list[dict]:
    o = np.lexsort((doc, block))
    c = _cuts(block[o])
    rows = []
    for a, b in zip(c[:-1], c[1:]):
        e = o[a:b]
        rows.append(
            {
                "block": int(block[e[0]]),
                "kind": kind,
                "ident": ident[e].astype("<u8").tobytes(),
                "doc": _thin(doc[e], "<i8"),
                "start": zstandard.ZstdCompressor(level=1).compress(start[e].astype("<u4").tobytes()),
                "status": zstandard.ZstdCompressor(level=1).compress(status[e].astype(np.uint8).tobytes()),
            }
        )
    return rows


def _resolve(kind: int, table: pa.Table, rule: Rule) -> list[dict]:
    """First positions of keys that several documents (or positions) hold, for the blocks that need them."""
    return [row for x in _in_parts(table, rule) if len(x["key"]) for row in _resolved(kind, x, rule)]


def _resolved(kind: int, x: dict[str, np.ndarray], rule: Rule) -> list[dict]:
    o = np.lexsort((x["start"], x["doc"], x["fp"], x["key"]))
    x = {k: x[k][o] for k in ("block", "key", "fp", "doc", "start", "again", "hot")}
    key, n = x["key"], len(o)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_run = new_key | np.concatenate([[True], x["fp"][1:] != x["fp"][:-1]])
    ks, rs = np.flatnonzero(new_key), np.flatnonzero(new_run)
    of_run = np.cumsum(new_run) - 1
    first_doc, first_start = x["doc"][rs][of_run], x["start"][rs][of_run]
    is_first = (x["doc"] == first_doc) & (x["start"] == first_start)
    status = np.zeros(n, np.uint8)
    send = ~is_first | x["again"]
    if kind == RUN:
        of_key = np.cumsum(new_key) - 1
        runs = np.add.reduceat(new_run.astype(np.int64), ks)
        shared = np.logical_or.reduceat(x["again"], ks)
        if rule.ordered:
            shared |= np.diff(np.append(ks, n)) > 1
        else:
            shared |= np.minimum.reduceat(x["doc"], ks) != np.maximum.reduceat(x["doc"], ks)
        split = (shared & (runs > 1))[of_key] & is_first
        status[split] = np.where(runs[of_key][split] <= rule.most_runs, CONTENT, WINDOW)
        send |= split
        # runs of an anchor that is hot somewhere: each block asks for its own windows, and knows that of its marks
        hot = np.logical_or.reduceat(x["hot"], ks)[of_key]
        status[hot] = WINDOW
        first_doc, first_start = np.where(hot, x["doc"], first_doc), np.where(hot, x["start"], first_start)
        send = (send | hot) & ~x["hot"]
    e = np.flatnonzero(send)
    return _answers(kind, x["block"][e], join2(key[e], x["fp"][e]), first_doc[e], first_start[e], status[e])


class Answers:
    """What a block was told: sorted identities with first positions."""

    def __init__(self, table: pa.Table, kind: int):
        rows = table.filter(pc.equal(table["kind"], kind)).to_pylist() if table.num_rows else []
        if not rows:
            self.ident = np.empty(0, np.uint64)
            return
        un = zstandard.ZstdDecompressor().decompress
        ident = np.concatenate([np.frombuffer(r["ident"], "<u8") for r in rows])
        o = np.argsort(ident, kind="stable")
        self.ident = ident[o]
        self.doc = np.concatenate([_unthin(r["doc"], "<i8") for r in rows])[o]
        self.start = np.concatenate([np.frombuffer(un(r["start"]), "<u4") for r in rows])[o].astype(np.int64)
        self.status = np.concatenate([np.frombuffer(un(r["status"]), np.uint8) for r in rows])[o]

    def find(self, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which identities are known, and where."""
        if not len(self.ident):
            return np.zeros(len(ident), bool), np.zeros(len(ident), np.int64)
        at = np.searchsorted(self.ident, ident)
        at[at == len(self.ident)] = 0
        return self.ident[at] == ident, at


def _later(doc, start, first_doc, first_start, ordered: bool):
    return (doc > first_doc) | (ordered & (doc == first_doc) & (start > first_start))


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_TYPES = {"int": pa.int32(), "binary": pa.binary()}
_REQUEST_SCHEMA, _ANSWER_SCHEMA = (pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in s.split(", ")]) for s in (_REQUEST, _ANSWER))


def covered(block: Block, told: pa.Table) -> np.ndarray:
    """For each symbol of the block whether a window that started before covers it."""
    rule = block.rule
    runs, windows, content = (Answers(told, k) for k in (RUN, WINDOW, CONTENT))
    edge = np.zeros(int(block.offs[-1]) + 1, np.int32)
    known, at = runs.find(block.ident)
    e = np.flatnonzero(known)
    at = at[e]
    ids = block.ids[block.doc[e]]
    whole = _later(ids, block.start[e], runs.doc[at], runs.start[at], rule.ordered) if len(e) else np.zeros(0, bool)
    np.add.at(edge, block.first[e[whole]], 1)
    np.add.at(edge, block.last[e[whole]] + rule.window, -1)
    if len(e) or block.hot.any():
        kind = np.where(whole, 0, runs.status[at]) if len(e) else np.zeros(0, np.uint8)
        part = np.concatenate([e[kind == WINDOW], np.flatnonzero(block.hot)])
        if len(part):
            pos, doc, key, fp = block.windows(part)
            known, at = windows.find(join2(key >> _U16, fp))
            w = np.flatnonzero(known)
            at = at[w]
            if len(w):
                w = w[_later(block.ids[doc[w]], pos[w] - block.offs[doc[w]], windows.doc[at], windows.start[at], rule.ordered)]
                np.add.at(edge, pos[w], 1)
                np.add.at(edge, pos[w] + rule.window, -1)
        part = e[kind == CONTENT]
        if len(part) and len(content.ident):
            lo = np.searchsorted(content.ident, block.ident[part], "left")
            hi = np.searchsorted(content.ident, block.ident[part], "right")
            for i, a, b in zip(part.tolist(), lo.tolist(), hi.tolist()):
                pos = block.first[i] + content.start[a:b]
                np.add.at(edge, pos, 1)
                np.add.at(edge, pos + rule.window, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(docs: DataFrame, rule: Rule, finish: Callable[[Block, np.ndarray], pa.Table], schema: str, resolver: Callable | None = None) -> DataFrame:
    """finish(block, covered symbols) of every block. resolver(runs) gives the covered windows of sorted runs."""
    n = block_count(docs)
    buckets = int(min(200_000, max(8, n)))
    rows = blocked(docs, n)

    def ask(key, table):
        b = Block(table, rule)
        return _rows(_request(RUN, key[0].as_py(), buckets, rule, b.ids[b.doc], b.start, b.key, b.fp, hot=b.hot), _REQUEST_SCHEMA)

    def first(table):
        return _rows(_resolve(RUN, table, rule), _ANSWER_SCHEMA)

    def ask_again(key, left, told):
        if not left.num_rows:
            return _rows([], _REQUEST_SCHEMA)
        b, runs = Block(left, rule), Answers(told, RUN)
        known, at = runs.find(b.ident)
        e = np.flatnonzero(known)
        at = at[e]
        kind = np.zeros(0, np.uint8)
        if len(e):
            own = (b.ids[b.doc[e]] == runs.doc[at]) & ((b.start[e] == runs.start[at]) | (not rule.ordered))
            kind = np.where(own, runs.status[at], 0)
        out = []
        if len(part := np.concatenate([e[kind == WINDOW], np.flatnonzero(b.hot)])):
            pos, doc, k, fp = b.windows(part)
            out += _request(WINDOW, key[0].as_py(), buckets, rule, b.ids[doc], pos - b.offs[doc], k, fp)
        if len(part := e[kind == CONTENT]):
            content = lambda i: b.symbols[b.first[part[i]] : b.last[part[i]] + rule.window]
            out += _request(CONTENT, key[0].as_py(), buckets, rule, b.ids[b.doc[part]], b.start[part], b.key[part], b.fp[part], content)
        return _rows(out, _REQUEST_SCHEMA)

    def second(table):
        out = []
        windows = table.filter(pc.equal(table["kind"], WINDOW))
        if windows.num_rows:
            out += _resolve(WINDOW, windows, rule)
        content = table.filter(pc.equal(table["kind"], CONTENT))
        if content.num_rows:
            out += _by_resolver(content, rule, resolver)
        return _rows(out, _ANSWER_SCHEMA)

    def end(key, left, told):
        b = Block(left, rule)
        return finish(b, covered(b, told))

    asked = rows.groupBy("block").applyInArrow(released(ask), _REQUEST)
    told = settled(asked.groupBy("bucket").applyInArrow(released(first), _ANSWER))
    again = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(released(ask_again), _REQUEST)
    told = told.unionByName(again.groupBy("bucket").applyInArrow(released(second), _ANSWER))
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(released(end), schema)


def _by_resolver(table: pa.Table, rule: Rule, resolver: Callable) -> list[dict]:
    content = table["content"].to_pylist()
    ends = [np.cumsum(np.frombuffer(v, "<u2").astype(np.int64)) for v in table["size"].to_pylist()]

    def symbols(row: int, place: int) -> list[int]:
        a = int(ends[row][place - 1]) if place else 0
        return np.frombuffer(content[row], "<u8")[a : int(ends[row][place])].tolist()

    out = []
    for x in _in_parts(table, rule):
        o = np.lexsort((x["start"], x["doc"], x["key"]))
        c = _cuts(x["key"][o])
        who, win = [], []
        for a, b in zip(c[:-1], c[1:]):
            e = o[a:b].tolist()
            for i, hits in zip(e, resolver([symbols(x["row"][i], x["place"][i]) for i in e])):
                who += [i] * len(hits)
                win += hits
        if who:
            who = np.array(who)
            out += _answers(CONTENT, x["block"][who], join2(x["key"][who], x["fp"][who]), np.zeros(len(who), np.int64), np.array(win), np.zeros(len(who), np.uint8))
    return out
