"""Operators of the training-data subpackage against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from loomtext.llm import bpe, components, decontaminate, langid, line_dedup, near_dedup, quality, substring_dedup, suffix_dedup, tokencount, warc
from loomtext.llm._util import LAST_ID, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghé漢", k=rng.randint(1, 7))) for _ in range(60)]


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", ". ", "\t"]) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages and lines, odd cases."""
    r = random.Random(7)
    base = [prose(r, 60) for _ in range(25)]
    texts = [*base, base[0], base[0], base[3] + " tail", "head " + base[4], base[5][:200] + prose(r, 20) + base[6][100:300]]
    for i in range(12):
        w = base[8].split(" ")
        for _ in range(1 + i % 3):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    texts += [f"{base[9]}\nA line that many documents hold\n{prose(r, 5)}\n  a LINE that many documents hold \t" for _ in range(6)]
    texts += ["", " \n\t ", "x", "a b c", "a b c", "é" * 70, "é" * 70, "z" * 5000, "z" * 5000, "ab " * 400, "\n\n\n", "\x00\x01 \x85  weird　spaces", None, None]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "src", 1), (3, "other text of a repeated id " + base[3], "en", None, None), (None, base[1], None, None, None), (None, "only here " + prose(r, 40), "fr", None, 0)]
    r.shuffle(rows)
    return rows


ROWS = corpus()
IDS = [LAST_ID if x[0] is None else x[0] for x in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def collected(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def raw(t) -> bytes:
    return (t or "").encode()


def back(i):
    return None if i == LAST_ID else i


# ---- 3, 5: repeated windows


def cover(symbols, window, earlier):
    """Flags of symbols in windows that earlier() holds."""
    hit = [False] * len(symbols)
    for i in range(len(symbols) - window + 1):
        if earlier(tuple(symbols[i : i + window]), i):
            hit[i : i + window] = [True] * window
    return hit


def first_positions(texts, window):
    first = {}
    for i, s in zip(IDS, texts):
        for p in range(len(s) - window + 1):
            k = tuple(s[p : p + window])
            first[k] = min(first.get(k, (LAST_ID + 1, 0)), (i, p))
    return first


def brute_suffix():
    texts = [raw(x[1]) for x in ROWS]
    first = first_positions(texts, 50)
    want = Counter()
    for i, t in zip(IDS, texts):
        hit = cover(t, 50, lambda k, p, i=i: first[k][0] < i)
        spans = sum(b and not a for a, b in zip([False, *hit], hit))
        want[back(i), len(t), sum(hit), spans, sha(bytes(c for c, h in zip(t, hit) if not h))] += 1
    return want


@pytest.mark.parametrize("hot_runs", [0, 1, 16])
def test_suffix_dedup(docs, hot_runs):
    """Also where every anchor, or every one with two runs in a block, is sent as a mark."""
    out = suffix_dedup.suffix_dedup(docs, hot_runs=hot_runs)
    assert collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix()
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in out.collect())


@pytest.mark.parametrize("most_runs,hot_runs", [(0, 16), (1, 16), (64, 16), (64, 0), (64, 1)])
def test_substring_dedup(docs, most_runs, hot_runs):
    texts = [raw(x[1]).split() for x in ROWS]
    first = first_positions(texts, 20)
    want = Counter()
    for i, t in zip(IDS, texts):
        hit = cover(t, 20, lambda k, p, i=i: first[k] < (i, p))
        want[back(i), len(t), sum(hit), sha(b" ".join(w for w, h in zip(t, hit) if not h))] += 1
    assert collected(substring_dedup.substring_dedup(docs, most_runs=most_runs, hot_runs=hot_runs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_blocks_and_buckets_in_parts(monkeypatch):
    """Neither the steps in which a block is read nor the parts in which a bucket is unpacked change a thing."""
    import pyarrow as pa

    from loomtext.llm import repeats

    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(r.choice([0, 10, 49, 50, 51, 300, 2000]))) for _ in range(30)] + ["z" * 700, " ".join(r.choice(["x", "yy"]) for _ in range(300))]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    for rule in (repeats.Rule(50, 24, False, False), repeats.Rule(20, 8, True, True)):
        want = repeats.Block(table, rule)
        sizes = [len(raw(t).split()) if rule.words else len(t) for t in texts]
        assert (want.last - want.first + 1).sum() == sum(max(0, n - rule.window + 1) for n in sizes)
        rows = repeats._rows(repeats._request(repeats.RUN, 0, 1, rule, want.ids[want.doc], want.start, want.key, want.fp), repeats._REQUEST_SCHEMA)
        whole = next(repeats._in_parts(rows, rule))
        for step in (1, 7, 64, 501):
            monkeypatch.setattr(repeats, "STEP", step)
            monkeypatch.setattr(repeats, "PART_ENTRIES", 5 * step)
            got = repeats.Block(table, rule)
            assert all(np.array_equal(getattr(got, f), getattr(want, f)) for f in ("first", "last", "anchor", "doc", "key", "fp", "ident", "start", "hot"))
            parts = list(repeats._in_parts(rows, rule))
            assert all(sorted(np.concatenate([p[f] for p in parts]).tolist()) == sorted(whole[f].tolist()) for f in ("key", "fp", "doc", "start", "place"))
            assert not parts[1:] or not any(set(a["key"]) & set(b["key"]) for a, b in zip(parts, parts[1:]))
        monkeypatch.undo()


def test_suffix_automaton():
    r = random.Random(2)
    for _ in range(100):
        seqs = [r.choices("ab", k=r.randint(0, 12)) for _ in range(3)]
        q = r.choices("ab", k=15)
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        inside = lambda w: any(s[i : i + len(w)] == w for s in seqs for i in range(len(s) - len(w) + 1))
        want = [max(n for n in range(i + 2) if n == 0 or inside(q[i + 1 - n : i + 1])) for i in range(len(q))]
        assert list(a.statistics(q)) == want


# ---- 2: lines


@pytest.mark.parametrize("hot_rows", [500, 2])
def test_line_dedup(spark, docs, hot_rows):
    key = lambda x: x.strip(b" \t\n\v\f\r").lower()
    holders = defaultdict(set)
    for i, x in zip(IDS, ROWS):
        for line in raw(x[1]).split(b"\n"):
            if len(key(line).decode()) >= 10:
                holders[key(line)].add(i)
    want = Counter()
    for i, x in zip(IDS, ROWS):
        lines = raw(x[1]).split(b"\n")
        kept = [y for y in lines if not (key(y) in holders and min(holders[key(y)]) < i)]
        want[back(i), len(lines), len(lines) - len(kept), sha(b"\n".join(kept))] += 1
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        out = line_dedup.line_dedup(docs, batches, fanout, hot_rows=hot_rows, sampled=1 if hot_rows == 2 else 32)
        assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert collected(out, "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)) == want


def test_lines_of_documents_without_ids(spark):
    """Most rows, and then all, have no doc_id: they count as one document, the last."""
    for known in (3, 0):
        rows = [(i if i < known else None, f"a line of its own {i}\nthe line that all of them hold") for i in range(40)]
        out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.n_dropped for r in out) == [0] * (1 if known else 40) + [1] * (39 if known else 0)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_levelled(spark, docs):
    runs = line_dedup.Runs(spark, fanout=2)
    keys = line_dedup.line_keys(docs)
    for k in range(5):
        runs.add(keys.where(f"doc_id % 5 = {k}"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    every = [r for df in runs.runs() for r in df.select("h1", "h2").collect()]
    assert len(every) == len(set(every)) == keys.select("h1", "h2").distinct().count()
    runs.close()


# ---- 7: near duplicates


def brute_components(n, percent):
    sets = []
    for x in ROWS:
        w = raw(x[1]).lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = {i: i for i in IDS}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    # every row is judged by its own text; equal sets are one class, named by its smallest document
    rep = {}
    for i, s in zip(IDS, sets):
        if s:
            rep[frozenset(s)] = min(rep.get(frozenset(s), i), i)
    items = list(rep.items())
    for a in range(len(items)):
        for b in range(a):
            both = len(items[a][0] & items[b][0])
            if 100 * both >= percent * len(items[a][0] | items[b][0]):
                x, y = find(items[a][1]), find(items[b][1])
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(rep[frozenset(s)]) if s else i) for i, s in zip(IDS, sets))


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    out = near_dedup.near_duplicates(docs, n)
    assert collected(out, "id", "n_shingles", "component_id") == brute_components(n, 80)


def test_dense_region_with_open_links(spark):
    """A base with copies that are each close to the base but not to each other, and chains."""
    r = random.Random(5)
    base = [r.choice(WORDS) + str(i) for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in r.sample(range(200), r.choice([2, 4, 5, 6, 9])):
            w[p] = f"n{i}-{p}"
        rows.append((i + 1 if i else 500, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert {r.id: r.component_id for r in out.collect()} == {i: find(i) for i, _ in rows}


def test_stage_keeps_one_row_of_each_group(spark):
    """Null and repeated ids, and rows that are the same in all columns, which the operator alone takes for one node."""
    import corpus_pipeline as cp

    base = prose(random.Random(99), 40)
    more = [ROWS[0], (None, "null twice " + base, None, None, 1), (None, "null twice " + base, None, None, 1), (None, "null twice " + base, "en", None, 1), (None, "", None, None, 0), (None, "", None, None, 0), (3, "", None, None, 0)]
    rows = [*ROWS, *more]
    sets = []
    for x in rows:
        w = raw(x[1]).lower().split()
        sets.append(frozenset({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ()))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    kinds = list(root)
    for a in range(len(kinds)):
        for b in range(a):
            both = len(kinds[a] & kinds[b])
            if both and 100 * both >= 80 * len(kinds[a] | kinds[b]):
                root[find(kinds[a])] = find(kinds[b])
    first, empty = {}, Counter()
    for x, s in zip(rows, sets):
        if s:
            first[find(s)] = min(first.get(find(s), LAST_ID), LAST_ID if x[0] is None else x[0])
        else:
            empty[x] += 1
    own = dict(zip((x[1] for x in rows), sets))
    out = cp.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    got = [tuple(r) for r in out.collect()]
    assert all(x in rows for x in got)
    assert Counter(x for x in got if not own[x[1]]) == empty
    assert sorted((id(find(own[x[1]])), LAST_ID if x[0] is None else x[0]) for x in got if own[x[1]]) == sorted((id(s), i) for s, i in first.items())


def test_walk_of_sorted_orders():
    """Common prefixes, parts and neighbours of sorted rows against plain ones."""
    r = np.random.default_rng(3)
    n = 900
    place = r.integers(0, 2, (n, 1 + 2 * near_dedup.DEEPEST), dtype=np.uint8)
    place[:, 1:9] *= r.random((n, 1)) < 0.3  # most share the first values, so that a region is dense
    place = place[np.lexsort(place.T[::-1])]
    rep = r.permutation(n).astype(np.int64)
    lcp, head, near = near_dedup.regions(place, rep)

    def common(i, j):
        if place[i, 0] != place[j, 0]:
            return 0
        return next((d for d in range(near_dedup.DEEPEST) if (place[i, 1 + 2 * d : 3 + 2 * d] != place[j, 1 + 2 * d : 3 + 2 * d]).any()), near_dedup.DEEPEST)

    assert lcp.tolist() == [0] + [common(i - 1, i) for i in range(1, n)]
    for i in range(n):
        for depth in range(near_dedup.DEPTH, near_dedup.DEEPEST + 1):
            part = [j for j in range(n) if j == i or common(i, j) >= depth]
            if len(part) <= near_dedup.DENSE or depth == near_dedup.DEEPEST:
                break
        assert head[i] == rep[part].min()
        sides = [(common(i, j), -(j > i), rep[j]) for j in (i - 1, i + 1) if 0 <= j < n and common(i, j) >= near_dedup.DEPTH]
        assert near[i] == (max(sides)[2] if sides else rep[i])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(7, 7)]
    root = list(range(401))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e if find(i) != i}


# ---- 1: decontamination

BENCH = [("a", " ".join(WORDS[:12])), ("b", " ".join(WORDS[20:40])), ("short", "only three words"), ("none", "!!! ..."), ("null", None), (None, " ".join(WORDS[40:55])), ("b", " ".join(WORDS[41:50]))]


@pytest.mark.parametrize("slices", [250_000, 5])
def test_decontaminate(spark, slices):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = ["x " + " ".join(WORDS[2:11]) + " y", " ".join(WORDS[:12]).upper() + " and " + "; ".join(WORDS[25:36]), "ONLY three, words!", "only three", "", None, " ".join(WORDS[40:55]), "a " * 3000, " ".join(WORDS[20:27]) + " z"]
    rows = [(i % 8, t) for i, t in enumerate(texts)]
    windows = defaultdict(set)
    for item, t in BENCH:
        w = word(t)
        n = min(8, len(w))
        if item is not None and w:
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    want = Counter()
    for i, t in rows:
        w, items, hit = word(t), set(), set()
        for p in range(len(w)):
            for n in {len(k) for k in windows}:
                if p + n <= len(w) and (found := windows.get(tuple(w[p : p + n]))):
                    items |= found
                    hit |= set(range(p, p + n))
        want[i, len(w), len(hit), len(items), ",".join(sorted(items))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.scan(df, spark.createDataFrame(BENCH, "item_id string, text string"), carry=["doc_id"], slice_windows=slices)
    hits = F.aggregate("found.hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    assert collected(out, "doc_id", "found.n_words", hits, F.size("found.hit_items"), F.array_join("found.hit_items", ",")) == want


def test_cleaned(spark):
    one, two, clean = "Keep this. " + " ".join(WORDS[2:11]) + " And this.", " ".join(WORDS[:12]) + " " + " ".join(WORDS[20:40]), "Nothing here"
    df = spark.createDataFrame([(1, one, 9), (2, two, 9), (3, clean, 9), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.cleaned(df, spark.createDataFrame(BENCH, "item_id string, text string")).collect()}
    assert got == {1: ("Keep this.  And this.", 21), 3: (clean, 9), 4: (None, 0)}


# ---- 8: byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe(docs, encoding):
    want = Counter()
    for x in ROWS:
        ids = encoding.encode_ordinary(x[1] or "")
        want[x[0], len(ids), sha(" ".join(map(str, ids))), sha(raw(x[1]))] += 1
    assert collected(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_round_trip(spark, encoding):
    r = random.Random(3)
    pool = [chr(c) for c in [*range(0, 0x180), *range(0x4E00, 0x4E40), 0x1F600, 0x200B, 0x2028, 0x3000, 0x10FFFF]]
    texts = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(300)] + ["<|endoftext|> it's 12345   \n\n x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in bpe.decode(bpe.encode(df)).collect():
        text = row.text or ""
        assert row.ids == encoding.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode() and (not row.ids or row.byte_ends[-1] == len(text.encode()))
        for end, start in zip([0, *row.byte_ends], row.char_starts):
            assert len(text.encode()[:end].decode("utf-8", "ignore")) == start


# ---- 9: token counts


def test_token_counts(spark):
    pieces = tokencount.read_pieces()
    trie = tokencount.Trie(pieces)

    def best(word):
        state = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            c = len(word[j - 1].encode())
            found = [(state[j - 1][0] + c * trie.byte, -(state[j - 1][1] + c))]
            for i in range(max(0, j - trie.longest), j):
                if word[i:j] in pieces:
                    found.append((state[i][0] + pieces[word[i:j]], -(state[i][1] + 1)))
            s = max(found)
            state.append((s[0], -s[1]))
        return state[-1][1]

    texts = [prose(random.Random(i), 40) for i in range(5)] + ["", None, " \n", "internationalisation of the tokenisation", "漢字 😀 naïve", "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(df).collect()}
    for i, t in enumerate(texts):
        w = raw(t).split()
        assert got[i] == (len(w), sum(best("▁" + x.decode()) for x in w))


def test_full_trie_changes_nothing(monkeypatch):
    words = ["▁" + w for w in WORDS]
    a, b = tokencount.Trie(tokencount.read_pieces()), tokencount.Trie(tokencount.read_pieces())
    want = [a.count(w) for w in words * 2]
    monkeypatch.setattr(tokencount, "TRIE_NODES", 5)
    assert [b.count(w) for w in words * 2] == want


# ---- 10: language identification


def test_forward_sums_all_segmentations():
    pieces = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    prob = np.random.default_rng(0).random((260, 2)) / 100
    prob[-1] = 0
    s = langid.Scorer(pieces, ["x", "y"], prob)

    def total(w):
        if not w:
            return np.ones(2)
        return sum(prob[pieces[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    words = ["abc", "aabcbc", "cab", "a", "abcabcabcabc", "abc"]
    for _ in range(2):
        assert np.allclose(s.score(words), [np.log(total(b" " + w.encode())) for w in words])
        s.most = 1
    assert np.isfinite(s.score(["ab" * 100])).all()


def test_forward_of_long_words():
    """Pieces across any position of a long word count."""
    pieces = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, "漢字".encode(): 259, b"abc" * 17: 260}
    prob = np.random.default_rng(0).random((262, 2)) / 100
    prob[-1] = 0
    s = langid.Scorer(pieces, ["x", "y"], prob)
    for word in ("abc" * 30, "漢字" * 12, "a" * 47 + "bc" * 9):
        w = b" " + word.encode()
        sums = [np.ones(2)]
        for j in range(1, len(w) + 1):
            sums.append(sum(sums[i] * prob[pieces[w[i:j]]] for i in range(j) if w[i:j] in pieces))
        assert np.allclose(s.score([word])[0], np.log(sums[-1]), rtol=1e-12)


def test_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "der die das", None), (10**6, None, "en"), (10**6 + 1, "123 !!", "en"), (10**6 + 2, "", "fr")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    got = langid.predict(both, langid.fit(both)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 30 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in langid.predict(odd, langid.fit(both)).collect()}
    assert all(rows[10**6 + k].lang_pred == "und" for k in range(3)) and rows[None].held_out is False


def test_langid_without_training_rows(spark, empty):
    one = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.predict(one, langid.fit(one)).first().lang_pred == "und"


# ---- 6: quality


def brute_signals(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if n[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_signals(docs):
    out = quality.assess(docs, quality.Model(np.zeros(quality.BUCKETS), -1.0), ["doc_id"])
    want = Counter()
    for x in ROWS:
        s = brute_signals(x[1])
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want[(x[0], *s, failed, not failed)] += 1
    assert collected(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_quality_model(spark, sf_dir):
    """The fitted ratios and threshold against counts on the driver."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r.doc_id: raw(r.text) for r in docs.collect()}
    lab = {r.doc_id: r for r in labels.collect()}
    count = lambda ids: sum((np.bincount(quality.buckets_of(texts[i]), minlength=quality.BUCKETS) for i in ids), np.zeros(quality.BUCKETS))
    good = [i for i in texts if i in lab and lab[i].quality == 1 and lab[i].toxic == 0]
    assert np.allclose(model.ratio, quality.ratio_of(count(texts), count(good)))
    out = {r.doc_id: r for r in quality.assess(docs, model).collect()}
    clean = [out[i].kept for i in good if not out[i].base_failed]
    junk = [out[i].kept for i in texts if i in lab and lab[i].quality == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) < 0.2
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in out.values())


def plain_threshold(good, bad, most_lost=0.01):
    if not good:
        return -np.inf
    good, cuts = sorted(good), sorted({*good, *bad})
    by_loss = good[int(most_lost * len(good))]
    if not bad:
        return by_loss
    gain = [sum(x < c for x in bad) / len(bad) - 2 * (sum(x < c for x in good) / len(good)) for c in cuts]
    i = gain.index(max(gain))
    return min(by_loss, (cuts[max(0, i - 1)] + cuts[i]) / 2)


def test_quality_of_all_labels(spark):
    """More labels than are broadcast: counts and threshold are those of every label, by either join."""
    r = random.Random(12)
    rows = [(i, " ".join(r.choices(WORDS[: 30 + i % 31], k=10 + i % 5)), int(i % 3 > 0), int(i % 10 == 0)) for i in range(11_000)]
    more = [(None, "no id " * 12), (3, prose(r, 30)), (20_000, prose(r, 40)), (5, None)]  # without id, repeated, without label
    docs = spark.createDataFrame([x[:2] for x in rows] + more, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[2], x[3]) for x in rows] + [(None, 1, 0), (30_000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    texts = [x[:2] for x in rows] + more
    good = {x[0] for x in rows if x[2] and not x[3]}
    bad = {x[0] for x in rows if not x[2]}
    count = lambda texts: np.bincount(np.concatenate([quality.buckets_of(raw(t)) for t in texts]), minlength=quality.BUCKETS)
    assert np.array_equal(model.ratio, quality.ratio_of(count([t for _, t in texts]), count([t for i, t in texts if i in good])))
    passed = [(i, t) for i, t in texts if t and brute_signals(t)[0] >= 10 and 100 * brute_signals(t)[4] <= 20 * brute_signals(t)[0]]
    score = lambda ids: np.array([model.score(raw(t)) for i, t in passed if i in ids])
    good, bad = np.sort(score(good)), np.sort(score(bad))
    cuts = np.unique([*good, *bad])
    gain = np.searchsorted(bad, cuts) / len(bad) - 2 * (np.searchsorted(good, cuts) / len(good))
    i = int(np.argmax(gain))
    assert model.threshold == min(good[len(good) // 100], (cuts[max(0, i - 1)] + cuts[i]) / 2)
    again = quality.fit(docs, labels, broadcast_rows=10**6)
    assert np.array_equal(again.ratio, model.ratio) and again.threshold == model.threshold


def test_quality_threshold(spark):
    """Ties, scores in one range and in many, one kind only."""
    r = random.Random(13)
    for n, m, digits, lost, ranges in [(300, 80, 1, 0.01, 4), (300, 80, 1, 0.9, 1024), (150, 200, 9, 0.5, 1), (200, 200, 3, 0.8, 16), (40, 0, 2, 0.3, 8), (0, 9, 2, 0.3, 8), (1, 1, 0, 0.01, 8)]:
        good, bad = [round(r.gauss(0.6, 1), digits) for _ in range(n)], [round(r.gauss(-0.9, 1), digits) for _ in range(m)]
        df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "score double, good boolean").repartition(3)
        assert quality.threshold_of(df, lost, ranges) == plain_threshold(good, bad, lost)


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs, quality.fit(docs, labels))
    assert out.where("kept = base_failed").count() == 0


# ---- 4: WARC

_INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 400\r\n\r\n" + "HTTP/1.1 200 OK\r\n\r\n" + "q" * 381 + "\r\n\r\n"
#: Whole records in a row, one of a length that fits nothing, and one that claims all that follows.
NESTED = "\r\n\r\n" + _INNER * 4 + "mid" + _INNER.replace("400", "12") + _INNER.replace("400", "99999999") + _INNER
FAKE = "pay\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\nWARC/1.0\rxx" + "p" * 120


def test_warc(spark):
    body = "<html>" + "x" * 200
    rows = [(5, "http://a", body), (2, "http://b\r\nX: y", body), (9, None, body), (1, "u", ""), (3, "u", None), (4, "u", "short"), (6, "u", "short"), (7, "u", FAKE), (8, "u", FAKE), (10, "u", "é漢" * 60), (None, "u", "no id" * 40), (11, "u", "\r\n\r\n" * 50)]
    rows += [(12, "u", _INNER * 2), (13, "u", NESTED), (14, "u", NESTED), (15, "u", _INNER), (16, "u", "x" + _INNER * 20)]
    rows += [(100 + i, "u", prose(random.Random(i), 50)) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        if len(raw(h)) >= 100:
            first[raw(h)] = min(first.get(raw(h), 10**9), i if i is not None else 10**9)
    want = Counter()
    for i, _, h in rows:
        again = first.get(raw(h), i) != i and i is not None
        want[i, len(raw(h)), sha(raw(h)), "revisit" if again else "response", first[raw(h)] if again else None] += 1
    path = scratch(spark)
    warc.write(df.coalesce(2), path)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collected(warc.read(spark, path), *cols) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("997", "4099"):  # records across many splits, cuts inside the delimiter
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert collected(warc.read(spark, path), *cols) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_warc_rejects_other_files(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"no record here")
    with pytest.raises(Exception, match="does not start with a record"):
        warc.read(spark, f"file://{tmp_path}")


# ---- all: empty tables, clashing columns


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.cleaned(empty, bench).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert bpe.digests(empty).count() == 0 and tokencount.token_counts(empty).count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.assess(empty, quality.fit(empty, labels)).count() == 0
    path = scratch(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_clashing_columns(spark):
    extra = ["block", "bucket", "id", "row", "key", "found", "gone", "h1", "set", "rep", "root", "kept", "part", "kind", "score", "ids", "__id2"]
    df = spark.createDataFrame([(1, "a text of some words", *["x"] * len(extra)), (2, "a text of some words", *["y"] * len(extra))], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))
    bench = spark.createDataFrame([("i", "unseen", "z")], "item_id string, text string, found string")
    assert suffix_dedup.suffix_dedup(df).count() == 2 and substring_dedup.substring_dedup(df).count() == 2
    assert near_dedup.near_duplicates(df).count() == 2 and bpe.digests(df).count() == 2 and tokencount.token_counts(df).count() == 2
    assert decontaminate.scan(df, bench, carry=["doc_id"]).count() == 2 and decontaminate.cleaned(df, bench).columns == df.columns
    assert line_dedup.line_dedup(df).columns == [*df.columns, "n_lines", "n_dropped"]
    out = quality.assess(df, quality.Model(np.zeros(quality.BUCKETS), -1.0))
    assert len(set(out.columns)) == len(out.columns) and out.count() == 2
    out = bpe.decode(bpe.encode(df))
    assert out.count() == 2 and [bytes(r.decoded).decode() for r in out.collect()] == ["a text of some words"] * 2


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns of the stages' own names, and names with dots, come out as they were."""
    import corpus_pipeline as cp

    extra = ["kept", "score", "n_words", "n_dropped", "n_lines", "row", "id", "gone", "found", "cut", "ids", "a.b", "x`y", "count"]
    texts = [f"{prose(random.Random(i), 60)}\n{i} and a line of its own" for i in range(6)]
    rows = [(i, t, *[f"{c}{i}" for c in extra]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "nothing of these texts")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r[0]: tuple(r)[2:] for r in out.collect()}
        assert got and all(v == rows[k][2:] for k, v in got.items())
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 6


def test_very_long_texts(spark):
    """A text of 3 MB in lines, one of 1 MB without a space, and their copies."""
    r = random.Random(8)
    long = "\n".join(f"{i} " + " ".join(r.choices(WORDS, k=40)) for i in range(20_000))
    solid = "".join(r.choices("abcdefghij", k=1_000_000))
    rows = [(1, long), (2, long + " tail"), (3, solid), (4, solid), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    by_id = lambda out: {x[0]: x for x in out.collect()}
    sizes = {i: len(t.encode()) for i, t in rows}
    got = by_id(suffix_dedup.suffix_dedup(df, with_text=False))
    assert {i: (x.n_bytes, x.n_removed) for i, x in got.items()} == {1: (sizes[1], 0), 2: (sizes[2], sizes[1]), 3: (sizes[3], 0), 4: (sizes[4], sizes[4]), 5: (5, 0)}
    got = by_id(substring_dedup.substring_dedup(df, with_text=False))
    assert {i: x.n_removed for i, x in got.items()} == {1: 0, 2: 20_000 * 41, 3: 0, 4: 0, 5: 0}
    got = by_id(line_dedup.line_dedup(df))
    assert {i: x.n_dropped for i, x in got.items()} == {1: 0, 2: 19_999, 3: 0, 4: 1, 5: 0}
    got = by_id(near_dedup.near_duplicates(df))
    assert {i: x.component_id for i, x in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    got = by_id(bpe.digests(df))
    assert all(got[i].decoded_sha256 == sha(t) for i, t in rows)
    got = by_id(quality.assess(df, quality.Model(np.zeros(quality.BUCKETS), -1.0), ["doc_id"]))
    assert got[1].n_words == 20_000 * 41 and got[3].word_chars == 1_000_000
    bench = spark.createDataFrame([("tail", " ".join(long.split()[-9:]))], "item_id string, text string")
    assert {x.doc_id for x in decontaminate.scan(df, bench, carry=["doc_id"]).where("size(found.hit_items) > 0").collect()} == {1, 2}
    trie = tokencount.Trie(tokencount.read_pieces())
    assert trie.learn(solid[:200_000].encode()) == trie.count(tokencount.MARK + solid[:200_000]) and not trie.terminals


# ---- the registered queries


def test_queries_against_sql(spark, sf_dir, duck):
    from loomtext.llm import registry

    for name, sql in registry.ORACLES.items():
        got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert set(got.columns) == set(want.columns), name
        clean = lambda p: [x.replace(".0,", ",").replace(".0]", "]") for x in rows_of(p)]
        assert clean(got) == clean(want), name


def plain_near_copies(rows) -> set[int]:
    """Ids of rows that are not the smallest of their component, by all pairs."""
    sets = {}
    for r in rows:
        w = raw(r.text).lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) != i}


def plain_cleaning(rows, bench) -> dict[int, str]:
    """What is left of documents without benchmark windows, window by window."""
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = defaultdict(set)
    for r in bench:
        w = word.findall(raw(r.text).lower())
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(r.item_id)
    out = {}
    for r in rows:
        text = raw(r.text)
        at = list(word.finditer(text.lower()))
        w, hit, items = [m[0] for m in at], set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        if len(items) < 2:
            gone = set()
            for i in hit:
                gone |= set(range(at[i].start(), at[i + 1].start() if i + 1 in hit else at[i].end()))
            out[r.doc_id] = bytes(c for i, c in enumerate(text) if i not in gone).decode()
    return out


def test_pipeline(spark, sf_dir, encoding):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "bpe"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one = cp.STAGES[0][1](spark, docs, sf_dir).cache()
    model = quality.fit(docs, labels)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.assess(docs, model).where("kept").collect()}
    two = cp.STAGES[1][1](spark, one, sf_dir).cache()
    assert two.columns == docs.columns and two.count() == one.count()
    seen, want = set(), {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        lines, own = [], set()
        for x in raw(r.text).split(b"\n"):
            k = line_dedup.key_of(x)
            if k is None or k not in seen:
                lines.append(x)
            if k is not None:
                own.add(k)
        seen |= own
        want[r.doc_id] = b"\n".join(lines).decode()
    assert {r.doc_id: r.text or "" for r in two.collect()} == want
    three = cp.STAGES[2][1](spark, two, sf_dir).cache()
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - plain_near_copies(two.collect())
    four = cp.STAGES[3][1](spark, three, sf_dir).cache()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert four.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in four.collect()} == plain_cleaning(three.collect(), bench.collect())
    five = cp.STAGES[4][1](spark, four, sf_dir)
    assert five.count() == four.count() and five.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in five.join(four.select("doc_id", "text"), "doc_id").collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(raw(r.text)))
    whole = cp.run(spark, sf_dir)
    assert collected(whole, *whole.columns) == collected(five, *five.columns)
