"""Language identification by unigram pieces, summed over all segmentations of each word.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces (a forward pass over its bytes), a text's is the product over its words. Every
single byte is a piece, so that every word has a probability.

Training counts the pieces of the vocabulary's own segmentation over all training rows and smooths them; the
counts (languages x pieces, checked against MOST_CELLS) are the only thing that reaches the driver.

Defined results. Null text or text without a letter: lang_pred `und`, score 0. Without training rows: `und`.
Null doc_ids are never held out and never learned from. Every input row gives one output row.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import batches_by_bytes, documents, released

LETTER = regex.compile(r"\p{L}")
MOST_CELLS = 20_000_000
#: Numbers that a worker's table of word scores holds, and characters of its words.
CACHE_CELLS, CACHE_CHARS = 2_000_000, 4_000_000
#: Distinct words that a training task gathers before it counts their pieces.
FLUSH_WORDS = 200_000


def read_pieces(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(t): int(r) for t, r in pairs}


_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Words lower-cased; digits and symbols are left out."""
    return _WORD.findall(text.lower())


def piece_bytes(word: str) -> bytes:
    """A word as pieces of this vocabulary see it, with the space that they begin with."""
    return b" " + word.encode()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


class Scorer:
    """log P(word | language) for all languages at once."""

    def __init__(self, pieces: dict[bytes, int], langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob  # prob: piece x language
        self.longest = max(map(len, pieces), default=1)
        self.most = max(10_000, CACHE_CELLS // max(1, len(langs)))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.table = np.empty((0, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        """Adds words that are not yet known: those of one length go through the forward pass together."""
        at = len(self.index)
        self.chars += sum(map(len, words))
        self.index.update(zip(words, range(at, at + len(words))))
        if at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((max(len(words), len(self.table), 1024), len(self.langs)))])
        by_len = defaultdict(list)
        for i, w in enumerate(words, at):
            w = piece_bytes(w)
            by_len[len(w)].append((i, w))
        for group in by_len.values():
            for k in range(0, len(group), 2048):
                rows, part = zip(*group[k : k + 2048])
                self.table[list(rows)] = self._forward(part)

    def score(self, words: list[str]) -> np.ndarray:
        """Rows of words x languages."""
        if missing := [w for w in dict.fromkeys(words) if w not in self.index]:
            if len(self.index) + len(missing) > self.most or self.chars > CACHE_CHARS:
                self.clear()
                missing = list(dict.fromkeys(words))
            self.learn(missing)
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def _forward(self, part: list[bytes]) -> np.ndarray:
        n, get = len(part[0]), self.pieces.get
        none = len(self.pieces)  # a row of zeros
        # sums up to the last positions, as far back as a piece may begin
        alpha = deque([np.ones((len(part), len(self.langs)))], maxlen=max(self.longest, 9))
        logs = np.zeros((len(part), len(self.langs)))
        for j in range(1, n + 1):
            now = np.zeros((len(part), len(self.langs)))
            for d in range(min(self.longest, j), 0, -1):
                at = [get(w[j - d : j], none) for w in part]
                if d == 1 or min(at) < none:
                    now += alpha[-d] * self.prob[at]
            alpha.append(now)
            if j % 8 == 0:  # keep numbers in range, for each language by itself
                top = np.maximum(np.max(list(alpha)[-9:], axis=0), 1e-280)
                for x in alpha:
                    x /= top
                logs += np.log(top)
        return np.log(np.maximum(alpha[-1], 1e-300)) + logs

    def texts(self, texts: list[str | None], most: int = 200_000) -> list[tuple[str, float]]:
        """Language and score of each text; texts are taken together until they have most words."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        who, sizes, words = [], [], []

        def flush() -> None:
            if not who:
                return
            total = np.add.reduceat(self.score(words), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), axis=0)
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(who, p.argmax(axis=1).tolist(), p):
                out[i] = (self.langs[best], float(min(1.0, row[best])))
            who.clear(), sizes.clear(), words.clear()

        for i, t in enumerate(texts):
            if not t or not self.langs or not LETTER.search(t) or not (own := words_of(t)):
                continue
            who.append(i)
            sizes.append(len(own))
            words += own
            if len(words) > most:
                flush()
        flush()
        return out


def fit(docs: DataFrame, path: str | None = None, smoothing: float = 0.5) -> tuple[dict[bytes, int], list[str], np.ndarray]:
    """Pieces, languages and piece probabilities from all training rows."""
    pieces = read_pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches):
        import tiktoken

        # a word is a space and what follows it, so many words are encoded in one call
        coder = tiktoken.Encoding("pieces", pat_str=r" [^ ]+", mergeable_ranks=shared.value, special_tokens={})
        found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(shared.value), np.int64))
        words: dict[str, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, own in words.items():
                by_count = defaultdict(list)
                for w, n in own.items():
                    by_count[n].append(w)
                for n, group in by_count.items():
                    found[lang] += n * np.bincount(coder.encode_ordinary(" " + " ".join(group)), minlength=len(shared.value))
            words.clear()

        for b in batches_by_bytes(batches, "text", 2 << 20):
            for doc, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                if doc is not None and lang is not None and text and not held_out(doc):
                    words[lang].update(words_of(text))
            if sum(map(len, words.values())) > FLUSH_WORDS:
                flush()
        flush()
        rows = [(lang, i, n) for lang, own in found.items() for i in np.flatnonzero(own).tolist() for n in (int(own[i]),)]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "piece", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(released(count), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in rows.select("lang", "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).select("lang").distinct().collect())
    if len(langs) * len(pieces) > MOST_CELLS:
        raise ValueError("languages x pieces is too large for one model")
    n = np.full((len(pieces) + 1, len(langs)), smoothing)
    at = {x: i for i, x in enumerate(langs)}
    for r in counts.toLocalIterator():
        n[r.piece, at[r.lang]] += r.n
    n[-1] = 0
    return pieces, langs, n / np.maximum(n.sum(axis=0, keepdims=True), 1e-9)


_scorers: dict[int, tuple] = {}


def _scorer(shared) -> Scorer:
    value = shared.value
    if id(value) not in _scorers:
        _scorers.clear()
        _scorers[id(value)] = (value, Scorer(*value))
    return _scorers[id(value)][1]


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared)
        for b in batches_by_bytes(batches, "text"):
            ids = b.column(0).to_pylist()
            out = scorer.texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
