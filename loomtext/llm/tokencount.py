"""Token counts: Viterbi over a unigram vocabulary, shared between words in a trie.

Pre-tokens are runs of non-space bytes, each preceded by the vocabulary's space mark. Distinct pre-tokens go into
a trie of characters; a node holds the best score of its prefix and the number of pieces on that path, computed
once however many words share the prefix; a terminal's count is what its word costs. The forward pass keeps the best
path, as a count of tokens is that of one segmentation. Piece scores follow Zipf's law in the order of the
vocabulary, log 1 / (rank + 2), as tokenizers are not trained here; characters outside the vocabulary cost one byte
piece for each UTF-8 byte. Ties go to fewer pieces. A worker's trie is bounded (TRIE_NODES) and starts anew when
full; words of over LONGEST bytes go through the same pass without leaving nodes. Neither changes a count.

Defined results. Null or empty text, or only white space: no tokens. Every input row gives one output row.
"""

from __future__ import annotations

import gc
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import batches_by_bytes, documents, released

MARK = "▁"
TRIE_NODES = 200_000
#: Words whose terminals a worker finds at once, also after the trie has been renewed; longest word of the trie.
TERMINALS, LONGEST = 300_000, 64


def read_pieces(path: str | None = None) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class Trie:
    """Nodes are [score, pieces, children, open]: the best path to a prefix, and the pieces that may still end
    behind it, each as (its node among the pieces, score and pieces where it began)."""

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        self.byte = -math.log(len(pieces) + 2)
        self.pieces: list = [{}, None]  # [children, score]
        for piece, score in pieces.items():
            node = self.pieces
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.terminals: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.root = [0.0, 0, {}, ()]
        self.nodes = 1

    def _step(self, node: list, c: str) -> list:
        """The node that c leads to."""
        size = 1 if c < "\x80" else len(c.encode())
        score, n = node[0] + size * self.byte, node[1] + size
        still = []
        for piece, from_score, from_n in (*node[3], (self.pieces, node[0], node[1])):
            longer = piece[0].get(c)
            if longer is not None:
                still.append((longer, from_score, from_n))
                if (s := longer[1]) is not None:
                    s, m = from_score + s, from_n + 1
                    if s > score or s == score and m < n:
                        score, n = s, m
        return [score, n, {}, still]

    def _child(self, node: list, c: str) -> list:
        child = node[2][c] = self._step(node, c)
        self.nodes += 1
        return child

    def count(self, word: str) -> int:
        """Pieces of the best path of a word, from nodes that words with the same prefix share."""
        if self.nodes > TRIE_NODES:
            self.clear()
        node = self.root
        for c in word:
            node = node[2].get(c) or self._child(node, c)
        return node[1]

    def count_alone(self, word: str) -> int:
        """The same without nodes that stay, in memory that does not grow with the word."""
        node = [0.0, 0, {}, ()]
        for c in word:
            node = self._step(node, c)
        return node[1]

    def learn(self, raw: bytes) -> int:
        """The count of a word; its terminal is remembered unless the word is long."""
        word = MARK + raw.decode("utf-8", "replace")
        if len(raw) > LONGEST:
            return self.count_alone(word)
        if len(self.terminals) >= TERMINALS:
            self.terminals.clear()
        n = self.terminals[raw] = self.count(word)
        return n


_tries: dict[int, tuple] = {}


def _trie(shared) -> Trie:
    value = shared.value
    if id(value) not in _tries:
        _tries.clear()
        _tries[id(value)] = (value, Trie(value))
    return _tries[id(value)][1]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    pieces = read_pieces(path)
    if len(pieces) > 1_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        trie = _trie(shared)
        known = trie.terminals.get
        gc.disable()  # a trie has no cycles, and walking it over and over costs more than building it
        try:
            for b in batches_by_bytes(batches, "text"):
                words, tokens = [], []
                for text in b.column(1).to_pylist():
                    own = Counter((text or "").encode().split())
                    total = 0
                    for w, n in own.items():
                        if (k := known(w)) is None:
                            k = trie.learn(w)
                        total += n * k
                    words.append(sum(own.values()))
                    tokens.append(total)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
        finally:
            gc.freeze()
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n_pretokens long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
