"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file is read on the driver (its path is a parameter) and turned into a tokenizers model that is
broadcast (under 4 MB for 50k tokens; MOST_BYTES is checked). Texts are cut by the pattern, distinct pieces of
a batch are encoded once through a byte-to-character alphabet, and a cache of bounded bytes keeps frequent pieces.
A text is read in runs of RUN_PIECES pieces, so that a very long one needs no more than its ids.
Decoding maps ids back to bytes; characters that a token boundary splits come together again as bytes are joined
before they are read as UTF-8.

Defined results. Null text counts as empty: no tokens. Every input row gives one output row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import batches_by_bytes, documents, quoted, released

MOST_BYTES = 64 << 20

#: Bytes of pieces and ids that one task remembers in each of two generations, longest piece remembered, pieces
#: that are encoded together.
CACHE_BYTES, LONGEST, RUN_PIECES = 6 << 20, 256, 200_000


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


def byte_alphabet() -> dict[int, str]:
    """A printable character for every byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(shown))
    return table


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For every token of several bytes the pair it is merged from: what lower ranks make of its bytes."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for r, t in enumerate(tokens):
        if len(t) < 2:
            continue
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            at, best = -1, r
            for i in range(len(parts) - 1):
                k = rank.get(parts[i] + parts[i + 1], r)
                if k < best:
                    at, best = i, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def build(tokens: list[bytes]) -> str:
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    table = byte_alphabet()
    shown = lambda t: "".join(table[b] for b in t)
    model = models.BPE({shown(t): i for i, t in enumerate(tokens)}, [(shown(a), shown(b)) for a, b in merges_of(tokens)], ignore_merges=True)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


class Coder:
    """Encodes and decodes on an executor."""

    def __init__(self, model: str, tokens: list[bytes], pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.tokens = Tokenizer.from_str(model), tokens
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.pieces = regex.compile(pattern).finditer
        self.forget()

    def forget(self) -> None:
        """Pieces with their packed ids; a task starts and ends with none, so that idle workers stay small."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _encoded(self, missing: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            for piece, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                out[piece] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def _ids(self, pieces: list[str]) -> np.ndarray:
        young, old = self.young, self.old
        own, missing = {}, []
        for p in set(pieces):
            if (x := young.get(p)) is None:
                if (x := old.get(p)) is None:
                    missing.append(p)
                    continue
                young[p] = x
                self.size += len(p) + len(x)
            own[p] = x
        if missing:
            new = self._encoded(missing)
            own |= new
            for p, x in new.items():
                if len(p) <= LONGEST:
                    young[p] = x
                    self.size += len(p) + len(x)
        if self.size > CACHE_BYTES:
            self.old, self.young, self.size = young, {}, 0
        return np.frombuffer(b"".join([own[p] for p in pieces]), "<u4")

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The ids of the text, some pieces at a time."""
        found = (m[0] for m in self.pieces(text))
        while run := list(islice(found, RUN_PIECES)):
            yield self._ids(run)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.empty(0, "<u4"), *self.runs(text)])

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


_coders: dict[int, tuple] = {}


def _coder(shared) -> Coder:
    """The worker's coder for a broadcast vocabulary, kept as long as the broadcast is."""
    value = shared.value
    if id(value) not in _coders:
        _coders.clear()
        _coders[id(value)] = (value, Coder(*value))
    return _coders[id(value)][1]


def _done(run):
    """run, after which the worker's coder forgets its pieces, however the task ends."""

    def batches(parts):
        try:
            yield from run(parts)
        finally:
            for _, coder in _coders.values():
                coder.forget()

    return released(batches)


def vocabulary(path: str | None = None) -> tuple[str, list[bytes], str]:
    import public_tokenizers

    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = build(tokens)
    if len(model) + sum(map(len, tokens)) > MOST_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    return model, tokens, public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids, byte_ends and char_starts of its tokens; own columns of these names go.

    char_starts holds the index of the character in which a token starts, also where the token starts inside it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    more = T.StructType.fromDDL("ids array<int>, byte_ends array<int>, char_starts array<int>")
    own = [c for c in docs.columns if c not in more.names]
    rows = docs.select(F.struct(*map(quoted, own)).alias("row"), "text")

    def run(batches):
        coder = _coder(shared)
        for b in batches_by_bytes(batches, "text"):
            ids, ends, starts = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                own = coder.encode(text)
                raw = np.frombuffer(text.encode(), np.uint8)
                end = np.cumsum(coder.sizes[own], dtype=np.int64)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                ids.append(own)
                ends.append(end)
                starts.append(char[np.concatenate([[0], end[:-1]]).astype(np.int64)] if len(own) else [])
            cols = [pa.array(x, pa.list_(pa.int32())) for x in (ids, ends, starts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["row", *more.names])

    return rows.mapInArrow(_done(run), T.StructType([rows.schema["row"], *more])).select("row.*", *more.names)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with decoded: the bytes of its ids; an own column of that name goes."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = df.select(F.struct(*[quoted(c) for c in df.columns if c != "decoded"]).alias("row"), F.col(quoted(ids)).alias("ids"))

    def run(batches):
        coder = _coder(shared)
        for b in batches:
            out = [coder.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["row", "decoded"])

    return rows.mapInArrow(_done(run), T.StructType([rows.schema["row"], T.StructField("decoded", T.BinaryType())])).select("row.*", "decoded")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes decoded from them, without shipping the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        coder = _coder(shared)
        shown = [b"%d" % i for i in range(len(coder.tokens))]
        for b in batches_by_bytes(batches, "text"):
            n, coded, decoded = [], [], []
            for text in b.column(1).to_pylist():
                count, numbers, read = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.runs(text or ""):
                    ids = ids.tolist()
                    numbers.update(b" " * (count > 0) + b" ".join([shown[i] for i in ids]))
                    read.update(coder.decode(ids))
                    count += len(ids)
                n.append(count)
                coded.append(numbers.hexdigest())
                decoded.append(read.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_done(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
