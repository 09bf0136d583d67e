"""Shared pieces of the training-data operators: hashing, Arrow access, blocks, scratch tables."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id wherever ids are ordered: larger than any other.
LAST_ID = 2**63 - 1

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S32)
    x *= _B
    x ^= x >> _S29
    x *= _A
    x ^= x >> _S32
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs."""
    return mix(a * _C + b)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours of h, from runs of 1, 2, 4, ... joined in pairs."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out = run
            else:
                m = len(h) - done - size + 1
                out = join2(out[:m], run[done : done + m])
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        run = join2(run[:-size], run[size:])
        size *= 2


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [x or b"" for x in a.cast(pa.large_binary()).to_pylist()]


def ids_of(column) -> np.ndarray:
    """doc_ids as int64, null as LAST_ID."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that their texts stay near `most` bytes, whatever single texts weigh."""
    for b in batches:
        a = b.column(b.schema.get_field_index(column))
        if a.nbytes <= most or b.num_rows < 2:
            yield b
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(a), 0)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if j > i:
                yield b.slice(i, j - i)


def trim() -> None:
    """Gives freed memory back to the system, so that a worker that has done its task stays small."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def released(run):
    """run, followed by trim(): for functions of groups or of a task's batches."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def batches(parts):
            try:
                yield from run(parts)
            finally:
                trim()

        return batches

    def group(*parts):
        try:
            return run(*parts)
        finally:
            trim()

    # Spark looks at the number of arguments
    by_count = {1: lambda a: group(a), 2: lambda a, b: group(a, b), 3: lambda a, b, c: group(a, b, c)}
    return by_count[len(inspect.signature(run).parameters)]


def row_of(df: DataFrame) -> F.Column:
    """row: all columns of df as one struct, so that no name clashes with columns that are added."""
    return F.struct(*map(quoted, df.columns)).alias("row")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        import tempfile

        base = tempfile.gettempdir() + "/loomtext-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def goes_with_session(spark: SparkSession, path: str) -> None:
    """Has a written path deleted when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


#: Spark removes the shuffle files of a query that was made under this setting when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, survives lost executors, and the shuffle
    files behind it go."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    goes_with_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame) -> int:
    """Bytes of df's texts: what tasks will hold, however well the files are packed."""
    return df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


#: Target size of a block of documents, and the most that it may grow to on large inputs.
BLOCK_BYTES, MOST_BLOCK_BYTES = 3 << 20, 16 << 20


def block_count(df: DataFrame) -> int:
    """About one block for 3 MB of text; blocks grow to 16 MB so that their number grows slower than the input."""
    size = text_bytes(df)
    target = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, size // 4000))
    return int(max(8, -(-size // target)))


def blocked(docs: DataFrame, n: int, *more: str) -> DataFrame:
    """doc_id, text and further columns, with a block number that depends on the row alone."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


#: Rows of an Arrow batch: texts are long, and a batch lies in the JVM and in Python at the same time.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES, where they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
