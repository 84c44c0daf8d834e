"""What the operators share: the shared folder, cut lineage, word and shingle hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Documents table columns, in order.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What separates words: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset (tests
    on one machine) a temporary folder takes its place, and goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if re.match(r"local($|\[)", spark.sparkContext.master):
        own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Where the folders that this thread makes are noted, if anyone asks.
_NOTED: ContextVar[list[str] | None] = ContextVar("folders made", default=None)


@contextmanager
def noting():
    """A list of the folders that are made in the block, in this thread alone, as they come."""
    made: list[str] = []
    token = _NOTED.set(made)
    try:
        yield made
    finally:
        _NOTED.reset(token)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _NOTED.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of intermediate tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialize()'s table, and its folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs only the tasks it ran."""
    return written(df, name)[0]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(n_rows: int, bytes_per_row: int, limit: int = 64 << 20) -> bool:
    """Whether a table of n_rows may be broadcast; beyond the limit the callers join by shuffle. A hash
    table takes about 96 bytes a row besides the row's own."""
    return n_rows * (bytes_per_row + 96) <= limit


def join_checked(left: DataFrame, right: DataFrame, on, how: str, n_rows: int, bytes_per_row: int) -> DataFrame:
    return left.join(F.broadcast(right) if small_enough(n_rows, bytes_per_row) else right, on, how)


def give_back() -> None:
    """Returns freed memory to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of a thousand rows at most and workers that give back
    what a task leaves: rows are whole texts, and idle workers keep their memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


# --- words and shingles -----------------------------------------------------------------------

#: Fixed, arbitrary odd 64-bit constants for hashing (from the golden ratio and a public finaliser).
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


#: A random-looking value for each byte; capitals A-Z share those of a-z.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
BYTE_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.empty(0, np.uint64)
_INVERSES = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _ODD)], dtype=np.uint64)
        _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(int(_ODD), -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order, A-Z taken as a-z."""
    if len(text) > 2 * PIECE:
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            cut = re.compile(rb"[\x20\x09-\x0D]").search(text, end) if end < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(_word_hashes(text[at:end]))
            at = end
        return np.concatenate(out)
    return _word_hashes(text)


def _word_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], IS_SPACE[b], [True]))))
    start, end = edge[::2], edge[1::2]
    p, inv = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[b] * p, out=total[1:])
    return mix64((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer than k words the whole sequence is
    one; without words there are none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _ODD + w[i : len(w) - k + 1 + i]
    h = np.sort(mix64(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
