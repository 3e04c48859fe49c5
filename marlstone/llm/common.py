"""What the operators share: the folder all machines see, written tables, and words of UTF-8 bytes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.plans.scratch import scratch as shared_folder  # noqa: F401

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: Bytes that separate words in most contracts: space and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, read again: lineage ends there and a lost executor costs nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles and broadcasts nothing refers to any more, so that executors delete their files now and not at some later collection."""
    gc.collect()
    for _ in range(2):  # what ends with the first collection may be the last to hold a shuffle
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def long_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long. Ids are integers or null; other types are refused before a job runs, as their order and digits would be lost."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches whose texts in column, as UTF-8 (null: empty), take about max_bytes; one long text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, n = np.cumsum(lengths, dtype=np.int64), 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            part = batch.slice(start, stop - start)
            yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
            start = stop
        del batch, part
        release()
    gc.collect()
    release()


def release() -> None:
    """Gives freed memory back to the system, as a task's worker is kept for later tasks of any kind."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LENGTHS = np.uint64(0x9E3779B97F4A7C15)
#: Byte runs beyond this are hashed and compared one by one; shorter ones all together, eight bytes at a time.
LONG_RUN = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def padded(data: bytes) -> np.ndarray:
    """The bytes with eight zeros after them, as hashed_runs and equal_runs read them."""
    return np.frombuffer(data + bytes(8), np.uint8)


def _lanes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


def _lane(view: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    lane = view[at]
    short = rest < 8
    lane[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
    return lane


def hashed_runs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs of a padded buffer, the same in all processes.

    The length and then eight bytes at a time pass through a bijective mixer, so runs of one length up to eight bytes never share a hash; long runs take the first 64 bits of BLAKE2b.
    Nothing is summed over places, so texts of a regular structure collide no more than others.
    """
    lengths, view = ends - starts, _lanes(buffer)
    out = mixed(lengths.astype(np.uint64) * _LENGTHS)
    going, at = np.flatnonzero((lengths > 0) & (lengths <= LONG_RUN)), 0
    while len(going):
        rest = lengths[going] - at
        out[going] = mixed(out[going] ^ _lane(view, starts[going] + at, rest))
        at, going = at + 8, going[rest > 8]
    for i in np.flatnonzero(lengths > LONG_RUN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether runs of padded buffers, of the same lengths, hold the same bytes."""
    one, two, out = _lanes(a), _lanes(b), np.ones(len(lengths), bool)
    going, at = np.flatnonzero((lengths > 0) & (lengths <= LONG_RUN)), 0
    while len(going):
        rest = lengths[going] - at
        same = _lane(one, a_starts[going] + at, rest) == _lane(two, b_starts[going] + at, rest)
        out[going[~same]] = False
        at, going = at + 8, going[same & (rest > 8)]
    for i in np.flatnonzero(lengths > LONG_RUN).tolist():
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + lengths[i]], b[b_starts[i] : b_starts[i] + lengths[i]])
    return out


class WordHasher:
    """Splits lists of UTF-8 texts into words and hashes each to 64 bits (hashed_runs), A-Z lower-cased, without a Python object for each word.

    separators: the bytes that end words.
    """

    def __init__(self, separators: bytes = SPACES):
        lower = np.arange(256)
        lower[ord("A") : ord("Z") + 1] += 32
        self.lower = lower.astype(np.uint8)
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each text the index of its first word, with the end of the last."""
        separator = bytes([int(np.argmin(self.word))])
        buffer = self.lower[padded(separator.join([b"", *texts, b""]))]
        isword = self.word[buffer[:-8]]
        change = np.flatnonzero(np.diff(isword.view(np.int8), prepend=np.int8(0)))
        starts, ends = change[::2], change[1::2]
        text_starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return hashed_runs(buffer, starts, ends), np.searchsorted(starts, text_starts)
