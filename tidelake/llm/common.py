"""What the operators share: table access, scratch tables in the shared folder, and byte-level text arrays."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and a Python worker, where the session sets none (Spark's own is 64 MB).
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the session's spark.checkpoint.dir. Where it is unset, a session on one machine
    gets a folder of its own, and a cluster's is refused."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(context.applicationId)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none can clash with a column that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches where the session sets none."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "1b") == "1b":  # not set
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Spark removes a query's shuffle files as soon as it ends, instead of when the driver happens to collect its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files; then the session's own setting holds again."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back, so lost executors cost no rerun. Its shuffle
    files go at once, so the disk that a chain of tables takes is that of one query and not of all."""
    return materialize_in_turn([df], tag, **options)


def materialize_in_turn(parts: Iterable[DataFrame], tag: str, **options: str) -> DataFrame:
    """One table of parts that have the same columns, written one after the other, so that the disk for shuffles is that of
    the largest part. options: of the Parquet writer."""
    path, paths = "", []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        small_batches(spark)
        path = path or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        paths.append(f"{path}/{len(paths)}")
        with shuffles_removed(spark):
            df.write.options(compression="zstd", **options).parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths)


def give_back() -> None:
    """Return freed memory of this process, that of Arrow's pool and of the C library, to the system: a worker that waits
    for its next block would else keep the most that it ever took."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


@functools.cache
def _trim():
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


# ---------------------------------------------------------------- text as byte arrays


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def doc_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes together; a longer text is a range of its own."""
    n = len(off) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 1 << 23:
            return have
        _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of byte value times power, from which any substring's hash follows; see span_hash."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same wherever a span's bytes stand."""
    inv = powers(BASE_INV, len(sums))
    return mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after the other in buf: start, end and text number of each.

    bounds: the texts' n + 1 offsets in buf. Words are runs of bytes that are not white space and never cross texts.
    cuts: for each byte, whether a word is cut in front of it.
    """
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    if cuts is not None:
        edge[:n] |= cuts
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(bounds, s, side="right") - 1


def fold(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id written as text, modulo modulus; -1 for a null id."""
    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) % modulus for x in ids], dtype=np.int64)
