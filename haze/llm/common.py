"""Helpers shared by the text operators: scratch tables, Arrow text access, word hashing, packed arrays.

Everything that runs inside a task works on one Arrow batch (or one bounded group) with
numpy. Text is cut into pieces of a few megabytes, so the size of a task's arrays does not
follow the size of its partition.
"""

from __future__ import annotations

import ctypes
import struct
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from haze.session import ship  # noqa: F401

U64 = np.uint64
CHUNK_BYTES = (1 << 19) - 1
TARGET_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
_LIBC = ctypes.CDLL(None)
TRIM_SECONDS = 5.0
_trimmed = 0.0


# ---------------------------------------------------------------- scratch tables

def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; local masters fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="run-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if getattr(_STAGE, "now", None) is not None:
        _STAGE.now.append((path, None))
    return path


#: Scratch folders (with the table over them, if any) of this thread's pipeline stages.
_STAGE = threading.local()


@contextmanager
def stage(docs: DataFrame):
    """One stage of a pipeline: ``docs`` is what the stage before it wrote.

    The stages before it are written, so their scratch is deleted here, except folders that ``docs``
    itself reads. Scratch made outside a stage is never touched. Arrow batches are bounded by bytes
    for the session: the default bounds rows, and workers that live through all stages add up."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    left = getattr(_STAGE, "left", [])
    if left:
        read = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
        kept = []
        for path, table in left:
            name = path.rsplit("/", 1)[1]
            if any(name in folder for folder in read):
                kept.append((path, table))
                continue
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        left = kept
    _STAGE.left, _STAGE.now = left, []
    try:
        yield
    finally:
        _STAGE.left, _STAGE.now = _STAGE.left + _STAGE.now, None


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system: workers outlive their tasks.

    At most every ``TRIM_SECONDS``: what is handed back must be asked for again."""
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_SECONDS:
        return
    _trimmed = time.monotonic()
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(fn):
    """``fn`` over a task's batches, giving its memory back at the end."""
    @wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` returned and that nothing reads any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """Shuffle width for ``df``: the session's setting, or more where the input's size asks for it.

    Spark does not know the size of every plan (rows from Python, RDDs); then the setting holds."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = 1 << 16
    if size >= 1 << 56:
        size = 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, size // target), 1)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` as a table bucketed by ``key``: later groupings by it read it without a shuffle."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = scratch_dir(spark)
    (df.repartition(n, key).write.bucketBy(n, key).option("path", path)
       .option("compression", "zstd").format("parquet").saveAsTable(name))
    if getattr(_STAGE, "now", None):
        _STAGE.now[-1] = (path, name)
    return spark.table(name)


# ---------------------------------------------------------------- Arrow text

def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.array([], pa.large_string()) if not col.num_chunks else pa.concat_arrays(col.chunks)
    if col.type != pa.large_binary():
        col = col.cast(pa.large_string()).cast(pa.large_binary()) if col.type != pa.binary() else col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch, name: str, limit: int = CHUNK_BYTES) -> Iterator:
    """Slices of ``batch`` holding at most ``limit`` bytes of column ``name`` (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0)
    ends = np.cumsum(np.asarray(lengths).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def spread(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; a null id becomes the largest value, so it precedes nothing."""
    return np.asarray(pc.fill_null(col.cast(pa.int64()), NO_ID)).astype(np.int64)


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_SPACE
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a run of texts: byte ranges, the row of each word, words per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, self.rows = data, len(offsets) - 1
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2] | edge[1:-1] if len(data) else True
        closes = inside[:-1] & (~inside[1:] | edge[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        table, powers, inverse = _byte_tables(seed, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(table[self.data] * powers[:len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


_TABLES: dict[int, tuple] = {}


def _byte_tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values with the powers of an odd base and of its inverse modulo 2**64."""
    if seed not in _TABLES or len(_TABLES[seed][1]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        base = int(rng.integers(1 << 61, 1 << 62)) * 4 + 3
        columns = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            columns.append(np.multiply.accumulate(p))
        _TABLES[seed] = (values, *columns)
    return _TABLES[seed]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def window_hashes(words: np.ndarray, length: int, seed: int = 11) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes (also across rows: mask those)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    _, powers, inverse = _byte_tables(seed, len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers[:len(words)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * inverse[:n] + U64(length))


def window_ok(row: np.ndarray, length: int) -> np.ndarray:
    """True where the window of ``length`` words stays inside one row."""
    n = len(row) - length + 1
    return row[:n] == row[length - 1:] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Mask over ``n`` words: those inside [start, start + length) of any start."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


# ---------------------------------------------------------------- packed arrays

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; ``ascending`` stores differences."""
    v = np.ascontiguousarray(values).astype(U64)
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T) if len(v) else np.zeros(0, np.uint8)
    return struct.pack("<IBB", len(v), width, ascending) + _PACK.compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    """Inverse of ``pack``."""
    n, width, ascending = struct.unpack_from("<IBB", raw)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_UNPACK.decompress(raw[6:]), np.uint8).reshape(width, n).T
    v = out.reshape(-1).view(U64)
    return np.cumsum(v, dtype=U64) if ascending else v


def pack_bits(mask: np.ndarray) -> bytes:
    return struct.pack("<I", len(mask)) + _PACK.compress(np.packbits(mask).tobytes())


def unpack_bits(raw: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", raw)[0]
    return np.unpackbits(np.frombuffer(_UNPACK.decompress(raw[4:]), np.uint8), count=n).astype(bool)


def bucket_of(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of a hash of ``bits`` bits: equal slices of the hash range, ascending with the hash."""
    return ((hashes >> U64(bits - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def join_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the kept words of each row joined by one space."""
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(start - (ends - size), size) + np.arange(total)
    data = np.concatenate([words.data, np.zeros(1, np.uint8)])
    out = data[np.minimum(source, len(words.data))]
    out[ends - 1] = 0x20
    per_row = np.concatenate([[0], np.cumsum(np.bincount(words.row[keep], weights=size, minlength=words.rows))]).astype(np.int64)
    return out, per_row
