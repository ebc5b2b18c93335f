"""Helpers shared by the training-data operators: Arrow text access, hashing, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text handled at once by the vectorised code, in bytes; bounds a worker's memory, not the input.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lowers the session's bytes in an Arrow batch to `limit`, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1") or int(spark.conf.get(key).rstrip("bB")) > limit:
        spark.conf.set(key, str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one in the warehouse, or for a local master a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="tercet-checkpoint-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tercet-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` materialised in the shared checkpoint folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """`df` written as a table in the shared checkpoint folder and read again; the files go when the driver's JVM ends.

    Shuffle files of what led to it are released, so that long pipelines do not hold them all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tercet-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    schema = df.schema
    del df
    gc.collect()
    jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def gone(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, once what was made of them is stored, too."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reachable(folder: str) -> bool:
    """Whether tasks can open a stage table's folder without Spark's readers."""
    try:
        where, path = fs.FileSystem.from_uri(folder)
        return where.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [lo, hi) of about `limit` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system; idle workers else keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_text(docs: DataFrame, keep: list[str], text: str, schema: str, each: Callable, names: list[str] | None = None) -> DataFrame:
    """Runs each(batch, data, offsets) over blocks of whole texts; it yields or returns Arrow arrays for `schema`.

    Only the columns of `keep` and `text` are read; extra columns never reach Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.num_columns - 1))
            for lo, hi in blocks(off):
                out = each(batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if out is not None and (len(out) and len(out[0])):
                    yield pa.RecordBatch.from_arrays(out, names=columns)
                out = None
        release()

    small_batches(docs.sparkSession)
    columns = names or [x.split()[0] for x in schema.split(",")]
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start+length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(n, 4096)
        p = np.full(m, _BASE, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def slice_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every slice; slices are in order and do not overlap; lengths are at least 1."""
    if not len(starts):
        return np.zeros(0, U64)
    at = ranges(starts, lengths)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
    terms = mix(data[at].astype(U64) + U64(0x51ED27)) * powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, first) + lengths.astype(U64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of word bytes, none across rows, and the number of words before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1 - s, np.searchsorted(s, offsets)
