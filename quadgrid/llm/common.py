"""Helpers that the operators share: tables, shared folders and word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def runs_in_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new URI below spark.checkpoint.dir, which the driver and all executors share.

    Where that setting is missing, a temporary folder is set if all tasks run in this process
    (tests, notebooks); on a cluster it is an error, as other machines couldn't see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        elif not runs_in_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="quadgrid-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here."""
    return written(df, label)[1]


def written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """As `cut`, with the folder's name, for tables that `remove` ends."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    end_with_driver(spark, path)
    return path, spark.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def end_with_driver(spark: SparkSession, path: str) -> None:
    """Have an existing folder deleted when the driver's JVM ends: tables between steps don't pile up."""
    fs, at = _hadoop_path(spark, path)
    fs.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, through Spark's own file systems."""
    fs, at = _hadoop_path(spark, path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with batches bounded by their bytes, as texts may be long (a session's own
    bound stays), and with what a task has freed given back, since its worker serves others after it."""
    conf = df.sparkSession.conf
    if BATCH_CONF not in conf.getAll:
        conf.set(BATCH_CONF, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and the C library's where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it no column of df."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


class AtomicWriter:
    """A file that appears under its name only when complete, so that a task that is
    lost or runs twice leaves either nothing or the same whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.tmp"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def open_map(uri: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped where it is local, else read."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    return np.frombuffer(read_bytes(uri), dtype)


def chunks(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about max_bytes of text each (a longer text is alone)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    start = 0
    while start < len(sizes):
        ends = np.cumsum(sizes[start:])
        n = max(1, int(np.searchsorted(ends, max_bytes, side="right")))
        yield batch.slice(start, n)
        start += n


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> S33)
    x = x * MIX_A
    x ^= x >> S33
    x *= MIX_B
    x ^= x >> S33
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


SHINGLE_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of `size` words; fewer words make one shingle, none none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h *= SHINGLE_P
        h += words[i : n - k + 1 + i]
    h += np.uint64(k)
    return mix(h)
