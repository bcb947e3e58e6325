"""Shared helpers of the training-data operators: scratch tables, bounded Arrow slices, vectorised words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes handled at once in a Python worker; a single larger document is handled alone.
SLICE_BYTES = 4 << 20
#: ASCII white space of the word contract, as one regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has written scratch tables to.
SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only where it names none is a local default used (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    told = told or "file:///tmp/spindrift-shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    SCRATCH.append(f"{shared_dir(spark)}/spindrift-{uuid.uuid4().hex}")
    return f"{SCRATCH[-1]}/{name}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process; frames that read them can't be used after it."""
    jvm = spark.sparkContext._jvm
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: Column, n: int) -> Column:
    """crc32(the id as text) mod n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def give_back() -> None:
    """Return freed memory to the system, so that workers that live on between tasks don't hold their peak."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to do


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most, unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, "4m")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `most` bytes of `text` (a longer row comes alone)."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            give_back()
            at = to


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """df.mapInArrow(f) over slices of at most `most` bytes of text."""

    def run(batches):
        for part in slices(batches, text, most):
            out = f(part)
            if out is not None and out.num_rows:
                yield out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def large_text(column: pa.Array) -> pa.Array:
    """A text column as large_string without nulls (null: empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def words_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, uniques): document i has the words uniques[codes[offsets[i]:offsets[i + 1]]].

    A word is a maximal run without ASCII white space; null or blank texts have none.
    """
    text = large_text(column)
    if lower:
        text = lower_ascii(text)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def lower_ascii(text: pa.Array) -> pa.Array:
    """A-Z to a-z only; every other byte stays (UTF-8 continuation bytes are never in that range)."""
    buffers = text.buffers()
    raw = np.frombuffer(buffers[2], dtype=np.uint8).copy() if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    up = (raw >= 65) & (raw <= 90)
    raw[up] += 32
    return pa.Array.from_buffers(text.type, len(text), [buffers[0], buffers[1], pa.py_buffer(raw)], text.null_count, text.offset)


def hashes_of(uniques: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w, seed) for w in uniques.to_pylist()), dtype=np.uint64, count=len(uniques))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's), so that every bit depends on every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
