"""Shared plumbing of the pipeline operators: code shipping, workers' memory, Arrow batches."""

from __future__ import annotations

import ctypes
import math
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.scratch import save, scratch_path

#: Text bytes that a Python worker handles at a time; bounds its memory whatever Arrow's batches hold.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to a worker (a row that is longer goes alone).
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors (once per application) and bounds the session's Arrow batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(), f"gneiss_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "gneiss")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(out)


def settle() -> None:
    """In a worker, once: one heap for all threads, whose large blocks go back to the system as soon as they are freed."""
    if "_libc" in globals():
        return
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    libc = ctypes.CDLL(None) if sys.platform == "linux" else None
    if libc is not None and hasattr(libc, "mallopt"):
        # M_ARENA_MAX, M_MMAP_THRESHOLD and M_TRIM_THRESHOLD of the C library
        for key, value in ((-8, 1), (-3, 4 << 20), (-1, 16 << 20)):
            libc.mallopt(key, value)
    pa.set_memory_pool(pa.system_memory_pool())
    globals()["_libc"] = libc


def give_back() -> None:
    """Returns what a worker has freed to the system, since workers are kept from stage to stage."""
    if hasattr(libc := globals().get("_libc"), "malloc_trim"):
        libc.malloc_trim(0)


def _lean_batches(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()
    try:
        yield from run(batches)
    finally:
        give_back()


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose workers keep no freed memory from task to task."""
    return partial(_lean_batches, run)


def map_groups(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """applyInArrow on each group of a key, likewise."""

    def lean_group(group: pa.Table) -> pa.Table:
        settle()
        try:
            return run(group)
        finally:
            give_back()

    return df.groupBy(key).applyInArrow(lean_group, schema)


def buckets(df: DataFrame, mb_each: float, least: int = 8) -> int:
    """A number of groups in proportion to the input's size on disk (as Catalyst knows it; where it doesn't, from partitions)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.rdd.getNumPartitions() * (8 << 20)
    return max(least, min(1 << 20, math.ceil(size / 1e6 / mb_each)))


def two_columns(df: DataFrame, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """Only the id, the text and, if asked for, the row's key, under fixed names, so that other columns cannot clash."""
    own = [F.col(f"`{key_col}`").alias("key")] if key_col else []
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *own)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns equals, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ids_repeat(df: DataFrame, id_col: str) -> bool:
    """Whether an id that is not null occurs in several rows."""
    return bool(df.select(F.col(f"`{id_col}`").alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())


def with_row_key(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df with a long column, and its name, that tells rows apart: the id where ids are unique and not null, else numbers that are written with the rows."""
    key = fresh("row_key", df.columns)
    own = F.col(f"`{id_col}`").cast("long")
    if not ids_repeat(df, id_col) and not df.filter(own.isNull()).limit(1).count():
        return df.withColumn(key, own), key
    return save(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets); nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut where their text exceeds limit bytes; a single longer text stands alone."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = flat(b.column(b.schema.get_field_index(col)))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def gathered(batches: Iterator[pa.RecordBatch], limit: int, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches put together until their text reaches limit bytes, and cut where it exceeds them."""
    own, size = [], 0
    for b in pieces(batches, col, limit):
        n = int(flat(column(b, col))[1][-1])
        if own and size + n > limit:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own, size = [], 0
        own, size = [*own, b], size + n
    if own:
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column without nulls as an array."""
    return column(b, name).to_numpy(zero_copy_only=False).astype(np.int64)


def crc32_mod(id_col: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k
