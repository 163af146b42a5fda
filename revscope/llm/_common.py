"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revscope.cluster import ship_package, staged

__all__ = ["arrow_map", "bitmap_split", "bound_batches", "bytes_of", "documents", "grouped", "hash_words", "keyed", "mix64", "release", "released", "released_pair", "share", "slices", "small_batches", "staged", "table_bytes"]

#: Multiplier of the polynomial hash of a word's bytes: any odd number serves, and it must stay fixed between tasks.
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes of a batch of rows that a task hands to Python or takes from it: batches lie outside the heap on both sides, about twice over.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators work on, whatever else the table carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def share(column: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the value and the seed alone: the same rows in every attempt of a task."""
    return (F.xxhash64(column, F.lit(seed)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Memory that a worker has freed goes back to the system: workers outlive their tasks, and what an idle one keeps counts beside the heap of its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of groups that leaves no freed memory in its worker."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            release()

    return run


def released_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``released`` for functions of two groups; Spark goes by the number of arguments."""

    def run(table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return fn(table, other)
        finally:
            release()

    return run


def bound_batches(spark: SparkSession) -> None:
    """From now on rows pass between Spark and Python in batches of ``BATCH_BYTES`` at most in this session."""
    number = spark.conf.get(ARROW_BYTES).rstrip("bB")
    if not number.isdigit() or int(number) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for what is run inside; the session's own bound comes back."""
    before = spark.conf.get(ARROW_BYTES)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def bitmap_split(df: DataFrame, ids: DataFrame, key: str, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be in ``ids``, and rows whose key is certainly not.

    The test is a bitmap of hashed keys, broadcast as at most ``bits / 64`` rows
    whatever the input, so that the texts of most rows need no shuffle for a join
    with few ids. When the bitmap fills up it lets more rows pass, never fewer.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = ids.select(place.alias("__b")).groupBy(F.floor(F.col("__b") / 64).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__b % 64 as int)))").alias("__bits"))
    marked = df.withColumn("__b", place).join(F.broadcast(staged(marks, "bitmap")), F.floor(F.col("__b") / 64) == F.col("__word"), "left")
    maybe = F.expr("coalesce((shiftright(__bits, cast(__b % 64 as int)) & 1L) = 1L, false)")
    return marked.where(maybe).drop("__b", "__word", "__bits"), marked.where(~maybe).drop("__b", "__word", "__bits")


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column``; a longer value stands alone."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.zeros(len(values), dtype=np.int64)
    if len(values):
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
        sizes = np.diff(offsets.astype(np.int64))
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def table_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one run of bytes and the offsets of its rows (null: empty)."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def bytes_of(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to n of them."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            out, step = np.ones(1, np.uint64), base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step & _MASK
            _powers[name] = out
    return _powers["up"], _powers["down"]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hash_words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of UTF-8 texts.

    Returns 64-bit hashes of the words, where they start and end in ``raw``, and
    per text the index of its first word (one more entry than texts).
    """
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[raw]
    cut = np.zeros(n + 2, dtype=bool)
    cut[offsets + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw] if lower else raw).astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)
