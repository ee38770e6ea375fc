"""Shared pieces of the training-data operators: storage, and byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.readers import bound_batches, shared_dir

#: The white space of the contracts: `[\x20\x09-\x0D]`, which is also what ``bytes.split`` takes.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        files.delete(target, True)
    else:
        files.deleteOnExit(target)


_SCOPES: list[list[str]] = []


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. ``options`` are
    the writer's.

    The table goes when its ``scratch`` ends, or ``discard`` is called, or the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    bound_batches(spark)
    df.write.options(**options).parquet(path)
    _delete(spark, path, now=False)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.written_to, now=True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is materialised inside goes at the end, but for tables taken out of the list it gives."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path, now=True)


def sized(small: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast a side of a known row count up to ``bound``; beyond it Spark joins by shuffle."""
    return F.broadcast(small) if rows <= bound else small


def fold_of(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    name = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % modulus


def text_blocks(column: pa.Array, limit: int = 1 << 18):
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows of about ``limit`` bytes.

    Nulls read as empty texts. A longer text makes a block of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, body[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# Words: lower-case A-Z, then runs of 0-9, a-z and bytes over 0x7F.
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOWER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOWER[_b] = _b + 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and its inverse modulo 2**64, for i < n at least."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offs: np.ndarray):
    """Words of a block: start and end bytes, and for each row the number of its first word."""
    low = _LOWER[buf]
    inside = np.zeros(len(buf) + 2, np.bool_)
    inside[1:-1] = low != 0
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    before[cuts] = False
    after[cuts - 1] = False
    own = inside[1:-1]
    starts = np.flatnonzero(own & ~before)
    ends = np.flatnonzero(own & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_TABLE[low] * up[: len(low)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])
