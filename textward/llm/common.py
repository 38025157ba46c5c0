"""Shared pieces of the training-data operators: table access, lineage cuts and Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is one pass of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words that decontamination and licence scans share: digits, a-z and all non-ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the cluster's shared checkpoint folder. Only a session on one machine may go without, and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for open_ in _scratch:
        open_.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end, but for those in keep."""
    own: list[DataFrame] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.remove(own)
        kept = {x._written_at for x in keep}
        for x in own:
            if x._written_at not in kept:
                forget(x)


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


#: Most keys that are broadcast by hot_join.
MOST_HOT = 200_000


def hot_join(left: DataFrame, sizes: DataFrame, key: str, total: int, how: str = "inner", n: str = "n", least: int = 10_000) -> DataFrame:
    """left joined with sizes, which has one row a key, n being how many of left's `total` rows have it.

    Keys of more than total / MOST_HOT rows (and more than `least`) are broadcast: their rows add up to `total`, so there are at most MOST_HOT
    of them. All others are dealt by key, and none of them is large. So no task gets a third of many rows, however common one key is.
    Where all rows together are no more than the limit there can be no such key.
    """
    limit, own = max(least, -(-total // MOST_HOT)), [c for c in sizes.columns if c != key]
    if total <= limit:
        return left.join(sizes, key, how)
    mark = unused("_hot", [*left.columns, *own])
    hot = sizes.filter(F.col(n) > limit).withColumn(mark, F.lit(True))
    tagged = left.join(F.broadcast(hot), key, "left")
    rest = tagged.filter(F.col(mark).isNull()).select(*left.columns).join(sizes.filter(F.col(n) <= limit), key, how)
    return tagged.filter(F.col(mark)).drop(mark).unionByName(rest)


def forget(df: DataFrame) -> None:
    """Delete the table that written() made; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes each (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


_owner: list[str] = [""]
_caches: dict[str, list[Callable[[], None]]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Say how to drop what an operator keeps in a Python worker from task to task."""
    _caches.setdefault(owner, []).append(clear)


def enter(owner: str) -> None:
    """Start of a task: a worker lives on from stage to stage, so what other operators keep in it goes first."""
    if _owner[0] != owner:
        for name, clears in _caches.items():
            if name != owner:
                for clear in clears:
                    clear()
        _owner[0] = owner
        release(0)


def release(powers_kept: int = SLICE_BYTES + 1) -> None:
    """Give memory that numpy and Arrow have freed back to the system; powers of the rolling hash stay for usual slices."""
    if len(_powers[0]) > powers_kept:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def spans_of(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in mask that don't cross rows: starts, ends and the row of each."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    before[heads] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE, _BASE_INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_VALUE = (np.arange(1, 257, dtype=np.uint64) * MULT) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[i] = p
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, equal for equal ranges; values are unsigned 64-bit."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])
