"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes.

Entries become integers x = floor(64 c) + 1000000. The fit list has each distinct x vector once. Its covariance V is never formed: a pass
multiplies it with a block Q of some columns, every task adding up its rows' share of XᵀXQ with X centred first, and Spark adds the shares.
A round filters the block by a Chebyshev polynomial of V that is small on [0, b] and grows fast above it, b being the smallest Ritz value
of the block (never above the true eigenvalue of that rank); then QR and Rayleigh-Ritz. Rounds go on until the wanted residuals |Vz - ez|
are all below `tolerance` times the largest eigenvalue. Where the spectrum is so flat that this would take more than `MOST_PASSES` passes, the
block is doubled; a block as wide as the vectors is exact at once. Only dimension x block numbers ever reach the driver.

Defined results: rows whose vector is null, or holds null or entries that are not finite, are dropped, as are those whose length is not
that of most distinct vectors (of equally many the larger; an empty vector is never it); repeated rows count once in the fit and get their
rows each; an id that is null stays null. x - 1000000 beyond ±2**62 counts as that. Components without variance (fewer dimensions or fewer
different vectors than asked for) have no rows; an empty table has none at all. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, MOST = 64, 1 << 62
#: Sums of squares travel as their low 60 bits and the rest, so that neither outgrows a decimal.
LOW = (1 << 60) - 1
COMPONENTS, GUARD = 16, 32
#: Residual over the largest eigenvalue below which a component is certified.
TOLERANCE = 2e-13
#: Passes left at which the block is widened, passes of one round at most, and by how much a round may favour the first component over the last.
MOST_PASSES, MOST_DEGREE, MOST_GROWTH = 64, 12, 1e7
#: Numbers of one step inside a pass.
STEP = 1 << 20


@dataclasses.dataclass
class Whitening:
    """A fitted model: distinct vectors, exact sums of x - 1000000, components as columns, and how well it was reached."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        """Means of x - 1000000."""
        return np.array([s / self.n for s in self.sums])


def _rows_by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as doubles) for each length of the vectors that are neither null nor empty and hold finite entries alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    size = np.diff(offs)
    good = (size > 0) & (bad[offs[1:]] == bad[offs[:-1]]) & np.asarray(column.is_valid())
    out = []
    for length in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == length))
        out.append((rows, flat[offs[rows][:, None] + np.arange(length)]))
    return out


def _quantised(entries: np.ndarray) -> np.ndarray:
    """x - 1000000."""
    return np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64)


def _packed(y: np.ndarray) -> pa.Array:
    """A binary value a row: a width of 4 or 8, then the entries in so many bytes each."""
    raw = np.ascontiguousarray(y).view(np.uint8).reshape(len(y), -1)
    rows = np.concatenate([np.full((len(y), 1), y.itemsize, np.uint8), raw], axis=1)
    offsets = np.arange(len(y) + 1, dtype=np.int64) * rows.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(y), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _unpacked(column: pa.Array, dim: int):
    """Entries of the packed vectors, at most about STEP at a time."""
    data, offs = C.text_buffer(column)
    for width, kind in ((4, np.int32), (8, np.int64)):
        at = offs[:-1][np.diff(offs) == 1 + width * dim]
        for lo in range(0, len(at), max(1, STEP // dim)):
            part = at[lo : lo + max(1, STEP // dim)]
            yield np.ascontiguousarray(data[part[:, None] + 1 + np.arange(width * dim)]).view(kind).astype(np.int64)


def _distinct(rows: DataFrame, vec_col: str) -> DataFrame:
    """(vec, dim): every distinct x vector once."""

    def encode(batches):
        for batch in batches:
            for _, entries in _rows_by_length(batch.column(0)):
                y = _quantised(entries)
                small = (np.abs(y) < 1 << 31).all(axis=1)
                for part in (y[small].astype(np.int32), y[~small]):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([_packed(part), pa.array(np.full(len(part), y.shape[1], np.int32))], names=["vec", "dim"])

    return rows.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(encode, "vec binary, dim int").distinct()


def _summed(fit: DataFrame, work: Callable, kind: str = "double") -> dict[int, float | int]:
    """work(packed vectors, an Arrow batch column at a time) gives one array of shares a task; the sums of the shares by their places."""

    def run(batches):
        C.enter("whitening")
        total = None
        for batch in batches:
            own = work(batch.column(0))
            total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            values = pa.array([Decimal(int(x)) for x in flat], pa.decimal128(38, 0)) if kind != "double" else pa.array(flat, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), values], names=["cell", "v"])

    found = fit.select("vec").mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    return dict(zip(found.column("cell").to_pylist(), found.column("v").to_pylist()))


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = 42) -> Whitening:
    """The first components of the distinct vectors' covariance."""
    with C.scratch([]):
        return _fit(C.written(_distinct(rows, vec_col)), components, guard, tolerance, seed)


def _fit(table: DataFrame, components: int, guard: int, tolerance: float, seed: int) -> Whitening:
    found = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not found:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0, 0)
    dim, n = found[0]["dim"], found[0]["count"]
    table = table.filter(F.col("dim") == dim)

    def moments(column):
        total = np.zeros((3, dim), object)
        for y in _unpacked(column, dim):
            y = y.astype(object) if np.abs(y).max() >= 1 << 20 else y
            square = (y * y).sum(axis=0).astype(object)
            total = total + np.stack([y.sum(axis=0).astype(object), square & LOW, square >> 60])
        return total

    exact = _summed(table, moments, "decimal(38,0)")
    sums = [int(exact[i]) for i in range(dim)]
    squares = [int(exact[dim + i]) + (int(exact[2 * dim + i]) << 60) for i in range(dim)]
    trace = float(sum(n * q - s * s for s, q in zip(sums, squares))) / n / n
    mean = np.array([s / n for s in sums])
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        """V block."""
        nonlocal passes
        passes += 1

        def share(column):
            total = np.zeros(block.shape)
            for y in _unpacked(column, dim):
                x = y - mean
                total += x.T @ (x @ block)
            return total

        own = _summed(table, share)
        return np.array([own[i] for i in range(block.size)]).reshape(block.shape) / n

    if trace <= 0:
        return Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0, passes)
    random, width, wanted = np.random.default_rng(seed), min(dim, components + guard), min(dim, components)
    q = np.linalg.qr(random.standard_normal((dim, width)))[0]
    y, rounds = times(q), 0
    while True:
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residuals = np.linalg.norm(y - q * values, axis=0)[:wanted] / values[0]
        if width == dim or residuals.max() <= tolerance:
            break
        least = max(values[-1], 1e-14 * values[0])
        rate = math.acosh(max(2 * values[wanted - 1] / least - 1, 1 + 1e-9))
        if rounds > 1 and math.log(residuals.max() / tolerance) / rate > MOST_PASSES:
            more = random.standard_normal((dim, min(width, dim - width)))
            more = np.linalg.qr(np.concatenate([q, more], axis=1))[0][:, width:]
            q, y = np.concatenate([q, more], axis=1), np.concatenate([y, times(more)], axis=1)
            width = q.shape[1]
            continue
        growth = math.acosh(max(2 * values[0] / least - 1, 1 + 1e-9))
        q = np.linalg.qr(_filtered(q, y, times, least, values[0], min(MOST_DEGREE, max(2, int(math.acosh(MOST_GROWTH) / growth)))))[0]
        y, rounds = times(q), rounds + 1
    keep = min(wanted, int((values > 8 * dim * np.finfo(float).eps * values[0]).sum()))
    vectors, values = q[:, :keep], values[:keep]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
    project = vectors / np.sqrt(values)

    def second(column):
        """Sums of the whitened entries and of their products."""
        total = np.zeros((keep + 1, keep))
        for y_ in _unpacked(column, dim):
            w = (y_ - mean) @ project
            total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
        return total

    own = _summed(table, second)
    cells = np.array([own[i] for i in range((keep + 1) * keep)]).reshape(keep + 1, keep) / n
    covariance = cells[:keep] - np.outer(cells[keep], cells[keep])
    return Whitening(n, sums, vectors, values, trace, residuals[:keep], float(np.abs(covariance - np.eye(keep)).max()), passes + 1)


def _filtered(x: np.ndarray, vx: np.ndarray, times: Callable, b: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of this degree of V over [0, b], scaled to 1 at top, applied to x; vx is V x."""
    half = b / 2
    first = s = half / (top - half)
    before, now = x, (vx - half * x) * (s / half)
    for _ in range(degree - 1):
        t = 1 / (2 / first - s)
        before, now = now, (times(now) - half * now) * (2 * t / half) - (s * t) * before
        s = t
    return now


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)², exactly."""
    if n * int(np.abs(y).max(initial=0)) + max(map(abs, sums)) < math.isqrt((1 << 63) // max(1, y.shape[1])):
        own = n * y - np.array(sums, np.int64)
        return (own * own).sum(axis=1).tolist()
    exact = (((y.astype(object) * n) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(x) if x < 1 << 63 else None for x in exact]


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): a row for each row that remains; whitened has one double a component."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        C.enter("whitening")
        own = shared.value
        if not own.n:
            return
        mean, project, dim = own.mean, own.vectors / np.sqrt(own.values), len(own.sums)
        for batch in batches:
            for rows_, entries in _rows_by_length(batch.column(1)):
                if entries.shape[1] != dim:
                    continue
                for lo in range(0, len(rows_), max(1, STEP // dim)):
                    part = slice(lo, lo + max(1, STEP // dim))
                    y = _quantised(entries[part])
                    w = (y - mean) @ project
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_[part])), pa.array(_deviations(y, own.n, own.sums), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")


def report(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each remaining row and component."""
    explained = F.array(*(F.lit(float(x / model.trace)) for x in model.values))
    found = whiten(rows, model, id_col, vec_col).select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", (F.get(explained, F.col("at")) if len(model.values) else F.lit(None).cast("double")).alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return report(rows, fit(rows))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE: dict[str, str] = {}
