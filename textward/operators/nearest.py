"""Nearest vectors by cosine: a block join of queries and rows, exact over all rows or within the cells of an inverted file.

Queries are dealt to blocks of about `block` and rows to blocks of about `row_block`, by Spark's shuffle; how many there are is a scalar
subquery, so nothing is counted or gathered on the driver. A task holds one block of queries, lets the rows of a block stream past, and keeps the best
for each query (or for each query and class); those of all blocks are merged by one window. Blocks are dealt by place and not by value, so
vectors or ids that repeat don't meet in one task.

Defined results: similarity is 0 for null or empty vectors, vectors with null or non-finite entries, zero norms and unequal lengths; ties go to the smaller
row id; query ids are taken as distinct; rows that repeat are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, ROW_BLOCK = 2048, 262_144
#: Similarities that are computed at a time.
STEP = 1 << 20
#: Rows that the cells' centres are fitted on, at most, and rounds of it.
SAMPLE, ROUNDS = 20_000, 12


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length of the vectors that have a direction."""
    offs = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    size = np.diff(offs)
    good = (size > 0) & (bad[offs[1:]] == bad[offs[:-1]]) & np.asarray(column.is_valid())
    out = []
    for n in np.unique(size[good]).tolist():
        at = np.flatnonzero(good & (size == n))
        rows = flat[offs[at][:, None] + np.arange(n)]
        norm = np.linalg.norm(rows, axis=1)
        out.append((at[norm > 0], rows[norm > 0] / norm[norm > 0, None]))
    return out


def similarities(queries: list[tuple[np.ndarray, np.ndarray]], n: int, column: pa.Array) -> np.ndarray:
    """n queries by the column's rows, rounded to nine digits."""
    out = np.zeros((n, len(column)))
    for at, rows in unit_rows(column):
        for own, vectors in queries:
            if vectors.shape[1] == rows.shape[1]:
                out[own[:, None], at] = (vectors @ rows.T).round(9)
    return out


class Nearest:
    """The k best rows of each query."""

    schema = "query_id bigint, row_id bigint, similarity double"

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.least = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, sims: np.ndarray, rows: pa.RecordBatch) -> None:
        q, at = np.nonzero(sims >= self.least[:, None])
        self.held.append((q, np.asarray(rows.column(0))[at], sims[q, at]))
        self.size += len(q)
        if self.size > max(STEP, 8 * self.k * len(self.ids)):
            self.sort()

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, row, sim = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((row, -sim, q))
        q, row, sim = q[order], row[order], sim[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        q, row, sim, place = q[best], row[best], sim[best], place[best]
        self.least[q[place == self.k - 1]] = sim[place == self.k - 1]
        self.held, self.size = [(q, row, sim)], 0
        return self.held[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            q, row, sim = self.sort()
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(row), pa.array(sim)], names=["query_id", "row_id", "similarity"])


class ByClass:
    """The best similarity of each query to each class."""

    schema = "query_id bigint, class string, similarity double"

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.best = ids, {}

    def add(self, sims: np.ndarray, rows: pa.RecordBatch) -> None:
        coded = rows.column(2).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            own = sims[:, codes == i].max(axis=1)
            self.best[name] = np.maximum(self.best[name], own) if name in self.best else own

    def batches(self) -> Iterator[pa.RecordBatch]:
        for name, sims in self.best.items():
            seen = np.isfinite(sims)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[seen]), pa.array([name] * int(seen.sum()), pa.string()), pa.array(sims[seen])], names=["query_id", "class", "similarity"])


def _numbered(df: DataFrame, blocks: Column) -> Column:
    """A block by the row's place in the input."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), blocks)


def _block_join(queries: DataFrame, rows: DataFrame, kept: type, k: int, block: int, row_block: int, but_self: bool) -> DataFrame:
    """What `kept` keeps of each block of queries (id, vec, cells) against the rows (id, vec, class, cell) of a block in the same cell."""
    blocks = lambda df, size: F.greatest(F.lit(1), F.ceil(df.agg(F.count("*").alias("n")).scalar() / size))
    # Every block of queries meets every block of rows.
    left = queries.withColumn("qb", _numbered(queries, blocks(queries, block))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), blocks(rows, row_block) - 1)))
    right = rows.withColumn("rb", _numbered(rows, blocks(rows, row_block))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), blocks(queries, block) - 1)))
    left = left.select("id", "vec", F.lit(None).cast("string").alias("class"), F.explode("cells").alias("cell"), "qb", "rb", F.lit(0).alias("side"))
    both = left.unionByName(right.select("id", "vec", "class", "cell", "qb", "rb", F.lit(1).alias("side")))
    keys = ("cell", "qb", "rb")
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "side")

    def meet(batches):
        known, parts, queries_, best = None, [], [], None
        for batch in batches:
            places = np.stack([np.asarray(batch.column(i)) for i in (3, 4, 5, 6)])
            cuts = np.flatnonzero(np.any(places[:, 1:] != places[:, :-1], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                group, side = tuple(places[:3, lo]), places[3, lo]
                if group != known:
                    if best is not None:
                        yield from best.batches()
                    known, parts, best = group, [], None
                if side == 0:
                    parts.append(part.select(["id", "vec"]))
                    continue
                if not parts:
                    continue  # rows without a query
                if best is None:
                    own = pa.Table.from_batches(parts).combine_chunks()
                    ids = own.column("id").to_numpy()
                    queries_, best = unit_rows(own.column("vec").combine_chunks()), kept(ids, k)
                step = max(1, STEP // len(best.ids))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    sims = similarities(queries_, len(best.ids), some.column(1))
                    if but_self:
                        sims[best.ids[:, None] == np.asarray(some.column(0))[None, :]] = -np.inf
                    best.add(sims, some)
        if best is not None:
            yield from best.batches()

    return dealt.mapInArrow(meet, kept.schema).filter(F.col("similarity") >= -1.5)


def _sides(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, class_col: str | None) -> tuple[DataFrame, DataFrame]:
    of = lambda df, *more: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *more).filter("id is not null")
    kind = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    return of(queries), of(rows, kind.alias("class"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, row_block: int = ROW_BLOCK, but_self: bool = False) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k rows of largest cosine for every query, exactly. but_self: a query's own id is left out.

    Rows or queries without an id take no part.
    """
    own, others = _sides(queries, rows, id_col, vec_col, None)
    zero = F.lit(0).cast("int")
    return _ranked(_block_join(own.withColumn("cells", F.array(zero)), others.withColumn("cell", zero), Nearest, k, block, row_block, but_self), k)


def best_classes(queries: DataFrame, rows: DataFrame, class_col: str, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, row_block: int = ROW_BLOCK, but_self: bool = False) -> DataFrame:
    """(query_id, primary, similarity, second, second_similarity): the two classes that hold the rows of largest cosine.

    A class counts if it has a cosine over 0; ties go to the class of the smaller name. Without any, primary is null and its similarity 0.
    """
    own, others = _sides(queries, rows, id_col, vec_col, class_col)
    zero = F.lit(0).cast("int")
    found = _block_join(own.withColumn("cells", F.array(zero)), others.filter("class is not null").withColumn("cell", zero), ByClass, 1, block, row_block, but_self)
    best = found.groupBy("query_id", "class").agg(F.max("similarity").alias("similarity")).filter("similarity > 0")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "class"))).filter("r <= 2")
    of = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    best = best.groupBy("query_id").agg(of(1, "class").alias("primary"), of(1, "similarity").alias("s1"), of(2, "class").alias("second"), of(2, "similarity").alias("s2"))
    return own.select(F.col("id").alias("query_id")).join(best, "query_id", "left").select("query_id", "primary", F.coalesce("s1", F.lit(0.0)).alias("similarity"), "second", F.coalesce("s2", F.lit(0.0)).alias("second_similarity"))


def centres(rows: DataFrame, cells: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of about `cells` cells, by spherical k-means over at most `sample` rows (those of the smallest hashes of their ids)."""
    held = rows.select(F.xxhash64(id_col).alias("h"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h").limit(sample).select("v").toArrow()
    found = max(unit_rows(held.column(0).combine_chunks()), key=lambda x: len(x[0]), default=(None, np.ones((1, 1))))[1]
    rng = np.random.default_rng(7)
    own = found[rng.permutation(len(found))[:cells]]
    for _ in range(rounds):
        to = np.argmax(found @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, to, found)
        norm = np.linalg.norm(sums, axis=1)
        own = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], own)
    return own


def _cells(df: DataFrame, middle: np.ndarray, probes: int) -> DataFrame:
    """df with cells: the numbers of the `probes` nearest centres; cell 0 for vectors without a direction or of another length."""
    shared = df.sparkSession.sparkContext.broadcast(middle)

    def place(batches):
        own = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, probes), np.int32)
            out[:, 1:] = -1
            for at, rows in unit_rows(batch.column(1)):
                if rows.shape[1] == own.shape[1]:
                    out[at] = np.argsort(-(rows @ own.T), axis=1, kind="stable")[:, :probes]
            lists = [[x for x in r if x >= 0] for r in out.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(place, f"{fields}, cells array<int>")


def nearest_by_cells(queries: DataFrame, rows: DataFrame, k: int = 3, cells: int = 64, probes: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, row_block: int = ROW_BLOCK, but_self: bool = False) -> DataFrame:
    """As nearest, but each query meets only the rows in the `probes` cells of an inverted file whose centres are nearest to it.

    All rows are in the index; what the other cells hold is missed. `recall` says how much that is.
    """
    own, others = _sides(queries, rows, id_col, vec_col, None)
    middle = centres(rows, cells, id_col, vec_col)
    found = _block_join(_cells(own, middle, min(probes, len(middle))), _cells(others, middle, 1).withColumn("cell", F.element_at("cells", 1)), Nearest, k, block, row_block, but_self)
    return _ranked(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs of the exact neighbours, those found, and their share."""
    hit = found.select("query_id", "row_id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "row_id").join(hit, ["query_id", "row_id"], "left")
    return joined.agg(F.count("*").alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("pairs"))
