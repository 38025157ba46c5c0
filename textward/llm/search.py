"""Ranked lexical search by an Aho-Corasick scan of all documents, without an index of them.

The terms of all items make one automaton, each term guarded by a blank on both sides; a document is read as its lower-cased words with a
blank around each, so that a match is a whole word, and neighbours share a blank. The automaton is broadcast. A first scan counts documents,
words and each term's documents; Spark adds the tasks' counts. A second scan takes the terms' counts of each document from its text, maps
them to the items that hold the terms, and keeps the best of its task for each item. Those meet in two steps of a window, first by item and
a salt, then by item, so no task gets all rows of an item.

Items are dealt to blocks of at most `max_terms` terms and `max_items` items (or one larger item), each with its own automaton and scans:
what is broadcast or held at a time is bounded whatever the number of items.

Defined results: null or wordless text has no terms and is never ranked, nor counted in N; rows that repeat are ranked each; items without
terms have no rows; rows of one item_id are one item with the terms of all of them, and so are those without an id; ties go to the smaller
doc_id, null first; other columns are not read.
"""

from __future__ import annotations

import collections
import dataclasses
import functools
import math
import operator
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MAX_TERMS, MAX_ITEMS = 500_000, 20_000
#: Groups by which the best of all tasks meet first, for each item.
SALTS = 64
#: Scores of one step: documents times items.
STEP = 1 << 21
#: Candidates for each item, in `best`s, at which a task sorts out the best.
SLACK = 4


@dataclasses.dataclass
class Block:
    """Some items: their terms, and which items (by number) hold each term."""

    name: str
    items: list
    terms: list[bytes]
    holders: np.ndarray
    first: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    words: int = 0


@functools.lru_cache(2)
def _automaton(name: str):
    import ahocorasick

    own = ahocorasick.Automaton()
    for i, term in enumerate(_terms[name]):
        own.add_word(f" {term.decode('latin-1')} ", i)
    own.make_automaton()
    return own


_terms: dict[str, list[bytes]] = {}


def _drop() -> None:
    _automaton.cache_clear()
    _terms.clear()


C.keeps("search", _drop)


def automaton(block: Block):
    if block.name not in _terms:
        _drop()
        _terms[block.name] = block.terms
    return _automaton(block.name)


def terms_of(text: str | None) -> set[bytes]:
    return set(WORD.findall((text or "").encode().lower()))


def counted(column: pa.Array, block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, words, terms' numbers, their counts) for every row with words."""
    if not block.terms:
        return
    matches, number = automaton(block).iter, operator.itemgetter(1)
    data, offs = C.text_buffer(column)
    for lo, hi in C.slices(offs):
        own = offs[lo : hi + 1] - offs[lo]
        low = C.LOWER[data[offs[lo] : offs[hi]]]
        word = C.WORD_BYTE[low]
        starts, _, rows = C.spans_of(word, own)
        words = np.bincount(rows, minlength=hi - lo)
        # A byte a character: every byte that is no part of a word is a blank.
        text = np.where(word, low, np.uint8(32)).tobytes().decode("latin-1")
        for row in np.flatnonzero(words).tolist():
            found = collections.Counter(map(number, matches(f" {text[own[row] : own[row + 1]]} ")))
            yield lo + row, int(words[row]), np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, terms): an item's distinct terms, sorted."""
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t"))
    kind = rows.schema["item"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = sorted(terms_of(batch.column(1)[i].as_py()))
                if own:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(own), np.int32))), pa.array(own, pa.binary())], names=["item", "term"])

    return rows.mapInArrow(cut, f"item {kind}, term binary").groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _blocks(items: DataFrame, max_terms: int, max_items: int) -> Iterator[Block]:
    """Items in order of their hashes, a block at a time: its rows alone are on the driver."""
    sized = items.select("item", "terms", F.size("terms").cast("long").alias("n"), F.coalesce(F.xxhash64("item"), F.lit(0)).alias("h"))
    whole = sized.agg(F.sum("n"), F.count("*")).first()
    parts = max(-(-(whole[0] or 0) // max_terms), -(-whole[1] // max_items), 1)
    part = F.pmod(F.col("h"), F.lit(parts))
    for k in range(parts):
        held = sized.filter(part == k).select("item", "terms").toArrow()
        if not held.num_rows:
            continue
        number: dict[bytes, int] = {}
        pairs = [(number.setdefault(t, len(number)), i) for i, own in enumerate(held.column("terms").to_pylist()) for t in own]
        pairs.sort()
        terms, holders = np.array(pairs, np.int64).T
        yield Block(uuid.uuid4().hex, held.column("item").to_pylist(), list(number), holders, np.searchsorted(terms, np.arange(len(number) + 1)))


def weigh(docs: DataFrame, block: Block) -> Block:
    """The block with the terms' weights and the corpus' counts. docs: id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        C.enter("search")
        own = shared.value
        df, documents, words = np.zeros(len(own.terms), np.int64), 0, 0
        for batch in batches:
            for _, n, terms, _ in counted(batch.column(0), own):
                documents, words = documents + 1, words + n
                df[terms] += 1
            C.release()
        met = np.flatnonzero(df)
        # Numbers -1 and -2 are the documents and the words.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [-1, -2])), pa.array(np.append(df[met], [documents, words]))], names=["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    by = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))
    documents = by.pop(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * by.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
    return dataclasses.replace(block, weights=weights, documents=documents, words=by.pop(-2, 0))


class Best:
    """The best documents of each item so far, and candidates that reach the worst of them."""

    def __init__(self, items: int, best: int, kind: pa.DataType):
        self.best, self.kind = best, kind
        self.least = np.ones(items, np.int64)
        self.waiting: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: documents by items."""
        at, item = np.nonzero(scores >= self.least)
        if len(at):
            self.waiting.append(pa.table([pa.array(item), pa.array(scores[at, item]), ids.take(pa.array(at))], names=["item", "score", "doc_id"]))
            self.size += len(at)
            if self.size > SLACK * self.best * len(self.least):
                self.sort()

    def sort(self) -> pa.Table:
        rows = pa.concat_tables(self.waiting) if self.waiting else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], self.kind)], names=["item", "score", "doc_id"])
        order = pa.compute.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start")
        item = rows.column("item").to_numpy()[order.to_numpy()]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        rows = rows.take(order.take(pa.array(np.flatnonzero(place < self.best))))
        last = place[place < self.best] == self.best - 1
        self.least[rows.column("item").to_numpy()[last]] = rows.column("score").to_numpy()[last]
        self.waiting, self.size = [rows], 0  # at most `best` an item
        return rows


def _scored(docs: DataFrame, block: Block, best: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for each item."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        C.enter("search")
        own = shared.value
        kept, items = None, len(own.items)
        step = max(1, STEP // max(1, items))
        for batch in batches:
            ids = batch.column(0)
            kept = kept or Best(items, best, ids.type)
            scores, rows = np.zeros((step, items), np.int64), []
            for row, n, terms, tf in counted(batch.column(1), own):
                m = 50 + 50 * n * own.documents // own.words
                part = own.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                sizes = own.first[terms + 1] - own.first[terms]
                ends = np.cumsum(sizes)
                holders = own.holders[np.arange(int(sizes.sum())) + np.repeat(own.first[terms] - ends + sizes, sizes)]
                np.add.at(scores[len(rows)], holders, np.repeat(part, sizes))
                rows.append(row)
                if len(rows) == step:
                    kept.add(scores, ids.take(pa.array(rows)))
                    scores[:], rows = 0, []
            if rows:
                kept.add(scores[: len(rows)], ids.take(pa.array(rows)))
            C.release()
        if kept is not None:
            found = kept.sort()
            yield from found.to_batches()

    return docs.mapInArrow(scan, f"item long, score long, doc_id {kind}")


def rank(docs: DataFrame, items: DataFrame, best: int = 50, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_terms: int = MAX_TERMS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of score above 0 for each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    found = _items(items, item_id, item_text)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    out, kind = None, found.schema["item"]
    for block in _blocks(found, max_terms, max_items):
        rows = _scored(docs, weigh(docs, block), best)
        salted = W.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        rows = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= best)
        rows = rows.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("r") <= best)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item long, name {kind.dataType.simpleString()}")
        rows = rows.join(F.broadcast(names), "item").select(F.col("name").alias(item_id), F.col("r").cast("int").alias("rank"), F.col("doc_id").alias(doc_id), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        id_kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_id}` {kind.dataType.simpleString()}, rank int, `{doc_id}` {id_kind}, score long")
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_search": op13_search}

ORACLE = {
    "op13_search": r"""
with words as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
docs as (select rid, doc_id, cast(len(w) as hugeint) as n from words where len(w) > 0),
corpus as (select count(*) as all_docs, sum(n) as all_words from docs),
terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
tf as (select rid, term, cast(count(*) as hugeint) as tf from (select rid, unnest(w) as term from words) where term in (select term from terms) group by rid, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(all_docs) + 2) / cast(2 * count(*) + 1 as double))) as hugeint) as w from tf, corpus group by term),
scores as (
  select item_id, doc_id, rid, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_words)))) as bigint) as score
  from tf join weights using (term) join terms using (term) join docs using (rid), corpus group by item_id, doc_id, rid)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first, rid) as rank from scores where score > 0)
where rank <= 50
"""
}
