"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over all training words.

Words are the runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. An item gives one window for every `n`
consecutive words, or one window of all its words if it has fewer. Training windows are looked up by a rolling hash;
each hit is then verified word by word, so that results are exact.

Defined results: null or wordless text has no words and no hits; an item that is null or wordless has no windows; rows
that repeat are each scanned; items that share an item_id count once, and an item without one hits but is not counted; columns of the
input beyond the named ones pass through untouched, whatever their names. The broadcast holds at most `max_windows` windows: a larger
benchmark is scanned in several passes, each written before the next one's broadcast is made, so that one broadcast lives at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARKS = ("hit_words", "hit_items", "word_count")
_BLOOM_BITS = 22


class WindowIndex:
    """Verified look-up of windows: {length: (sorted hashes, {hash: [(text, item ids)]})}."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.texts: dict[int, dict[int, list]] = {}
        for text, items in windows.items():
            n = text.count(b" ") + 1
            self.texts.setdefault(n, {}).setdefault(int(_window_hash(text)), []).append((text, items))
        self.hashes = {n: np.sort(np.fromiter(by, np.uint64, len(by))) for n, by in self.texts.items()}
        self.bloom = {}
        for n, h in self.hashes.items():
            self.bloom[n] = np.zeros(1 << _BLOOM_BITS, bool)
            self.bloom[n][h & np.uint64((1 << _BLOOM_BITS) - 1)] = True

    def hits(self, n: int, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bloom[n][hashes & np.uint64((1 << _BLOOM_BITS) - 1)])
        known = self.hashes[n]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[at] == hashes[maybe]]


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return C.range_hash(C.BYTE_VALUE[low], starts, ends)


def _window_hash(text: bytes) -> np.uint64:
    low = np.frombuffer(text, np.uint8)
    starts, ends, _ = C.spans_of(C.WORD_BYTE[low], np.array([0, len(low)]))
    words = _word_hashes(low, starts, ends)
    return C.range_hash(words, np.array([0]), np.array([len(words)]))[0]


def item_windows(text: str | None, n: int) -> list[bytes]:
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return []
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def scan_texts(column: pa.Array, index: WindowIndex) -> Iterator[tuple[int, int, list, set]]:
    """(row, words, hit word ranges, items) for every row of the column."""
    data, offs = C.text_buffer(column)
    for lo, hi in C.slices(offs):
        own = offs[lo : hi + 1] - offs[lo]
        low = C.LOWER[data[offs[lo] : offs[hi]]]
        starts, ends, rows = C.spans_of(C.WORD_BYTE[low], own)
        counts = np.bincount(rows, minlength=hi - lo)
        found: dict[int, tuple[list, set]] = {}
        words = _word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(counts)])
        for n in index.texts if len(words) else ():
            if len(words) < n:
                continue
            at = np.arange(len(words) - n + 1)
            hashes = C.range_hash(words, at, at + n)
            hit = index.hits(n, hashes)
            for i in hit[rows[hit] == rows[hit + n - 1]]:
                text = b" ".join([low[s:e].tobytes() for s, e in zip(starts[i : i + n], ends[i : i + n])])
                for known, items in index.texts[n][int(hashes[i])]:
                    if known == text:
                        row = int(rows[i])
                        ranges, ids = found.setdefault(row, ([], set()))
                        ranges.append((int(i - first[row]), int(i - first[row]) + n))
                        ids |= items
        for row in range(hi - lo):
            ranges, ids = found.get(row, ((), ()))
            yield lo + row, int(counts[row]), ranges, ids


def _windows(benchmark: DataFrame, n: int, id_col: str, text_col: str, max_windows: int) -> tuple[DataFrame, int]:
    """(window, items, block): the distinct windows with their item ids, dealt by hash to so many blocks of about max_windows."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).to_pylist()):
                own = item_windows(text, n)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item.as_py()] * len(own), pa.string())], names=["window", "item"])

    found = C.written(items.mapInArrow(cut, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items")))
    blocks = max(1, -(-found.count() // max_windows))
    return found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))), blocks


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = 500_000, keep_text: bool = True, prefix: str = "_") -> DataFrame:
    """docs with hit_words (word ranges [start, end), flat), hit_items and word_count; text_col is dropped unless keep_text.

    The three new columns' names start with prefix; input columns of those names are replaced.
    """
    new = [f"{prefix}{x}" for x in MARKS]
    docs = docs.drop(*new)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if keep_text or c != text_col]
    windows, blocks = _windows(benchmark, n, item_id, item_text, max_windows)
    out = docs
    for k in range(blocks):
        block = windows.filter(F.col("block") == k).select("window", "items").toArrow()
        shared = spark.sparkContext.broadcast({w: set(items) for w, items in zip(block.column(0).to_pylist(), block.column(1).to_pylist())})
        first, last = k == 0, k == blocks - 1
        names = kept if last else docs.columns
        fields = out.select(*(F.col(f"`{c}`") for c in names)).schema.fields
        schema = T.StructType([*fields, T.StructField(new[0], T.ArrayType(T.IntegerType())), T.StructField(new[1], T.ArrayType(T.StringType())), T.StructField(new[2], T.LongType())])
        index: list[WindowIndex] = []

        def scan(batches, shared=shared, names=tuple(names), first=first, index=index, at=docs.columns.index(text_col)):
            C.enter("decontaminate")
            if not index:
                index.append(WindowIndex(shared.value))
            for batch in batches:
                ranges, items, counts = [], [], []
                before = None if first else (batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist())
                for row, count, own, ids in scan_texts(batch.column(at), index[0]):
                    flat = [x for pair in own for x in pair]
                    ranges.append(flat if first else before[0][row] + flat)
                    items.append(sorted(ids) if first else sorted({*before[1][row], *ids}))
                    counts.append(count)
                keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
                own = [pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(keep + own, names=[*names, *new])
                C.release()

        before, out = out, out.mapInArrow(scan, schema)
        if not last:
            out = C.written(out)
            shared.unpersist()
            if not first:
                C.forget(before)
    return out


def _covered(ranges: list[int]) -> int:
    total, reach = 0, 0
    for s, e in sorted(zip(ranges[::2], ranges[1::2])):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: words, hit words, items and whether it is contaminated."""
    found = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n, keep_text=False, **options)

    def count(batches):
        for batch in batches:
            ranges, items = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = [_covered(r) for r in ranges]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), batch.column(2)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(count, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>")


def _prefix(columns: list[str]) -> str:
    """A prefix under which the new columns meet no other."""
    prefix = "_"
    while any(C.unused(f"{prefix}{x}", columns) != f"{prefix}{x}" for x in MARKS):
        prefix += "_"
    return prefix


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark window; the columns stay as they are."""
    prefix = _prefix(docs.columns)
    return annotate(docs, benchmark, n, text_col, prefix=prefix, **options).filter(F.size(f"{prefix}{MARKS[0]}") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """docs with the hit words cut out of the text, from the first byte of a hit run to the last; null text stays null."""
    prefix, columns = _prefix(docs.columns), docs.columns
    found = annotate(docs, benchmark, n, text_col, prefix=prefix, **options)

    def cut(batches):
        for batch in batches:
            texts, ranges = batch.column(text_col).to_pylist(), batch.column(f"{prefix}{MARKS[0]}").to_pylist()
            for i, (text, own) in enumerate(zip(texts, ranges)):
                if own:
                    raw = text.encode()
                    at = [m.span() for m in WORD.finditer(raw.lower())]
                    marks = np.zeros(len(at) + 1, np.int8)
                    for s, e in zip(own[::2], own[1::2]):
                        marks[s:e] = 1
                    parts, pos, k = [], 0, 0
                    while k < len(at):
                        if marks[k]:
                            j = k
                            while marks[j]:
                                j += 1
                            parts.append(raw[pos : at[k][0]])
                            pos, k = at[j - 1][1], j
                        else:
                            k += 1
                    texts[i] = b"".join([*parts, raw[pos:]]).decode()
            cols = [pa.array(texts, batch.schema.field(c).type) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return found.mapInArrow(cut, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}

ORACLE = {
    "op1_decontaminate": r"""
with words as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)),
lengths as (select distinct n from item_windows),
windows as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
hits as (select rid, d.n, i, item_id from windows d join item_windows b on d.n = b.n and d.win = b.win),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by rid),
found as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids, list_sort(list(distinct item_id)) as items from hits group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(items, []) as items
from words left join covered using (rid) left join found using (rid)
"""
}
