"""Exact repeats between and within documents: maximal repeat groups from enhanced suffix arrays over sampled suffixes.

A string of `length` bytes that stands in two places is found through an anchor: of its KGRAM-byte grams the one with the smallest
hash, which both places share at the same offset. So only anchors (about two in seventy bytes) meet each other, by hash:

1. Each document gives its anchors with a hash of the whole context that any string through the anchor can reach. Of equal contexts in one
   slice of texts only the first goes on; the others are repeats throughout and meet no one. So a class of copies, however large, sends few rows.
2. Anchors of one gram meet. Places with the same context are one class: all but the first are repeats throughout. Only the
   first place of each class, in grams of several classes, asks for its bytes.
3. The right contexts of a gram, sorted, are a sparse suffix array; a stack scan over common-prefix lengths gives its interval tree. In each
   interval the left contexts are sorted and scanned alike: an interval there is a repeat that can't be extended to the right (or
   a deeper interval has it) nor to the left (its members differ before it): a maximal repeat group, with all its occurrences.
4. In each group all but the first occurrence are covered. For that the same trees are scanned once more plainly: in each interval the
   later of two firsts drops out where they meet, so a place gives one stretch, however many groups it is in. A document's stretches are merged and cut out.

Grams of more than `HOT` different contexts don't meet in one task for 4: they are dealt into parts of about `HOT`, each scanned as a gram of its own. Of
each part the first places of its strings of `length` bytes then meet by the strings' hashes, and all but the first of a string are covered.
That is exact too: a place with an earlier one has it in its part, or is the first there and has it in another. A string has one row a part.

Texts are shuffled once, hot grams or not: the bytes of all places asked for come from one join, which shares its exchange of texts with the last one.

No step pairs occurrences, and nothing but 1 and 3 leaves the JVM. Earlier: smaller id, then smaller start; rows without an id come last.

Defined results: null counts as empty text; texts under `length` bytes have no repeats; rows that share id and text are one document
given twice, with equal results; rows that share an id but not the text are told apart, ordered by a hash of it; an id that is no whole number is an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH = 100
KGRAM = 32
#: Contexts of a gram that one task may hold.
HOT = 20_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of values[i : i + width], by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = KGRAM):
    """(row, place, gram hash, context hash, left reach, right reach) of the anchors of the rows."""
    z = np.zeros(0, np.int64)
    width = length - k + 1
    if len(data) < length:
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z, z
    values = C.BYTE_VALUE[data]
    up, down = C.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=sums[1:])
    n = len(data) - k + 1
    grams = C.mixed((sums[k:] - sums[:n]) * down[:n])
    inside = np.zeros(len(data), bool)  # starts of strings that end within their row
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if hi - lo >= length:
            inside[lo : hi - length + 1] = True
    least = _sliding(grams, width, np.minimum)  # for every string of `length` bytes
    least = np.where(inside[: len(least)], least, np.uint64(0))
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, width, np.maximum)[:n] == grams)
    row = np.searchsorted(offs, at, side="right") - 1
    left, right = np.minimum(at - offs[row], width - 1), np.minimum(offs[row + 1] - at, length)
    context = C.mixed((sums[at + right] - sums[at - left]) * down[at - left] + (left * 256 + right).astype(np.uint64))
    keep = left + right >= length
    return row[keep], (at - offs[row])[keep], grams[at][keep], context[keep], left[keep], right[keep]


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Interval tree of a sorted list, by stack scan: (common length, first, last) of every interval; lcp[i] lies between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        value, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > value:
            known, first = stack.pop()
            yield known, first, i - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _common(a: int, b: int, size: int) -> int:
    return size - (((a ^ b).bit_length() + 7) >> 3)


def maximal(rights: list[int], lefts: list[bytes], length: int, k: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through one gram: (bytes left of the anchor, bytes from it on, members).

    rights: common prefix of each right context with the one before it in sorted order (cut at the contexts' ends); lefts: the left
    contexts, read backwards.
    """
    reach = length - k
    keys = [int.from_bytes(x.ljust(reach, b"\0"), "big") for x in lefts]
    for right, lo, hi in intervals(rights, k):
        members = sorted(range(lo, hi + 1), key=lambda i: (keys[i], len(lefts[i])))
        lcp = [0] + [min(_common(keys[a], keys[b], reach), len(lefts[a]), len(lefts[b])) for a, b in zip(members, members[1:])]
        for left, first, last in intervals(lcp, max(0, length - right)):
            own = members[first : last + 1]
            if min(rights[min(own) + 1 : max(own) + 1]) == right:  # else a deeper interval holds it
                yield left, right, own


def beaten(ranks: list, lcp: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(position, length) of each place in a sorted list that shares at least `least` bytes with one of lower rank, and the most that it shares.

    A stack scan that merges neighbouring intervals from the deepest up: the later of two firsts drops out at the length at which they meet.
    """
    firsts, borders = [0], []
    for i in range(1, len(ranks) + 1):
        value = lcp[i] if i < len(ranks) else -1
        while borders and borders[-1] >= value:
            met, b, a = borders.pop(), firsts.pop(), firsts.pop()
            if met >= least:
                if ranks[b] < ranks[a]:
                    a, b = b, a
                yield b, met
            firsts.append(a)
        if i < len(ranks):
            borders.append(value)
            firsts.append(i)


def covered(rights: list[int], lefts: list[bytes], ranks: list, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(member, left, right) of the members with an earlier one that shares `length` bytes through the anchor: how far such strings reach.

    All of them hold the anchor, so what they cover is one stretch.
    """
    reach, best = length - k, {}
    keys = [int.from_bytes(x.ljust(reach, b"\0"), "big") for x in lefts]
    for right, lo, hi in intervals(rights, k):
        members = sorted(range(lo, hi + 1), key=keys.__getitem__) if hi - lo > 1 or keys[hi] < keys[lo] else [lo, hi]
        lcp = [0] + [min(_common(keys[a], keys[b], reach), len(lefts[a]), len(lefts[b])) for a, b in zip(members, members[1:])]
        for at, left in beaten([ranks[i] for i in members], lcp, max(0, length - right)):
            known = best.get(members[at], (0, 0))
            best[members[at]] = max(left, known[0]), max(right, known[1])
    for member, (left, right) in best.items():
        yield member, left, right


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return heads, np.diff(np.append(heads, len(values)))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut so that no value of it goes on in the next one."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0)
        if kept and kept[0].column(0)[0] == first[batch.num_rows - 1]:
            kept.append(batch)
            continue
        values = first.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if kept or cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(order, [text hash,] text) and the names of the key columns; the hash only where ids repeat."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number: it gives the order of documents")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    docs = docs.select(order.alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if docs.groupBy("order").count().filter("count > 1").isEmpty():
        return docs, ["order"]
    return docs.select("order", F.xxhash64("text").alias("kind"), "text"), ["order", "kind"]


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row is the least of those that share its first column, by the other columns in order."""
    order = np.lexsort(columns[::-1])
    of = columns[0][order]
    first = np.zeros(len(of), bool)
    first[order[np.concatenate([[True], of[1:] != of[:-1]])]] = True
    return first


def _written(df: DataFrame) -> DataFrame:
    """C.written(df); the shuffle files of the write go at its end, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return C.written(df)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def _met(docs: DataFrame, keys: list[str], length: int, k: int, hot: int = HOT, classes: bool = False) -> DataFrame:
    """Rows of step 2: gram, keys, place, left, right, `whole`: covered throughout, or asking for its bytes, and `parts`: how many of `hot` classes its gram takes.

    With classes, context is there too, and so are the first places of grams of one class.
    """
    names = [f"`{x}` bigint" for x in keys]

    def give(batches):
        C.enter("repeats")
        for batch in batches:
            data, offs = C.text_buffer(batch.column(len(keys)))
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: len(keys)]]
            for lo, hi in C.slices(offs):
                row, at, gram, context, left, right = anchors(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], length, k)
                if not len(row):
                    continue
                mine = [c[lo:hi][row] for c in own]
                whole = ~_firsts([context, *mine, at])
                spread = C.mixed(mine[0].astype(np.uint64) * C.MULT + at.astype(np.uint64))  # they meet no one, so they go anywhere
                gram = np.where(whole, spread, gram)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *map(pa.array, mine), pa.array((at << 16) | (left << 8) | right), pa.array(whole)], names=["gram", "context", *keys, "at", "whole"])

    given = docs.mapInArrow(give, f"gram bigint, context bigint, {', '.join(names)}, at bigint, whole boolean")
    given = given.repartition("gram").sortWithinPartitions("gram", "context", *keys, "at")
    columns = ["gram", *["context"] * classes, *keys, "place", "left", "right", "whole", "parts"]

    def meet(batches):
        for batch in _whole_groups(batches):
            gram, context = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            done = batch.column(len(keys) + 3).to_numpy(zero_copy_only=False)
            met = np.flatnonzero(~done)
            whole, take, parts = done.copy(), done.copy(), np.ones(len(done), np.int64)
            if len(met):
                g, c = gram[met], context[met]
                heads, sizes = _runs(g)
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
                kinds = np.repeat(np.add.reduceat(new.astype(np.int64), heads), sizes)
                whole[met], take[met], parts[met] = ~new, ~new | (kinds > 1) | classes, np.where(new, -(-kinds // hot), 1)
            at_all = np.flatnonzero(take)
            out = batch.take(pa.array(at_all))
            at = out.column(len(keys) + 2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([out.column(0), *[out.column(1)] * classes, *out.columns[2 : 2 + len(keys)], pa.array(at >> 16), pa.array((at >> 8) & 255), pa.array(at & 255), pa.array(whole[at_all]), pa.array(parts[at_all])], names=columns)

    return given.mapInArrow(meet, f"gram bigint, {'context bigint, ' * classes}{', '.join(names)}, place bigint, left bigint, right bigint, whole boolean, parts bigint")


def _contexts(docs: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of the places asked for: gram, right and left context (left read backwards), keys, place, parts."""
    wanted = asked.groupBy(*keys).agg(F.collect_list(F.struct("gram", "place", "left", "right", "parts")).alias("wanted"))  # bounded by the text
    names = ", ".join(f"`{x}` bigint" for x in keys)

    def cut(batches):
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns[: len(keys)]]
            data, offs = C.text_buffer(batch.column(len(keys)))
            raw = data.tobytes()
            rows: list[tuple] = []
            for i, wants in enumerate(batch.column(len(keys) + 1).to_pylist()):
                key = [c[i] for c in own]
                for w in wants:
                    at = int(offs[i]) + w["place"]
                    rows.append((w["gram"], raw[at : at + w["right"]], raw[at - w["left"] : at][::-1], *key, w["place"], w["parts"]))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * (len(keys) + 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["gram", "right", "left", *keys, "place", "parts"])

    return docs.join(wanted, keys).select(*keys, "text", "wanted").mapInArrow(cut, f"gram bigint, `right` binary, `left` binary, {names}, place bigint, parts bigint")


def _groups(dealt: DataFrame, keys: list[str], length: int, k: int, covers: bool) -> DataFrame:
    """Step 3: maximal repeat groups as rows (repeat, size, keys, start, anchor), or with covers the bytes covered (keys, start, end).

    dealt: contexts, those of a gram in one partition.
    """
    names = ", ".join(f"`{x}` bigint" for x in keys)
    ordered = dealt.sortWithinPartitions("gram", "right")

    def solve(batches):
        for batch in _whole_groups(batches):
            n = batch.num_rows
            gram = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = C.text_buffer(batch.column(1))
            sizes = np.diff(offs)
            table = np.zeros((n, length), np.uint8)
            table[np.repeat(np.arange(n), sizes), np.arange(len(data)) - np.repeat(offs[:-1], sizes)] = data
            lcp = np.zeros(n, np.int64)
            if n > 1:
                differ = table[1:] != table[:-1]
                lcp[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), length), np.minimum(sizes[1:], sizes[:-1]))
            lefts = batch.column(2).to_pylist()
            places = list(zip(*(c.to_pylist() for c in batch.columns[3 : len(keys) + 4])))
            rows: list[tuple] = []
            heads, counts = _runs(gram)
            for lo, m in zip(heads.tolist(), counts.tolist()):
                if m < 2:
                    continue
                rights = lcp[lo : lo + m].tolist()
                rights[0] = 0
                if covers:
                    for i, left, right in covered(rights, lefts[lo : lo + m], places[lo : lo + m], length, k):
                        *key, place = places[lo + i]
                        rows.append((*key, place - left, place + right))
                    continue
                for left, right, own in maximal(rights, lefts[lo : lo + m], length, k):
                    found = sorted(places[lo + i] for i in own)
                    name = ":".join(map(str, (*found[0][:-1], found[0][-1] - left, left + right)))
                    rows += [(name, left + right, *x[:-1], x[-1] - left, x[-1]) for x in found]
            if rows:
                kinds = [pa.int64()] * (len(keys) + 2) if covers else [pa.string(), pa.int64(), *[pa.int64()] * (len(keys) + 2)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*keys, "start", "end"] if covers else ["repeat", "size", *keys, "start", "anchor"])

    return ordered.mapInArrow(solve, f"{names}, start bigint, `end` bigint" if covers else f"repeat string, size bigint, {names}, start bigint, anchor bigint")


def _strings(dealt: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Step 4 between the parts of hot grams: (keys, start, end) of the first places of a part with an earlier one in another part."""
    names = ", ".join(f"`{x}` bigint" for x in keys)

    def firsts(batches):
        for batch in _whole_groups(b.filter(pc.greater(b.column(len(keys) + 4), 1)) for b in batches):
            for lo, n in zip(*(x.tolist() for x in _runs(batch.column(0).to_numpy(zero_copy_only=False)))):
                part = batch.slice(lo, n)
                digests, counts = bytearray(), []
                for right, left in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = left[::-1] + right
                    counts.append(len(raw) - length + 1)
                    # Seeded by the anchor's place in the string: one that holds its anchor twice is two strings, as it is in the trees.
                    digests += b"".join(xxhash.xxh3_128_digest(raw[i : i + length], len(left) - i) for i in range(counts[-1]))
                row = np.repeat(np.arange(n), counts)
                *own, place = (c.to_numpy(zero_copy_only=False)[row] for c in part.columns[3 : len(keys) + 4])
                left = np.array([len(x) for x in part.column(2).to_pylist()])
                start = place - left[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                high, low = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
                order = np.lexsort([start, *own[::-1], low, high])
                high, low = high[order], low[order]
                at = order[np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])]
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(row), [None, pa.py_buffer(digests)]).take(pa.array(at)).cast(pa.binary())
                yield from pa.Table.from_arrays([strings, *(pa.array(c[at]) for c in (*own, place, start))], names=["string", *keys, "place", "start"]).to_batches(20_000)

    rows = dealt.sortWithinPartitions("gram").mapInArrow(firsts, f"string binary, {names}, place bigint, start bigint")
    later = rows.withColumn("rank", F.rank().over(Window.partitionBy("string").orderBy(*keys, "start"))).filter("rank > 1")
    return later.groupBy(*keys, "place").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("place")


def _covers(keyed: DataFrame, met: DataFrame, keys: list[str], length: int, k: int) -> DataFrame:
    """(keys, start, end) of all that is covered."""
    whole = met.filter("whole").select(*keys, (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))
    part = F.xxhash64("gram", F.pmod(F.xxhash64(*keys, "place"), "parts"))
    contexts = _contexts(keyed, met.filter("not whole"), keys)
    dealt = contexts.withColumn("gram", F.when(F.col("parts") > 1, part).otherwise(F.col("gram"))).repartition("gram")
    covered = whole.unionByName(_groups(dealt, keys, length, k, covers=True))
    return covered if met.filter("parts > 1").isEmpty() else covered.unionByName(_strings(dealt, keys, length))


def repeat_groups(docs: DataFrame, length: int = LENGTH, k: int = KGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of at least `length` bytes: repeat (its first place and bytes), size, id, start - a row for every occurrence, copies too.

    Contexts reach `length` bytes from an anchor, so a longer repeat comes as overlapping pieces, each with all its occurrences.
    """
    keyed, keys = _keyed(docs, id_col, text_col)
    met = _written(_met(keyed, keys, length, k, classes=True))
    heads, copies = met.filter("not whole"), met.filter("whole")
    found = _groups(_contexts(keyed, heads, keys).repartition("gram"), keys, length, k, covers=False)
    # A place of a group stands for its whole class: all its copies have the same bytes around the anchor.
    sizes = copies.groupBy("context").agg(F.count("*").alias("n"))
    members = C.hot_join(copies.select("context", *keys, "place"), sizes.join(heads.select("context", *(F.col(x).alias(f"of_{x}") for x in keys), F.col("place").alias("of_place"), "left", "right"), "context"), "context", copies.count())
    of = [f"of_{x}" for x in keys]
    more = found.join(members.select(*(F.col(x).alias(f"to_{x}") for x in keys), F.col("place").alias("to_place"), *of, "of_place"), [found[x] == F.col(f"of_{x}") for x in keys] + [found["anchor"] == F.col("of_place")])
    more = more.select("repeat", "size", *(F.col(f"to_{x}").alias(x) for x in keys), (F.col("to_place") - F.col("anchor") + F.col("start")).alias("start"))
    # What a class shares beyond any group: its whole context.
    name = F.concat_ws(":", *of, F.col("of_place") - F.col("left"), F.col("left") + F.col("right"))
    own = members.select(name.alias("repeat"), (F.col("left") + F.col("right")).alias("size"), *keys, (F.col("place") - F.col("left")).alias("start"))
    first = members.select(name.alias("repeat"), (F.col("left") + F.col("right")).alias("size"), *(F.col(x).alias(y) for x, y in zip(of, keys)), (F.col("of_place") - F.col("left")).alias("start"))
    every = found.drop("anchor").unionByName(more).unionByName(own).unionByName(first)
    return every.select("repeat", "size", F.expr(f"nullif(`order`, {(1 << 63) - 1})").alias(id_col), "start").distinct()


def removed(docs: DataFrame, length: int = LENGTH, k: int = KGRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """A row a document: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end); with_text adds the kept bytes.

    Bytes covered by a string of `length` bytes that also starts earlier are removed.
    """
    keyed, keys = _keyed(docs, id_col, text_col)
    met = _written(_met(keyed, keys, length, k, hot))
    spans = _covers(keyed, met, keys, length, k).groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the text
    joined = keyed.join(spans, keys, "left").select("order", "text", "spans")

    def cut(batches):
        for batch in batches:
            data, offs = C.text_buffer(batch.column(1))
            rows = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                kept = b"".join(raw[s:e] for s, e in zip([0, *(x[1] for x in merged)], [*(x[0] for x in merged), len(raw)]))
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in merged], kept if with_text else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 5 + with_text]], names=["order", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text)

    out = joined.mapInArrow(cut, "`order` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept binary" * with_text)
    return out.select(F.expr(f"nullif(`order`, {(1 << 63) - 1})").alias(id_col), *out.columns[1:])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(C.table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op7_repeats": op7_repeats}
ORACLE: dict[str, str] = {}
