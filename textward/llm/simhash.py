"""Near-duplicate groups by SimHash, compared in bit-sliced form.

Fingerprints: words are runs of characters other than ASCII white space, A-Z lower-cased; shingles are k words with one space
between (all words if there are fewer), repeats included; each shingle's XXH64 (seed 42) votes on every bit, and a bit is set by
more than half of the votes. The votes are counted with carry-save adders over 31 hashes at once. Fingerprints wider than 64
bits extend each hash by multiplication and shift.

Links: equal fingerprints are one node. Nodes meet where they share a key. For a small radius the keys are pairs of blocks of
the fingerprint (with radius + 2 blocks any two linked fingerprints agree in two of them, so no link is lost); for similarity
groups they are bands of shingle minima. Within a key, the fingerprints stand as vertical bit planes, 64 to a machine word; a query's
differing bits are added to vertical carry-save counters, and a block of 64 is dropped as soon as all its counters are past the
radius. A key with many nodes is split into tiles of bounded size, any two nodes meeting in one of them. A tile gives a spanning forest of its links,
never its pairs. No join deals a common key, hub or fingerprint to one task: the few large ones are broadcast, the others are small.
Components are joined by alternating large-star and small-star steps, each written to the shared folder.

Similarity groups: rows of the same shingle set are one node, and the fingerprints (of the sets, without repeats) only choose candidates, with a
radius that pairs at the similarity keep to by six standard deviations. What hangs together by candidate links meets again, in tiles
of bounded size, with whole shingle sets, and only pairs whose sets are similar enough are linked. A forest of candidate links alone
would not do: two similar nodes may hang together in it only by a third one that is like neither.

Defined results: null or wordless text has the zero fingerprint and is linked like any other; rows that repeat a document are
copies of each other; rows without a document id take part in nothing (component null, and they stay when copies are removed);
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEED = 42
#: Nodes of a key in one tile, on average.
TILE = 4096
#: Shingle minima of a similarity group: bands, and minima in each.
BANDS, IN_BAND = 16, 5
#: Nodes and shingles of a group of candidates in half a tile, on average.
SET_TILE, SET_SHINGLES = 512, 500_000
#: Standard deviations between the candidates' radius and the expected distance.
SPREAD = 6
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the rows, and the row of each."""
    starts, ends, rows = C.spans_of(~_SPACE[data], offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    new_end = np.cumsum(lengths + 1) - 1
    new_start = new_end - lengths
    plain = np.full(new_end[-1] + 1, 32, np.uint8)
    inside = np.ones(len(plain), bool)
    inside[new_end] = False
    plain[inside] = C.LOWER[data[~_SPACE[data]]]
    words = np.bincount(rows, minlength=len(offs) - 1)
    left = np.repeat(np.cumsum(words), words) - np.arange(len(rows))  # words from here to the row's end
    first = left == np.repeat(words, words)
    at = np.flatnonzero((left >= k) | first)
    last = np.minimum(at + k, at + left[at]) - 1
    raw, digest = plain.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[s:e], SEED) for s, e in zip(new_start[at].tolist(), new_end[last].tolist())), np.uint64, len(at)), rows[at]


def _nth(i: int) -> np.uint64:
    return np.uint64(int(C.MULT) * i % (1 << 64))


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of `words` machine words; the first is the hash itself."""
    return np.stack([hashes, *(C.mixed(hashes * np.uint64(2 * i + 1) + _nth(i)) for i in range(1, words))], axis=1)


def _add(a, b, c):
    """Full adder of bit vectors: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def majority(hashes: np.ndarray, rows: np.ndarray, n_rows: int, words: int) -> np.ndarray:
    """Fingerprints [n_rows, words]: the bits set in more than half of a row's hashes. Rows must come in order."""
    counts = np.bincount(rows, minlength=n_rows)
    groups = -(-counts // 31)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(len(rows)) - first[rows] + (np.concatenate([[0], np.cumsum(groups)[:-1]]) * 31)[rows]
    out = np.zeros((n_rows, words), np.uint64)
    have = np.flatnonzero(groups)
    if not len(have):
        return out
    heads = np.concatenate([[0], np.cumsum(groups[have])[:-1]])
    for w, own in enumerate(widened(hashes, words).T):
        votes = np.zeros(int(groups.sum()) * 31, np.uint64)
        votes[at] = own
        lanes, planes = list(np.ascontiguousarray(votes.reshape(-1, 31).T)), []
        while lanes:  # 31 bit vectors to 5 bit planes of their sums
            carries = []
            while len(lanes) > 1:
                total, carry = _add(lanes.pop(), lanes.pop(), lanes.pop())
                lanes.append(total)
                carries.append(carry)
            planes.append(lanes[0])
            lanes = carries
        total = np.zeros((len(have), 64), np.int64)
        for p, plane in enumerate(planes):
            bits = np.unpackbits(plane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += np.add.reduceat(bits, heads, axis=0, dtype=np.int32).astype(np.int64) << p
        out[have, w] = np.packbits(2 * total > counts[have, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes once, sorted. Rows must come in order."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def minima(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[list[int]]:
    """Keys of each row: one for every band of shingle minima; none for rows without shingles."""
    counts = np.bincount(rows, minlength=n_rows)
    have = np.flatnonzero(counts)
    if not len(have):
        return [[] for _ in range(n_rows)]
    heads = (np.cumsum(counts) - counts)[have]
    keys = np.zeros((len(have), BANDS), np.uint64)
    for i in range(BANDS * IN_BAND):
        own = C.mixed(hashes ^ _nth(2 * i + 1))
        keys[:, i // IN_BAND] = C.mixed(keys[:, i // IN_BAND] * C.MULT + np.minimum.reduceat(own, heads) + np.uint64(i))
    listed = dict(zip(have.tolist(), keys.view(np.int64).tolist()))
    return [listed.get(i, []) for i in range(n_rows)]


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, bands: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp (binary, big-endian words) and, with bands, keys (array of long) and same (digest of the shingle set); fp is then of the set."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        C.enter("simhash")
        for batch in batches:
            data, offs = C.text_buffer(batch.column(1))
            fps, keys, same = [], [], []
            for lo, hi in C.slices(offs, C.SLICE_BYTES if words == 1 else C.SLICE_BYTES >> 2):  # wide fingerprints take more room
                hashes, rows = shingle_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                if bands:
                    hashes, rows = distinct(hashes, rows)
                    keys += minima(hashes, rows, hi - lo)
                    same += [xxhash.xxh3_128_digest(x) for x in sets_of(hashes, rows, hi - lo)]
                fps += [x.tobytes() for x in majority(hashes, rows, hi - lo, words).byteswap()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())] + [pa.array(keys, pa.list_(pa.int64())), pa.array(same, pa.binary())] * bands, names=[id_col, "fp"] + ["keys", "same"] * bands)
            C.release()

    return docs.mapInArrow(run, f"`{id_col}` {kind}, fp binary" + ", keys array<bigint>, same binary" * bands)


def sets_of(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """The hashes of each row as bytes. Rows must come in order."""
    ends = 8 * np.cumsum(np.bincount(rows, minlength=n_rows))
    raw = hashes.tobytes()
    return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


def block_keys(fp: Column, radius: int) -> Column:
    """For a 64-bit fingerprint as a long: a key for every two of radius + 2 blocks."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*(F.xxhash64(F.lit(i), F.lit(j), block[i], block[j]) for i, j in itertools.combinations(range(n), 2)))


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Bit planes [width] of up to 64 fingerprints given as bits [n, width], for any leading axes [..., n, width] -> [..., width]."""
    pad = np.zeros((*bits.shape[:-2], 64, bits.shape[-1]), np.uint8)
    pad[..., : bits.shape[-2], :] = bits
    packed = np.packbits(pad, axis=-2, bitorder="little")
    return np.ascontiguousarray(np.swapaxes(packed, -1, -2)).view(np.uint64)[..., 0]


def linked_lanes(planes: np.ndarray, queries: np.ndarray, q: np.ndarray, b: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a query and a block: the lanes within the radius, as a bit mask.

    planes [blocks, width], queries [n, width] of 0 or all ones, lanes [pairs]: the lanes that count.
    The counters start at 2**m - 1 - radius, so that a carry out of the top bit means: past the radius.
    """
    width, m = planes.shape[1], (radius + 1).bit_length()
    start = (1 << m) - 1 - radius
    live, over = np.arange(len(q)), ~lanes
    counters = [np.full(len(q), _ONES if start >> j & 1 else 0, np.uint64) for j in range(m)]
    out = np.zeros(len(q), np.uint64)
    for p in range(width):
        carry = planes[b, p] ^ queries[q, p]
        for j in range(m):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over = over | carry
        if p % 8 == 7:
            open_ = over != _ONES
            if not open_.any():
                return out
            if open_.mean() < 0.75:  # abandon the blocks in which all lanes are past the radius
                live, over, q, b = live[open_], over[open_], q[open_], b[open_]
                counters = [c[open_] for c in counters]
    out[live] = ~over
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps, axis=1, bitorder="little")


def small_forest(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of at most 64 rows in a run each: (row, root row) for every row that has a smaller one in its component."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(heads, len(group)))
    block = np.repeat(np.arange(len(heads)), sizes)
    lane = np.arange(len(group)) - heads[block]
    bits = _bits(fps)
    pad = np.zeros((len(heads), 64, bits.shape[1]), np.uint8)
    pad[block, lane] = bits
    everyone = np.where(sizes == 64, _ONES, (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    masks = linked_lanes(planes_of(pad), np.where(bits > 0, _ONES, np.uint64(0)), np.arange(len(group)), block, everyone[block], radius)
    linked = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    label = lane.copy()
    while True:
        table = np.full((len(heads), 64), 64)
        table[block, lane] = label
        new = np.minimum(label, np.where(linked, table[block], 64).min(axis=1))
        new = np.minimum(new, table[block, new])
        if (new == label).all():
            break
        label = new
    row = np.flatnonzero(label != lane)
    return row, heads[block[row]] + label[row]


def large_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One group of many rows: search from a row through those not reached yet, so that nothing is paired twice."""
    bits = _bits(fps)
    queries = np.where(bits > 0, _ONES, np.uint64(0))
    left, rows, roots = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            n_blocks = -(-len(left) // 64)
            pad = np.zeros((n_blocks * 64, bits.shape[1]), np.uint8)
            pad[: len(left)] = bits[left]
            planes = planes_of(pad.reshape(n_blocks, 64, -1))
            lanes = np.full(n_blocks, _ONES)
            if len(left) % 64:
                lanes[-1] = (np.uint64(1) << np.uint64(len(left) % 64)) - np.uint64(1)
            found = np.zeros(n_blocks, np.uint64)
            step = max(1, 65_536 // n_blocks)
            for lo in range(0, len(front), step):
                own = front[lo : lo + step]
                masks = linked_lanes(planes, queries, np.repeat(own, n_blocks), np.tile(np.arange(n_blocks), len(own)), np.tile(lanes & ~found, len(own)), radius)
                found |= np.bitwise_or.reduce(masks.reshape(len(own), n_blocks), axis=0)
            hit = np.unpackbits(found.view(np.uint8), bitorder="little")[: len(left)].astype(bool)
            front, left = left[hit], left[~hit]
            rows.append(front)
            roots.append(np.full(len(front), root))
    return (np.concatenate(rows), np.concatenate(roots)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches of (tile, node, fp), sorted by tile: the links (a, b) of a spanning forest of each tile."""

    def solve(tile, node, fps):
        heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.append(heads, len(tile)))
        few = np.repeat(sizes <= 64, sizes)
        at = np.flatnonzero(few)
        step = max(64, 4_000_000 // (64 * fps.shape[1]))  # rows whose padded planes stay small
        lo = 0
        while lo < len(at):
            hi = min(len(at), lo + step)
            while hi < len(at) and tile[at[hi]] == tile[at[hi - 1]]:
                hi += 1
            own = at[lo:hi]
            row, root = small_forest(tile[own], fps[own], radius)
            yield node[own[row]], node[own[root]]
            lo = hi
        for s, n in zip(heads, sizes):
            if n > 64:
                row, root = large_forest(fps[s : s + n], radius)
                yield node[s + row], node[s + root]

    kept = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            tile, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offs = C.text_buffer(batch.column(2))
            if not len(tile):
                continue
            fps = data.reshape(len(tile), -1)
            if kept is not None:
                tile, node, fps = np.concatenate([kept[0], tile]), np.concatenate([kept[1], node]), np.concatenate([kept[2], fps])
            cut = int(np.flatnonzero(tile == tile[-1])[0])  # the last tile may go on in the next batch
            kept = tile[cut:], node[cut:], fps[cut:]
            tile, node, fps = tile[:cut], node[:cut], fps[:cut]
        elif kept is not None:
            tile, node, fps = kept
        else:
            return
        for a, b in solve(tile, node, fps) if len(tile) else ():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidate_radius(similarity: float, bits: int) -> int:
    """The distance that fingerprints of two shingle sets of at least the similarity keep to, but for SPREAD standard deviations.

    Two large sets of one size are the worst, as unequal sizes and more in common bring them nearer; for small sets
    the share of unequal bits is counted out, as ties (which leave a bit unset) put them further apart.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = 64
    halves = [np.array([math.comb(n, i) for i in range(n + 1)], float) / 2.0**n for n in range(most + 1)]
    over = lambda n, own, total: halves[n][max(0, total // 2 - own + 1) :].sum()
    for a in range(1, most + 1):
        for b in range(a, most + 1):
            common = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if common > a or a == b == common:
                continue
            apart = 0.0
            for own, weight in enumerate(halves[common]):
                p, q = over(a - common, own, a), over(b - common, own, b)
                apart += weight * (p * (1 - q) + q * (1 - p))
            share = max(share, float(apart))
    return min(bits, math.ceil(bits * share + SPREAD * math.sqrt(bits * share * (1 - share))))


def set_forest(sets: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) of a spanning forest of the links between sets, given one after the other (distinct values, none empty)."""
    n = len(sizes)
    ids = np.unique(sets, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    heads = ends - sizes
    mine = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    left, rows, roots = np.ones(n, bool), [], []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            q = front.pop()
            own = ids[heads[q] : ends[q]]
            mine[own] = True
            both = np.add.reduceat(mine[ids], heads, dtype=np.int64)
            mine[own] = False
            hit = np.flatnonzero(left & (both / (sizes + sizes[q] - both) >= similarity))
            left[hit] = False
            front += hit.tolist()
            rows.append(hit)
            roots.append(np.full(len(hit), root))
    return (np.concatenate(rows), np.concatenate(roots)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def set_forests(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches of (tile, node, set), sorted by tile: the links (a, b) of a spanning forest of each tile."""
    kept: list[pa.RecordBatch] = []
    tile = None

    def solve():
        data, offs = C.text_buffer(pa.concat_arrays([x.column(2) for x in kept]))
        node = np.concatenate([x.column(1).to_numpy(zero_copy_only=False) for x in kept])
        row, root = set_forest(np.frombuffer(data.tobytes(), np.uint64), np.diff(offs) // 8, similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(node[root])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tiles = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
        for lo, hi in zip(cuts, cuts[1:]):
            if kept and tiles[lo] != tile:
                yield solve()
                kept = []
            tile = tiles[lo]
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield solve()
    C.release()


def similar_links(docs: DataFrame, nodes: DataFrame, loose: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join the nodes (node, same) of each component in loose (node, component) whose shingle sets are similar enough."""
    met = loose.unionByName(loose.select(F.col("component").alias("node"), "component").distinct())
    member = nodes.select("node", "same").join(met, "node")
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offs = C.text_buffer(batch.column(1))
            wanted, out = batch.column(2).to_pylist(), []
            for lo, hi in C.slices(offs):
                out += sets_of(*distinct(*shingle_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)), hi - lo)
            own = np.flatnonzero([xxhash.xxh3_128_digest(x) == y for x, y in zip(out, wanted)])  # an id may have other texts too
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(3).take(pa.array(own)), pa.array([out[i] for i in own], pa.binary())], names=["node", "component", "set"])
            C.release()

    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(member, "node").select("node", "text", "same", "component")
    sets = C.written(texts.mapInArrow(run, f"node {kind}, component {kind}, set binary"))
    volume = sets.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / SET_TILE, F.sum(F.length("set")) / (8 * SET_SHINGLES))).cast("long").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    rows = C.hot_join(sets, volume, "component", sets.count())
    rows = rows.select("component", "node", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "node", "set")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda batches: set_forests(batches, similarity), f"a {kind}, b {kind}")


def links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """nodes (node long, fp binary, keys array of long) -> links (a, b) that join what lies within the radius and shares a key."""
    # Keys that only one node has are gone before a fingerprint travels.
    rows = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    met = C.written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = C.hot_join(rows, met, "key", met.agg(F.sum("n")).first()[0] or 0).withColumnRenamed("n", "count").join(nodes.select("node", "fp"), "node")
    n = F.ceil(F.col("count") / tile).cast("long")
    mine = F.pmod(F.xxhash64("node"), n)
    rows = rows.select("key", "node", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    rows = rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "node", "fp")
    return rows.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(lambda batches: forests(batches, radius), "a bigint, b bigint")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): each linked node and the smallest node reachable from it; smallest nodes themselves are left out."""
    last, old = None, C.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    for _ in range(limit):
        state = old.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return old.select(F.col("v").alias("node"), F.col("u").alias("component"))
        last = state
        both = old.unionByName(old.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large star: the greater neighbours of a node go to the smallest of its neighbours and itself
        small = both.groupBy("v").agg(F.min("u").alias("m"), F.count_if(F.col("u") > F.col("v")).alias("n")).select("v", F.least("m", "v").alias("m"), "n")
        large = C.hot_join(both.filter("u > v"), small, "v", state[0]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: the smaller neighbours of a node, and the node, go to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        star = C.hot_join(large, least, "v", state[0]).filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        new = C.written(star.filter("v <> u").distinct())
        C.forget(old)
        old = new
    raise RuntimeError(f"components have not settled after {limit} rounds")


def groups(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 16) -> DataFrame:
    """(id_col, fp, component_id) for every row: component_id is the smallest id that the row is linked to, over any number of links.

    Without similarity: 64-bit fingerprints within the radius are linked, and none is missed. With similarity (of shingle
    sets, as intersection over union): pairs that share a band of minima, with fingerprints of `words` x 64 bits within a wide
    radius, are candidates; linked are those of them, and of what hangs together by them, whose sets are at least that similar.
    """
    if similarity is None:
        words = 1
    else:
        radius = candidate_radius(similarity, 64 * words)
    alike = "fp" if similarity is None else "same"
    rows = C.written(fingerprints(docs, k, words, similarity is not None, id_col, text_col).withColumnRenamed(id_col, "doc"))
    if similarity is None:
        nodes = rows.groupBy("fp").agg(F.min("doc").alias("node"), F.count("*").alias("n")).filter("node is not null")
        as_long = F.conv(F.hex("fp"), 16, -10).cast("long")
        nodes = nodes.withColumn("keys", block_keys(as_long, radius))
    else:
        nodes = rows.groupBy("same").agg(F.min("doc").alias("node"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).filter("node is not null")
    nodes = C.written(nodes)
    parts = components(links(nodes, radius))
    if similarity is not None:
        parts = components(similar_links(docs, nodes, parts, k, similarity, id_col, text_col))
    labels = nodes.select(alike, "node", "n").join(parts, "node", "left").select(alike, "n", F.coalesce("component", "node").alias("component_id"))
    return C.hot_join(rows, labels, alike, rows.count(), "left").select(F.col("doc").alias(id_col), "fp", F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the document of the smallest id of each near-duplicate group; columns stay as they are.

    Of rows that share id and text one stays; rows that share an id but not the text go or stay together.
    """
    found = groups(docs, k, id_col=id_col, text_col=text_col, similarity=similarity)
    own = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(own, id_col, "left_semi")
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if not again.isEmpty():
        kept = kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
