"""Sequence packing by the online sum-of-squares rule.

Every document becomes token ids followed by one end id. Whole windows are cut off first; each remainder is placed, as it
comes, into the fill level that keeps the sum of squared counts of partially filled windows smallest. The counts stand in an
array with one cell a level, so a placement costs one vectorised look at the levels that have room. Each partition packs its own
rows, with no shuffle and nothing on the driver. When its rows end, the emptiest open windows are cut to fill the others, and
what is left of the last one is cut into powers of two, so a partition ends without padding.

Sequence ids are (partition number << 36) + a running number, so a recomputed task gives the same ids.

Defined results: null counts as empty text, which is the end id alone; repeated rows are packed each; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .token_count import PreTokens, boundaries, normalized

WINDOW = 2048
END_ID = 1
#: Bytes that the memo of pre-tokens may take, and pre-tokens that are encoded at a time.
MEMO_BYTES, AT_A_TIME = 40_000_000, 4096
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1 << 20


class Ids:
    """Ids of texts, with a bounded memo of the tokenizer's ids of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.size = 0
        # Whether a token ends a pre-token: the vocabulary says so in its string.
        vocabulary = self.tokenizer.get_vocab()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token. Many are one text, with blanks between (which the tokenizer drops), and are told apart by the tokens that end one."""
        out: list[bytes] = []
        for lo in range(0, len(words), AT_A_TIME):
            some = words[lo : lo + AT_A_TIME]
            raw = self._encode([" ".join(some)])[0]
            stops = 4 * (np.flatnonzero(self.last[np.frombuffer(raw, np.uint32)]) + 1)
            if len(stops) != len(some) or stops[-1] != len(raw):
                out += self._encode(some)
                continue
            ends = stops.tolist()
            out += [raw[s:e] for s, e in zip([0, *ends], ends)]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), AT_A_TIME):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[lo : lo + AT_A_TIME], add_special_tokens=False)]
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; one that holds the string of a special token is encoded as a whole."""
        whole = [i for i, x in enumerate(texts) if self.special.search(x)]
        parts = PreTokens(["" if self.special.search(x) else normalized(x) for x in texts], boundaries())
        if self.size > MEMO_BYTES:
            self.known.clear()
            self.size = 0
        known = self.known
        missing = [x for x in parts.distinct if x not in known]
        new = dict(zip(missing, self._encode_words(missing)))
        own = [known[x] if x in known else new[x] for x in parts.distinct]
        short = {k: v for k, v in new.items() if len(k) <= 64}
        known.update(short)
        self.size += sum(len(k) + len(v) + 200 for k, v in short.items())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, at = np.frombuffer(b"".join(own), np.uint32), np.cumsum(sizes) - sizes
        counts = sizes[parts.which]
        ends = np.cumsum(counts)
        ids = flat[np.arange(int(counts.sum())) + np.repeat(at[parts.which] - ends + counts, counts)].tobytes()
        stops = 4 * np.cumsum(np.bincount(parts.row, weights=counts, minlength=len(texts)).astype(np.int64))
        out = [ids[s:e] for s, e in zip([0, *stops.tolist()], stops.tolist())]
        for i, raw in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = raw
        return out


@functools.lru_cache(1)
def ids_of(path: str) -> Ids:
    return Ids(path)


C.keeps("packing", ids_of.cache_clear)


class SumOfSquares:
    """Open windows by fill level: counts[level] and the windows themselves."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of less than a window where the sum of squares stays smallest; the window's pieces if that fills it."""
        w, c = self.window, self.counts
        room = c[1 : w - size + 1]
        # From level l to l + size: -2 c[l] + 1 and + 2 c[l + size] + 1; a full window counts nothing. Level 0 is a new window.
        cost = np.where(room > 0, -2 * room + 2 * c[1 + size : w + 1] + 2, 1 << 60)
        if len(cost):
            cost[-1] -= 2 * c[w] + 1  # c[w] stays 0; a piece that fills a window takes only from its level
        best = int(np.argmin(cost)) if len(cost) else -1
        if best >= 0 and cost[best] <= 2 * c[size] + 1 and room[best] > 0:
            level = best + 1
            own = self.open[level].pop()
            c[level] -= 1
        else:
            level, own = 0, []
        own.append((piece, size))
        if level + size == w:
            return own
        c[level + size] += 1
        self.open[level + size].append(own)
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [own for level in range(self.window, 0, -1) for own in self.open[level]]


def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """A piece is (document, ids, start, end, ids in all)."""
    doc, ids, start, end, total = piece
    return (doc, ids, start, start + at, total), (doc, ids, start + at, end, total)


def _finish(windows: list[list], window: int):
    """Fill the open windows from the emptiest of them; the last remainder in powers of two."""
    full, lo, hi = [], 0, len(windows) - 1
    fill = [sum(n for _, n in own) for own in windows]
    while lo < hi:
        if fill[lo] == window:
            lo += 1
            continue
        piece, n = windows[hi].pop()
        take = min(n, window - fill[lo])
        head, tail = _cut(piece, take)
        windows[lo].append((head, take))
        fill[lo] += take
        fill[hi] -= n
        if take < n:
            windows[hi].append((tail, n - take))
            fill[hi] += n - take
        if not fill[hi]:
            hi -= 1
    full += windows[:lo]
    if lo <= hi:
        own, left = windows[lo], fill[lo]
        while left:
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            while room:
                piece, n = own.pop(0)
                take = min(n, room)
                head, tail = _cut(piece, take)
                part.append((head, take))
                if take < n:
                    own.insert(0, (tail, n - take))
                room -= take
            full.append(part)
            left -= size
    return full


FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: document, its place there, sequence and the place in it; with_ids adds the ids (binary, 32-bit little-endian).

    window: a power of two, the ids of a sequence. vocabulary: path of a tokenizer file that every executor has.
    """
    docs = docs.select(id_col, text_col)
    kind = docs.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        C.enter("packing")
        encoder, packer, number = ids_of(vocabulary), SumOfSquares(window), TaskContext.get().partitionId() << 36
        ready: list[list] = []
        type_ = None

        def flush():
            nonlocal number, ready
            docs_, rows = [], []
            for own in ready:
                offset = 0
                for (doc, ids, start, stop, total), n in own:
                    raw = ids[4 * start : 4 * stop]
                    docs_.append(doc)
                    rows.append((start, n, zlib.crc32(raw), total, number, offset, raw))
                    offset += n
                number += 1
            ready = []
            columns = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(docs_, type_), *(pa.array(c, pa.int64()) for c in columns[:6])] + [pa.array(columns[6], pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *FIELDS] + ["ids"] * with_ids)

        for batch in batches:
            type_ = batch.schema.field(0).type
            _, offs = C.text_buffer(batch.column(1))
            for lo, hi in C.slices(offs, SLICE_BYTES):
                docs_, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for doc, ids in zip(docs_, encoder.of([x or "" for x in texts])):
                    ids += end
                    total = len(ids) // 4
                    whole = total // window * window
                    ready += [[((doc, ids, s, s + window, total), window)] for s in range(0, whole, window)]
                    if whole < total:
                        done = packer.place((doc, _Tail(ids[4 * whole :], whole), whole, total, total), total - whole)
                        if done:
                            ready.append(done)
                if ready:
                    yield flush()
                C.release()
        ready = _finish(packer.rest(), window)
        if ready:
            yield flush()

    return docs.mapInArrow(run, schema)


class _Tail:
    """The end of a long document's ids: the open windows don't hold the rest."""

    def __init__(self, raw: bytes, start: int):
        self.raw, self.at = raw, 4 * start

    def __getitem__(self, part: slice) -> bytes:
        return self.raw[part.start - self.at : part.stop - self.at]


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
