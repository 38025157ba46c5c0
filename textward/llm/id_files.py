"""Token-id files with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of their ids and sorted, encoded, and written in that order, so the files one after the other are one id array.
A file holds a head, the ends of its documents, their ids and the concatenated token ids. Ends and document ids are rising numbers, each
list as two parts (Elias-Fano): the low bits packed, the high bits as a unary bit string, with the place of every SAMPLE-th one beside it. Select goes to
the sample before and counts ones from there, so any document's range is found without reading the others and without a table of 64-bit
offsets: about 2 + log2(mean length) bits a document.

Texts are cut into pre-tokens by classes of characters in numpy; each distinct one of a slice is encoded once by the tokenizers library and
remembered within bounds. Texts with characters whose class newer Unicode versions may see otherwise, and those with the strings of special
tokens, go to the library whole. Spark's text writer puts the files where any Spark can write, a row a file.

Defined results: null counts as empty text, which is the end id alone; rows without an id come first; rows that share an id are in the order of the
input; repeated rows are encoded each; an empty table has no files and no rows; other columns are not read. Document ids are 64-bit numbers.
"""

from __future__ import annotations

import dataclasses
import functools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common as C

END_ID = 2
#: Token ids of one file (or one longer document).
FILE_IDS = 1 << 24
#: Ones between two samples of a select structure.
SAMPLE = 256
#: Bytes of text that are encoded at a time, bytes that the memo of pre-tokens may take, and pre-tokens that are encoded as one text.
SLICE_BYTES, MEMO_BYTES, AT_A_TIME = 1 << 20, 60_000_000, 4096

MAGIC = b"EFIDS1\n\0"
#: Head: magic, task, file of the task, documents, those without id, token ids, bytes a token id, largest of the ids' list, smallest id. Big-endian.
HEAD = struct.Struct(">8sQQQQQQQq")
FOOT = b"\nEFEND\n"

#: Classes of characters: letters, numbers, white space, others; characters of OPEN class are left to the library.
LETTER, NUMBER, SPACE, OTHER, OPEN = range(5)
#: White space of the pre-tokenizer's pattern.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Where a long text may be cut: a pre-token starts at a blank between a word and a letter.
CUT = re.compile(r"[A-Za-z0-9.,;:!?] (?=[A-Za-z])")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code below 65536; those that Unicode 3.2 has otherwise, or not at all, are open."""
    out = np.full(1 << 16, OPEN, np.uint8)
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))
        if unicodedata.ucd_3_2_0.category(chr(code)) == kind and kind not in ("Cs", "Cn"):
            out[code] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[SPACES] = SPACE
    return out


def token_starts(codes: np.ndarray, kinds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; heads: the first character of each text that has any."""
    n = len(codes)
    start = np.empty(n, bool)
    start[:1] = True
    start[1:] = kinds[1:] != kinds[:-1]
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    start |= head[:n]
    # White space before a word: its last character stands alone, or with the word if it is a blank.
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)[: len(runs)]
    ends = ends[(kinds[runs] == SPACE) & ~head[ends]]
    start[ends - 1] = True
    start[ends[codes[ends - 1] == 32]] = False
    # An apostrophe that starts a pre-token, and an ending.
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    at = np.flatnonzero((codes == 39) & start & ~head[1:])
    one, two = padded[at + 1], padded[at + 2]
    two = np.where(head[np.minimum(at + 2, n)], 0, two)
    length = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
    length[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 3
    at, length = at[length > 0], length[length > 0]
    start[at + 1] = False
    at = at + length
    start[at[at < n]] = True
    return start


class Encoder:
    """Ids of texts by a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        # A token has a character for each of its bytes.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for lo in range(0, len(texts), AT_A_TIME) for x in self.tokenizer.encode_batch_fast(texts[lo : lo + AT_A_TIME], add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each pre-token. Many are encoded in one text, in which they are pre-tokens again, and told apart by their bytes.

        Those of a blank and letters stand side by side, others with a line break between; those of white space go one by one.
        """
        out: list[bytes] = [b""] * len(parts)
        words, others, rest = [], [], []
        for i, x in enumerate(parts):
            (rest if x.isspace() else words if x[0] == " " and x[1].isalpha() else others).append(i)
        for group, between in ((words, ""), (others, "\n")):
            for lo in range(0, len(group), AT_A_TIME):
                some = group[lo : lo + AT_A_TIME]
                texts = [parts[i] for i in some]
                raw = self._library([between.join(texts)])[0]
                reach = np.cumsum(self.bytes_of[np.frombuffer(raw, self.kind)])
                wanted = np.cumsum([len(x.encode()) + len(between) for x in texts])
                starts, stops = np.searchsorted(reach, np.append(0, wanted[:-1]), side="right"), np.searchsorted(reach, wanted - len(between))
                starts[0] = 0
                if not len(reach) or stops[-1] >= len(reach) or (reach[stops] != wanted - len(between)).any():
                    rest += some
                    continue
                width = self.kind().itemsize
                for i, s, e in zip(some, (starts * width).tolist(), ((stops + 1) * width).tolist()):
                    out[i] = raw[s:e]
        for i, raw in zip(rest, self._library([parts[i] for i in rest])):
            out[i] = raw
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        pieces, whose = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > 2 * SLICE_BYTES and (cut := CUT.search(text, at + SLICE_BYTES)):
                pieces.append(text[at : cut.start() + 1])
                whose.append(i)
                at = cut.start() + 1
            pieces.append(text[at:])
            whose.append(i)
        if len(pieces) == len(texts):
            return self._short(texts)
        out = [[] for _ in texts]
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= 2 * SLICE_BYTES):
                size += len(pieces[hi])
                hi += 1
            for i, raw in zip(whose[lo:hi], self._short(pieces[lo:hi])):
                out[i].append(raw)
            lo = hi
        return [b"".join(x) for x in out]

    def _short(self, texts: list[str]) -> list[bytes]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        kinds = _classes()[np.minimum(codes, 0xFFFF)]
        kinds[codes > 0xFFFF] = OPEN
        open_ = np.concatenate([[0], np.cumsum(kinds == OPEN)])
        whole = [i for i, (x, n) in enumerate(zip(texts, np.diff(open_[offs]).tolist())) if n or self.special.search(x)]
        starts = np.flatnonzero(token_starts(codes, kinds, offs[:-1][offs[:-1] < offs[1:]]))
        rows = np.searchsorted(offs, starts, side="right") - 1
        stops = np.append(starts[1:], len(codes))[: len(starts)]
        if whole:
            own = ~np.isin(rows, whole)
            starts, stops, rows = starts[own], stops[own], rows[own]
        values = codes.astype(np.uint64) + np.uint64(1)
        values = values * C.MULT ^ (values << np.uint64(32))
        _, first, which = np.unique(C.range_hash(values, starts, stops), return_index=True, return_inverse=True)
        joined = "".join(texts)
        distinct = [joined[s:e] for s, e in zip(starts[first].tolist(), stops[first].tolist())]
        if self.size > MEMO_BYTES:
            self.known.clear()
            self.size = 0
        missing = [x for x in distinct if x not in self.known]
        new = dict(zip(missing, self._encode(missing)))
        own = [new[x] if x in new else self.known[x] for x in distinct]
        short = {k: v for k, v in new.items() if len(k) <= 64}
        self.known.update(short)
        self.size += sum(len(k) + len(v) + 200 for k, v in short.items())
        width = self.kind().itemsize
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        flat, at = np.frombuffer(b"".join(own), self.kind), np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.arange(int(counts.sum())) + np.repeat(at[which] - ends + counts, counts)].tobytes()
        bounds = (width * np.concatenate([[0], np.cumsum(np.bincount(rows, weights=counts, minlength=len(texts)).astype(np.int64))])).tolist()
        out = [ids[s:e] for s, e in zip(bounds, bounds[1:])]
        for i, raw in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = raw
        return out


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


C.keeps("id_files", encoder_of.cache_clear)


@dataclasses.dataclass
class EliasFano:
    """n rising numbers of 0 to `most`."""

    n: int
    most: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def low_bits(n: int, most: int) -> int:
        return max(0, (most // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, most: int) -> tuple[int, int, int]:
        """Bytes of the low bits, the high bits and the samples."""
        bits = cls.low_bits(n, most)
        return -(-n * bits // 8), -(-(n + (most >> bits) + 1) // 8) if n else 0, 4 * -(-n // SAMPLE)

    @classmethod
    def of(cls, values: np.ndarray, most: int) -> EliasFano:
        """values: unsigned 64-bit, rising."""
        n = len(values)
        bits = cls.low_bits(n, most)
        low = np.zeros(n * bits, np.uint8)
        for b in range(bits):
            low[b::bits] = (values >> np.uint64(b)) & np.uint64(1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(8 * cls.sizes(n, most)[1], np.uint8)
        high[at] = 1
        return cls(n, most, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int, n: int, most: int) -> tuple[EliasFano, int]:
        parts = []
        for size, kind in zip(cls.sizes(n, most), (np.uint8, np.uint8, "<u4")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, most, *parts), at

    def select(self, lo: int, hi: int) -> np.ndarray:
        """The numbers lo to hi - 1 of the list, as unsigned 64-bit."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        first = int(self.samples[lo // SAMPLE]) // 8
        after = (hi - 1) // SAMPLE + 1
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = 8 * first + np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little"))
        skip = lo - lo // SAMPLE * SAMPLE + int(np.searchsorted(ones, int(self.samples[lo // SAMPLE])))
        index = np.arange(lo, hi)
        bits = self.low_bits(self.n, self.most)
        out = (ones[skip : skip + hi - lo] - index).astype(np.uint64) << np.uint64(bits)
        if bits:
            own = np.unpackbits(self.low[lo * bits // 8 : -(-hi * bits // 8)], bitorder="little")[lo * bits % 8 :]
            for b in range(bits):
                out |= own[b : (hi - lo) * bits : bits].astype(np.uint64) << np.uint64(b)
        return out


def build_file(task: int, number: int, docs: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """docs: rising, those without id first; lengths: their token ids; ids: all of them, `width` bytes each."""
    nulls = sum(x is None for x in docs)
    own = np.array(docs[nulls:], np.int64)
    base = int(own[0]) if len(own) else 0
    most = int(own[-1]) - base if len(own) else 0
    ends = np.cumsum(np.array(lengths, np.uint64), dtype=np.uint64)
    head = HEAD.pack(MAGIC, task, number, len(docs), nulls, len(ids) // width, width, most, base)
    return b"".join([head, EliasFano.of(ends, len(ids) // width).tobytes(), EliasFano.of(own.view(np.uint64) - np.uint64(base % (1 << 64)), most).tobytes(), ids])


class IdFile:
    """One file's bytes, opened: any document's range of ids by select."""

    def __init__(self, data: bytes):
        magic, self.task, self.number, self.n, self.nulls, self.n_ids, self.width, most, self.base = HEAD.unpack_from(data)
        self.ends, at = EliasFano.read(data, HEAD.size, self.n, self.n_ids)
        self.docs, at = EliasFano.read(data, at, self.n - self.nulls, most)
        if magic != MAGIC or data[at + self.width * self.n_ids :] != FOOT:
            raise ValueError("not a whole file of token ids")
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def bounds(self, lo: int, hi: int) -> np.ndarray:
        """Where documents lo to hi - 1 start, and where the last one ends."""
        own = self.ends.select(max(lo - 1, 0), hi).astype(np.int64)
        return own if lo else np.concatenate([[0], own])

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        skip = max(0, min(hi, self.nulls) - lo)
        own = self.docs.select(max(lo - self.nulls, 0), max(hi - self.nulls, 0))
        return [None] * skip + (own + np.uint64(self.base % (1 << 64))).view(np.int64).tolist()


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write the token ids of all texts, each with end_id after it, under path. vocabulary: path of a byte-level tokenizer file that every executor has."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = (F.asc_nulls_first("doc_id"), F.asc("place"))

    def run(batches):
        C.enter("id_files")
        encoder, task, number = encoder_of(vocabulary), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind().itemsize
        own: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal own, lengths, parts, number, held
            raw = build_file(task, number, own, lengths, b"".join(parts), width)
            own, lengths, parts, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["file"])

        for batch in batches:
            _, offs = C.text_buffer(batch.column(1))
            for lo, hi in C.slices(offs, SLICE_BYTES):
                found = encoder.of([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
                for doc, raw in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), found):
                    n = len(raw) // width + 1
                    if held and held + n > file_ids:
                        yield flush()
                    own.append(doc)
                    lengths.append(n)
                    parts += (raw, end)
                    held += n
                C.release()
        if own:
            yield flush()

    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "file binary")
    # A string column holds the bytes as they are; so does the writer.
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", FOOT.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")


def bases(spark: SparkSession, path: str) -> DataFrame:
    """(task, number, base): for each file the token ids of all files before it."""
    number = lambda at: F.conv(F.hex(F.substring("content", 9 + 8 * at, 8)), 16, 10).cast("long")
    files = _contents(spark, path).select(number(0).alias("task"), number(1).alias("number"), number(4).alias("ids"))
    before = F.sum("n").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, -1))
    tasks = files.groupBy(F.col("task").alias("t")).agg(F.sum("ids").alias("n")).select("t", F.coalesce(before, F.lit(0)).alias("b"))  # a row a writing task
    inside = F.sum("ids").over(W.partitionBy("task").orderBy("number").rowsBetween(W.unboundedPreceding, -1))
    files = files.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return files.join(tasks, files.task == tasks.t).select("task", "number", (F.col("inside") + F.col("b")).alias("base"))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): a row a document, from the files alone; with_ids adds ids (array<int>)."""
    try:
        contents = _contents(spark, path)
    except AnalysisException:
        contents = spark.createDataFrame([], "content binary")

    def run(batches):
        C.enter("id_files")
        for batch in batches:
            for data in batch.column(0):
                own = IdFile(data.as_py())
                lo = 0
                while lo < own.n:
                    hi = min(own.n, lo + 4096)
                    at = own.bounds(lo, hi)
                    fit = max(1, int(np.searchsorted(at, at[0] + (1 << 21), side="right")) - 1)
                    at, hi = at[: fit + 1], min(hi, lo + fit)
                    ids = own.ids[at[0] : at[-1]].astype("<u4")
                    raw, stops = memoryview(ids.tobytes()), (4 * (at - at[0])).tolist()
                    crcs = [zlib.crc32(raw[s:e]) for s, e in zip(stops, stops[1:])]
                    n = hi - lo
                    columns = [pa.array(own.doc_ids(lo, hi), pa.int64()), pa.array(np.full(n, own.task)), pa.array(np.full(n, own.number)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    lo = hi

    names = ["doc_id", "task", "number", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    found = contents.mapInArrow(run, "doc_id long, task long, number long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return found.join(bases(spark, path), ["task", "number"]).select("doc_id", (F.col("inside") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *names[6:])


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.shared_dir(spark)
    write_ids(C.table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_ids(spark, path)


QUERIES = {"op12_token_ids": op12_token_ids}
ORACLE: dict[str, str] = {}
