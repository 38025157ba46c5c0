"""Media columns: sniff the true type of stored bytes, and carve what is embedded in them.

An Aho-Corasick automaton over all magic bytes finds every place where a format may start. A validator for each format then
follows its structure and lengths: a container counts only if its chunks, sizes and checksums hold, and ends where it says.
The outermost valid container at the start gives the type (whatever type was declared); valid ones further in are carved.

Where a format's end is marked by a string, all places of that string are found once a payload, so many headers cost no more than one.
A FLAC stream states no length, so it goes to the end of the bytes; a PDF goes to its last end mark before the next header.

Storing: a payload becomes an 8-bit mono WAV, or an 8-bit grey PNG or PGM 64 samples wide; each gives the same bytes back.

Defined results: null bytes or text count as empty; an unknown type is `bin`; an embedded container that overlaps an earlier valid one is
part of that one; repeated rows are treated each; other columns pass through.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

WIDTH = 64
RATE = 8000

#: Magic bytes of each format, and where they stand in it.
MAGIC = {
    b"RIFF": ("riff", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"%PDF-": ("pdf", 0),
    b"PK\x03\x04": ("zip", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
    b"BM": ("bmp", 0),
    b"P5\n": ("pgm", 0),
}


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def store_wav(payload: bytes) -> bytes:
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + bytes(len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def store_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def store_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


STORE = {"wav": store_wav, "png": store_png, "pgm": store_pgm}


def _riff_chunks(data: bytes, at: int, end: int):
    pos = at + 12
    while pos + 8 <= end:
        size = int.from_bytes(data[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return
        yield data[pos : pos + 4], pos + 8, size
        pos += 8 + size + size % 2


def read_wav(data: bytes, at: int = 0) -> bytes:
    """Samples of an 8-bit WAV, from its data chunk."""
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return next(data[p : p + n] for kind, p, n in _riff_chunks(data, at, end) if kind == b"data")


def read_png(data: bytes, at: int = 0) -> bytes:
    """Samples of an 8-bit grey PNG whose rows are stored as they are."""
    pos, parts, width = at + 8, [], WIDTH
    while True:
        size, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        if kind == b"IHDR":
            width = int.from_bytes(data[pos + 8 : pos + 12], "big")
        elif kind == b"IDAT":
            parts.append(data[pos + 8 : pos + 8 + size])
        elif kind == b"IEND":
            return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
        pos += 12 + size


def read_pgm(data: bytes, at: int = 0) -> bytes:
    width, height, start = _pgm_head(data, at)
    return data[start : start + width * height]


READ = {"wav": read_wav, "png": read_png, "pgm": read_pgm}


def _pgm_head(data: bytes, at: int) -> tuple[int, int, int]:
    m = re.compile(rb"P5\n(\d{1,9}) (\d{1,9})\n255\n").match(data, at)
    return (int(m[1]), int(m[2]), m.end()) if m else (0, 0, 0)


class Places:
    """Places of patterns in the bytes, each pattern sought once."""

    def __init__(self, data: bytes):
        self.data = data
        self.known: dict[bytes, list[int]] = {}
        # What came of walks from page to page or box to box, by kind and place: later magics on the way need not go it again.
        self.walks: dict[str, dict[int, object]] = {}

    def of(self, pattern: bytes) -> list[int]:
        if pattern not in self.known:
            self.known[pattern] = [m.start() for m in re.finditer(pattern, self.data)]
        return self.known[pattern]

    def after(self, pattern: bytes, at: int) -> int:
        """The first place from `at` on, or -1."""
        found = self.of(pattern)
        i = bisect.bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def before(self, pattern: bytes, end: int) -> int:
        """The last place before `end`, or -1."""
        i = bisect.bisect_left(self.of(pattern), end)
        return self.known[pattern][i - 1] if i else -1


ZIP_END = rb"PK\x05\x06\x00\x00\x00\x00(?s:.{12})(?s:.{2})"
JPEG_MARK = rb"\xff(?=[^\x00\xd0-\xd7\xff])"

# Validators: (type, end) of the container that starts at `at`, or None.


def _riff(data, at, places):
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    form = data[at + 8 : at + 12]
    if end > len(data) or end < at + 20 or form not in (b"WAVE", b"AVI ", b"WEBP"):
        return None
    kinds, pos = {}, at + 12
    for kind, p, n in _riff_chunks(data, at, end):
        kinds.setdefault(kind, (p, n))
        pos = p + n + n % 2
    if pos != end:
        return None
    if form == b"WAVE":
        if b"data" not in kinds or kinds.get(b"fmt ", (0, 0))[1] < 16:
            return None
        channels, rate, per_s, block, bits = struct.unpack_from("<HIIHH", data, kinds[b"fmt "][0] + 2)
        if not (channels and rate and block == channels * -(-bits // 8) and per_s == rate * block and kinds[b"data"][1] % block == 0):
            return None
    return {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}[form], end


def _png(data, at, places):
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        stop = pos + 12 + size
        if stop > len(data) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(data[pos + 4 : stop - 4]) != int.from_bytes(data[stop - 4 : stop], "big"):
            return None
        if kind == b"IEND":
            return "png", stop
        pos, first = stop, False
    return None


def _gif(data, at, places):
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(data):
        mark = data[pos]
        if mark == 0x3B:
            return "gif", pos + 1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return None


def _jpeg(data, at, places):
    pos, scan = at + 2, False
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        kind = data[pos + 1]
        if kind == 0xD9:
            return ("jpeg", pos + 2) if scan else None
        pos += 2 + int.from_bytes(data[pos + 2 : pos + 4], "big")
        if kind == 0xDA:
            scan = True
            pos = places.after(JPEG_MARK, pos)
            if pos < 0:
                return None
    return ("jpeg", pos + 2) if scan and data[pos : pos + 2] == b"\xff\xd9" else None


def _pdf(data, at, places):
    if not re.compile(rb"%PDF-[12]\.\d").match(data, at):
        return None
    following = places.after(rb"%PDF-[12]\.\d", at + 1)
    end = places.before(rb"%%EOF", following if following > 0 else len(data))
    return ("pdf", end + 5) if end > at and at < places.before(rb"startxref", end) else None


def _zip(data, at, places):
    mark = places.after(ZIP_END, at)
    if mark < 0:
        return None
    size, offset, note = struct.unpack_from("<IIH", data, mark + 12)
    end = mark + 22 + note
    return ("zip", end) if mark - size - offset == at and end <= len(data) and data[at + offset : at + offset + 4] == b"PK\x01\x02" else None


def _gzip(data, at, places):
    stream, pos = zlib.decompressobj(31), at
    try:
        while not stream.eof and pos < len(data):
            stream.decompress(data[pos : pos + 65_536])
            pos += 65_536
    except zlib.error:
        return None
    return ("gzip", min(pos, len(data)) - len(stream.unused_data)) if stream.eof else None


def _walk(places: Places, kind: str, at: int, step: Callable, ends: Callable):
    """What comes of the walk from `at`: step(place) gives the next place and what is there, or None where the walk stops; ends(place, what is there,
    what came of the rest) goes back from the stop, whose two last are None."""
    known = places.walks.setdefault(kind, {})
    way, pos, out = [], at, None
    while pos not in known:
        following = step(pos)
        if following is None:
            known[pos] = ends(pos, None, None)
            break
        way.append((pos, following[1]))
        pos = following[0]
    out = known[pos]
    for pos, added in reversed(way):
        out = known[pos] = ends(pos, added, out)
    return out


def _flac(data, at, places):
    if data[at + 4 : at + 5] not in (b"\x00", b"\x80") or int.from_bytes(data[at + 5 : at + 8], "big") != 34:
        return None

    def block(pos):
        if pos + 4 > len(data):
            return None
        return pos + 4 + int.from_bytes(data[pos + 1 : pos + 4], "big"), bool(data[pos] & 128)

    def frame(pos):
        return data[pos : pos + 1] == b"\xff" and len(data) > pos + 1 and data[pos + 1] & 0xFE == 0xF8

    def ends(pos, last, rest):
        return False if last is None else frame(block(pos)[0]) if last else rest

    return ("flac", len(data)) if _walk(places, "flac", at + 4, block, ends) else None


def _ogg(data, at, places):
    def page(pos):
        if data[pos : pos + 5] != b"OggS\x00" or pos + 27 > len(data):
            return None
        table = data[pos + 27 : pos + 27 + data[pos + 26]]
        after = pos + 27 + len(table) + sum(table)
        return None if len(table) < data[pos + 26] or after > len(data) else (after, bool(data[pos + 5] & 4))

    end = _walk(places, "ogg", at, page, lambda pos, last, rest: -1 if last is None else page(pos)[0] if last else rest)
    return ("ogg", end) if end > at else None


_BOX = re.compile(rb"[a-zA-Z0-9 ]{4}")


def _mp4(data, at, places):
    def box(pos):
        if pos + 8 > len(data):
            return None
        size, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        return None if size < 8 or pos + size > len(data) or not _BOX.fullmatch(kind) else (pos + size, kind in (b"moov", b"moof"))

    end, has = _walk(places, "mp4", at, box, lambda pos, media, rest: (pos, False) if media is None else (rest[0], media or rest[1]))
    return ("mp4", end) if has and data[at + 4 : at + 8] == b"ftyp" else None


def _bmp(data, at, places):
    if at + 30 > len(data):
        return None
    size, spare, offset, head = struct.unpack_from("<IIII", data, at + 2)
    return ("bmp", at + size) if not spare and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size <= len(data) - at else None


def _pgm(data, at, places):
    width, height, start = _pgm_head(data, at)
    return ("pgm", start + width * height) if width and height and start + width * height <= len(data) else None


VALID = {"riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "bmp": _bmp, "pgm": _pgm}


@functools.lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind, before))
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """True type, its container's end (0 for bin) and the embedded containers (type, start, end)."""
    top, top_end, inner, reach, places = "bin", 0, [], 0, Places(data)
    for last, (size, kind, before) in automaton().iter(data.decode("latin-1")):
        at = last - size + 1 - before
        if at < reach or at < 0:
            continue
        valid = VALID[kind](data, at, places)
        if valid is None:
            continue
        if at == 0:
            top, top_end = valid
        else:
            inner.append((valid[0], at, valid[1]))
            reach = valid[1]
    return top, top_end, inner


def store(docs: DataFrame, form: str = "wav", text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by media (binary), declared_type and n_bytes: its UTF-8 bytes, padded, in the named form."""
    columns = [c for c in docs.columns if c not in (text_col, "media", "declared_type", "n_bytes")]
    docs = docs.select(*columns, text_col)
    encode = STORE[form]

    def run(batches):
        for batch in batches:
            for lo, hi in C.slices(C.text_buffer(batch.column(len(columns)))[1], 8 << 20):
                part = batch.slice(lo, hi - lo)
                raw = [(x or "").encode() for x in part.column(len(columns)).to_pylist()]
                new = [pa.array([encode(padded(x)) for x in raw], pa.binary()), pa.array([form] * len(raw), pa.string()), pa.array([len(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *new], names=[*columns, "media", "declared_type", "n_bytes"])

    fields = [*docs.schema.fields[:-1], T.StructField("media", T.BinaryType()), T.StructField("declared_type", T.StringType()), T.StructField("n_bytes", T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields))


FOUND = "true_type string, corrected boolean, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, mean double, carved array<struct<type:string,start:bigint,length:bigint>>"


def inspect(media: DataFrame, media_col: str = "media", type_col: str = "declared_type") -> DataFrame:
    """media with media_col replaced by what its bytes are: type, digests, the decoded samples' features and carved containers.

    Payload columns are null where the samples can't be decoded here (all types but 8-bit WAV, grey PNG and PGM).
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    columns = [c for c in media.columns if c not in (media_col, *names)]
    media = media.select(*columns, media_col)
    declared = columns.index(type_col)

    def run(batches):
        for batch in batches:
            rows = []
            for kind, data in zip(batch.column(declared).to_pylist(), batch.column(len(columns))):
                data = data.as_py() or b""
                true, _, inner = sniff(data)
                payload = None
                if true in READ:
                    try:
                        payload = READ[true](data)
                    except (ValueError, StopIteration, zlib.error):
                        payload = None
                crc = zlib.crc32(payload[-64:]) if payload is not None else None
                mean = round(float(np.frombuffer(payload, np.uint8).mean()), 6) if payload else None
                carved = [{"type": t, "start": s, "length": e - s} for t, s, e in inner]
                rows.append((true, true != kind, len(data), hashlib.sha256(data).hexdigest(), None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(), crc, mean, carved))
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))]
            new = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=[*columns, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields[:-1])
    return media.mapInArrow(run, f"{fields}, {FOUND}")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return inspect(store(docs)).selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "concat_ws(';', concat('type=', true_type), concat('mean=', cast(mean as string)), concat('carved=', array_join(transform(carved, x -> concat(x.type, '@', x.start, '+', x.length)), ','))) as feature")


QUERIES = {"op6_media": op6_media}
ORACLE: dict[str, str] = {}
