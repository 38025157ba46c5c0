"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged files.

Writing: each record is one gzip member. Of pages with the same payload the one with the largest id is stored as a response,
the others as revisit records that carry its HTTP head and refer to it. Spark's text writer puts the members into files, with an empty gzip
member (which readers skip) as line separator, so archives can go wherever Spark can write.

Reading: the reader takes gzip members and plain records. A record counts if its version line, header block, length, end
and, where given, its digests hold. After a failed check it searches for the next gzip magic or version line that starts a
valid record, goes on from there, and gives the skipped bytes as a gap with the reason. Inside a gzip member it does the same over the
inflated bytes, also those got before the member's data fail; a gap there has the member's position, inflated bytes, and its offset in the reason.

Defined results: a null payload is empty; an empty table writes no records; pages without an id are responses and keep a null id;
repeated rows are written each, and rows that share the largest id of a payload are all responses. Header names that repeat: the first counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: An empty gzip member.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 2, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: Runs of members, a line each for Spark's writer, of which a file has at most so many.
BLOCKS = 64
#: Bytes of a header block that are looked at before the rest of a longer one.
HEAD_BYTES = 4096
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

RECORD = "record_type string, record_id string, uri string, date string, refers_to string, refers_to_uri string, payload binary, payload_bytes bigint, payload_digest string, position bigint"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page')}>"


def _clean(value) -> str:
    return re.sub(r"[\r\n]+", " ", str(value or ""))


def build_record(page, url, payload: bytes, original=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record's bytes; original: the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}"]
    if original is not None:
        head += [f"WARC-Refers-To: {record_id(original)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, original) of every page that is not the one of the largest id among equal payloads."""
    each = pages.select(F.col(id_col).alias("_page"), F.sha1(F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))).alias("_sha")).filter("_page is not null").distinct()
    shared = each.groupBy("_sha").agg(F.max("_page").alias("_original"), F.count("*").alias("_n")).filter("_n > 1")
    return C.hot_join(each, shared, "_sha", pages.count(), n="_n").filter("_page < _original").select("_page", "_sha", "_original")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = 128 << 20) -> None:
    """Write a record a page under path. pages: id, address and payload (string or binary). Files have about file_bytes, or one larger record."""
    found = revisits(pages, id_col, payload_col)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.join(found, (rows.page == found._page) & (F.sha1(rows.payload) == found._sha), "left").select("page", "url", "payload", "_original")

    block = max(1, file_bytes // BLOCKS)

    def run(batches):
        own: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                own.append(member(build_record(*(c[i].as_py() for c in batch.columns))))
                size += len(own[-1])
                if size >= block:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], names=["member"])
                    own, size = [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary")
    # A string column holds the bytes as they are; so does the writer.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", BLOCKS).text(path)


def _headers(raw: bytes) -> dict[str, str] | None:
    found: dict[str, str] = {}
    at = 0
    while at <= len(raw):  # a line at a time: the first bad one ends it
        end = raw.find(b"\r\n", at)
        line, at = (raw[at:], len(raw) + 1) if end < 0 else (raw[at:end], end + 2)
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        found.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    return found


def _digest_holds(stated: str | None, data: bytes) -> bool:
    kind, _, value = (stated or "").partition(":")
    return kind.lower() != "sha1" or value.upper() == sha1_base32(data)


def _record_at(data: bytes, at: int, blank: list[int] | None = None) -> tuple[dict | None, int, str]:
    """The plain record that starts at `at`: record, end, and why there is none. blank: where the search for an empty line ended last, kept from place to place."""
    first = VERSION.match(data, at)
    if not first:
        return None, at, "no version line"
    blank = blank if blank is not None else [-1]
    if blank[0] < first.end():
        blank[0] = data.find(b"\r\n\r\n", first.end())
        blank[0] = len(data) if blank[0] < 0 else blank[0]
    end = blank[0]
    if end == len(data):
        return None, at, "header block not ended"
    first_lines = data[first.end() : min(end, first.end() + HEAD_BYTES)]
    # Of a long block the first lines tell mostly that it is none.
    whole = len(first_lines) == end - first.end() or b"\r\n" not in first_lines or _headers(first_lines[: first_lines.rfind(b"\r\n")]) is not None
    head = _headers(data[first.end() : end]) if whole else None
    if head is None or not head.get("content-length", "").isdigit() or "warc-type" not in head:
        return None, at, "bad header block"
    start, size = end + 4, int(head["content-length"])
    block = data[start : start + size]
    if len(block) < size:
        return None, at, "record cut short"
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    if not _digest_holds(head.get("warc-block-digest"), block):
        return None, at, "block digest differs"
    payload, length = block, size
    if head.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        stated = _headers(http.partition(b"\r\n")[2]) or {}
        length = int(stated["content-length"]) if stated.get("content-length", "").isdigit() else len(payload)
    full = head["warc-type"] != "revisit"
    if full and not _digest_holds(head.get("warc-payload-digest"), payload):
        return None, at, "payload digest differs"
    digest = head.get("warc-payload-digest", "").partition(":")[2] or (sha1_base32(payload) if full else None)
    return {"record_type": head["warc-type"], "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"), "refers_to_uri": head.get("warc-refers-to-target-uri"), "payload": payload if full else None, "payload_bytes": len(payload) if full else length, "payload_digest": digest}, start + size + 4, ""


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The gzip member that starts at `at`: its bytes as far as they can be had, where reading ended, and what is wrong with it."""
    stream, out, pos = zlib.decompressobj(31), [], at
    try:
        while not stream.eof and pos < len(data):
            out.append(stream.decompress(data[pos : pos + 65_536]))
            pos = min(pos + 65_536, len(data))
    except zlib.error as error:
        reason = f"bad gzip member ({str(error)[:40]})"
    else:
        return b"".join(out), pos - len(stream.unused_data), "" if stream.eof else "gzip member cut short"
    # Once more to the failing piece, and through that bytewise, for what comes before the error.
    stream, out, failing = zlib.decompressobj(31), [], pos
    for lo in range(at, failing, 65_536):
        out.append(stream.decompress(data[lo : lo + 65_536]))
    try:
        while pos < len(data):
            out.append(stream.decompress(data[pos : pos + 1]))
            pos += 1
    except zlib.error:
        pass
    return b"".join(out), pos, reason


def _packed_from(data: bytes, at: int, zero: int) -> tuple[int, int]:
    """Where the packed stream of the member at `at` starts (-1 if its head does not say), and the first zero byte at or after its name; zero: the one found last."""
    flags = data[at + 3] if at + 10 <= len(data) else 255
    if data[at + 2 : at + 3] != b"\x08" or flags & ~(8 | 16 | 1):
        return -1, zero
    pos = at + 10
    for flag in (8, 16):
        if flags & flag:
            if zero < pos:
                zero = data.find(b"\0", pos)
                zero = len(data) if zero < 0 else zero
            pos = zero + 1
    return pos, zero


def _within(body: bytes) -> Iterator[tuple[str, dict | int, int, int, str]]:
    """Like salvage() over the inflated bytes of a member, with start and end: kind, record or bytes, start, end, reason."""
    at, gap_from, why, blank = 0, None, "", [-1]
    while at < len(body):
        record, end, reason = _record_at(body, at, blank)
        if record is not None:
            if gap_from is not None:
                yield "gap", at - gap_from, gap_from, at, why
                gap_from = None
            yield "record", record, at, end, ""
            at = end
            continue
        if gap_from is None:
            gap_from, why = at, reason
        found = VERSION.search(body, at + 1)
        at = found.start() if found else len(body)
    if gap_from is not None:
        yield "gap", len(body) - gap_from, gap_from, len(body), why


def salvage(data: bytes) -> Iterator[tuple[str, dict | int, int, str]]:
    """("record", record, position, "") and ("gap", bytes, position, reason) over a whole archive, in order.

    A member without a valid record is a gap of its packed bytes. Of a damaged one with some, the inner gaps are given, and the packed
    bytes from where reading failed to the next valid start.
    """
    at, gap_from, why, blank, known = 0, None, "", [-1], (-1, None)
    zero = -1
    read_to, had = 0, set()  # how far a damaged member was read, and the records found in it: stored blocks show them plainly again
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            start, zero = _packed_from(data, at, zero)
            if known[0] != start or start < 0:  # several headers may lead to one stream
                known = (start, _inflated(data, at))
            body, end, reason = known[1]
            found = list(_within(body))
            good = any(x[0] == "record" for x in found)
            if good or not body and not reason:
                if gap_from is not None and gap_from < at:
                    yield "gap", at - gap_from, gap_from, why
                gap_from = None
                for kind, what, start, stop, inner in found:
                    yield kind, what, at, inner and f"{inner}, at inflated byte {start}"
                    if reason and kind == "record":
                        had.add(hashlib.sha1(body[start:stop]).digest())
                if not reason:
                    at = end
                    continue
                gap_from, why, read_to = end, reason, max(read_to, end)
            elif not reason:
                reason = found[0][4]
        else:
            record, end, reason = _record_at(data, at, blank)
            if record is not None:
                if gap_from is not None and gap_from < at:
                    yield "gap", at - gap_from, gap_from, why
                gap_from = None
                if at >= read_to or hashlib.sha1(data[at:end]).digest() not in had:
                    yield "record", record, at, ""
                at = end
                continue
        if gap_from is None:
            gap_from, why = at, reason
        found = START.search(data, at + 1)
        at = found.start() if found else len(data)
    if gap_from is not None and gap_from < len(data):
        yield "gap", len(data) - gap_from, gap_from, why


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of the records and gaps of all files under path: file, kind (record or gap), the record's fields, gap_bytes and reason.

    A file is read whole by one task, so archives should be of the usual size (to about 1 GB).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                size = 0
                for kind, what, at, why in salvage(data.as_py()):
                    record = {**(what if kind == "record" else {}), "position": at}
                    if not payloads:
                        record["payload"] = None
                    rows.append((file, kind, *(record.get(n) for n in names), None if kind == "record" else what, why or None))
                    size += len(record.get("payload") or b"") + 300
                    if size > 4_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, f"file string, kind string, {RECORD}, gap_bytes bigint, reason string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "position": pa.int64(), "gap_bytes": pa.int64()}
    columns = ["file", "kind", *names, "gap_bytes", "reason"]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(columns, zip(*rows))], names=columns)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.shared_dir(spark)
    write_archive(C.table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = read_archive(spark, path, payloads=False).filter("kind = 'record'")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: SHA-1 in base 32: four digits from every five hexadecimal ones.
ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
m as (select h, max(page_id) as largest from p group by h)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(p.h, cast(i // 4 * 5 + 1 as bigint), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when p.page_id < m.largest then 'revisit' else 'response' end as record_type, case when p.page_id < m.largest then m.largest end as refers_to
from p join m using (h)
"""

QUERIES = {"op3_warc": op3_warc}
ORACLE = {"op3_warc": ORACLE_SQL}
