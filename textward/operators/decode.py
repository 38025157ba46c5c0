"""Deobfuscation: decoders as column functions, several passes over what they give."""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import any_of
from textward.operators.heuristics import attack_predicate

#: Look-alikes of Latin letters and digits, and what they stand for.
LOOKALIKES = "аеіорсухАВСЕНІКМОРТХαβεηικνρτυχɑɡɩɪℓ" + "".join(chr(0x1D41A + i) for i in range(5)) + "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(10))
PLAIN = "aeiopcyxABCEHIKMOPTXabenikvptuxagiilabcde0123456789ABCDEFGHIJ"
#: Leetspeak characters and letters.
LEET_FROM, LEET_TO = "0123456789@$!+|(){}[]<>", "oizeasgtbgasiticdcdcdcd"
ROT_STEMS = ("vtaber", "cerivbhf", "flfgrz", "cebzcg")
THREAT_WORDS = ("ignore", "system", "prompt", "exec", "drop")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
assert len(LOOKALIKES) == len(PLAIN)
_PRINTABLE = r"^[\p{L}\p{M}\p{N}\p{P}\p{S}\s&&[^\x{FFFD}]]+$"
#: Most bytes that a compressed text may unpack to.
MOST = 1 << 20

Decoder = Callable[[Column], Column]


def _joined(found: Column) -> Column:
    return F.array_join(found, " ")


def _printable(raw: Column) -> Column:
    """Binaries that are printable UTF-8, as strings; null for others."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.rlike(_PRINTABLE), text)


def base64_text(text: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{8,}={0,2}"), F.lit(0)), lambda x: F.length(x) % 4 == 0)
    out = F.transform(runs, lambda x: _printable(F.try_to_binary(x, F.lit("base64"))))
    return _joined(F.filter(out, lambda x: F.octet_length(x) > 2))


def hex_text(text: Column) -> Column:
    escaped = F.transform(F.regexp_extract_all(text, F.lit(r"(?:\\x[0-9a-fA-F]{2})+"), F.lit(0)), lambda x: F.try_validate_utf8(F.unhex(F.replace(x, F.lit("\\x"), F.lit(""))).cast("string")))
    bare = F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"\b[0-9a-fA-F]{12,}\b"), F.lit(0)), lambda x: F.length(x) % 2 == 0), lambda x: _printable(F.unhex(x)))
    return _joined(F.filter(F.concat(escaped, bare), lambda x: x.isNotNull()))


def url_text(text: Column) -> Column:
    return F.when(text.contains("%"), F.try_url_decode(text)).otherwise("")


def _by_entity(text: Column, pattern: str, decode: Callable[[Column], Column]) -> Column:
    """text with every match of the pattern replaced by decode(match) (kept where that is null). The last piece has no match after it."""
    gaps = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.when(i < F.size(found), F.coalesce(decode(F.get(found, i)), F.get(found, i))), F.lit("")))), "")


def _char(number: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")


def html_text(text: Column) -> Column:
    decimal = lambda m: F.when(F.regexp_extract(m, r"\d+", 0).try_cast("long").between(1, 127), _char(F.regexp_extract(m, r"\d+", 0).try_cast("long")))
    hexed = lambda m: F.when(F.length(m) == 6, _char(F.conv(F.substring(m, 4, 2), 16, 10).cast("long")))
    return F.when(text.rlike("&#"), _by_entity(_by_entity(text, r"&#\d+;", decimal), r"&#[xX][0-9a-fA-F]+;", hexed)).otherwise("")


def rot13_text(text: Column) -> Column:
    turned = F.translate(text, _UPPER + _LOWER, _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13])
    return F.when(any_of(F.lower(text), list(ROT_STEMS)), turned).otherwise("")


def lookalike_text(text: Column) -> Column:
    return F.translate(text, LOOKALIKES, PLAIN)


def vertical_text(text: Column) -> Column:
    lines = F.split(text, "\n")
    firsts = _first_letters(lines)
    return F.when((F.size(lines) >= 5) & (F.length(firsts) >= 5) & F.lower(firsts).rlike("|".join(THREAT_WORDS)), firsts).otherwise("")


def _first_letters(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x: F.left(F.trim(x), F.lit(1))), lambda x: x != ""), "")


def reversed_text(text: Column) -> Column:
    back = F.reverse(text)
    return F.when(attack_predicate(back) | back.rlike(r"^[A-Za-z0-9+/=]{17,}$"), back).otherwise("")


def tag_text(text: Column) -> Column:
    tags = "".join(chr(0xE0000 + i) for i in range(1, 128))
    return F.translate(F.regexp_replace(text, r"[^\x{E0001}-\x{E007F}]", ""), tags, "".join(map(chr, range(1, 128))))


def visible_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cf}\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{20E3}]", "")


def escape_text(text: Column) -> Column:
    coded = lambda m: F.when(F.conv(F.substring(m, 3, 8), 16, 10).cast("long") <= 0x10FFFF, _char(F.conv(F.substring(m, 3, 8), 16, 10)))
    return F.when(text.rlike(r"\\[uU]"), _by_entity(text, r"\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}", coded)).otherwise("")


def octal_text(text: Column) -> Column:
    coded = lambda m: F.when(F.conv(F.substring(m, 2, 3), 8, 10).cast("long") <= 255, _char(F.conv(F.substring(m, 2, 3), 8, 10)))
    return F.when(text.rlike(r"\\[0-7]{3}"), _by_entity(text, r"\\[0-7]{3}", coded)).otherwise("")


def leet_text(text: Column) -> Column:
    plain = F.translate(text, LEET_FROM, LEET_TO)
    return F.when((plain != text) & attack_predicate(plain), plain).otherwise("")


def _shape(word: Column) -> Column:
    """First letter, last letter and the letters between, sorted: equal for words that differ only in the order within."""
    return F.concat_ws("|", F.left(word, F.lit(1)), F.right(word, F.lit(1)), F.array_join(F.array_sort(F.split(F.substring(word, F.lit(2), F.length(word) - 2), "")), ""))


@functools.lru_cache(1)
def _scrambled() -> tuple[str, dict[str, str]]:
    """A pattern of all words with the ends, the length and the letters of a target, and the first target of each shape."""
    targets, by, kinds = [w for w, in tables.rows("scrambled")], {}, {}
    for w in targets:
        by.setdefault(w[0], []).append(f"[{''.join(sorted(set(w[1:-1])))}]{{{len(w) - 2}}}{w[-1]}")
        kinds.setdefault(f"{w[0]}|{w[-1]}|{''.join(sorted(w[1:-1]))}", w)
    words = "|".join(f"{first}(?:{'|'.join(dict.fromkeys(rest))})" for first, rest in by.items())
    return f"(?i)(?<![a-z])(?:{words})(?![a-z])", kinds


def typoglycemia_text(text: Column) -> Column:
    """text with words of four and more letters, whose inner letters are those of a target word in another order, replaced: the first occurrence of each, in order of place."""
    pattern, kinds = _scrambled()
    target = lambda w: F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), _shape(F.lower(w)))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.struct(w.alias("word"), target(w).alias("target")))
    fixes = F.filter(found, lambda x: (x["target"] != F.lower(x["word"])) & (F.length(x["word"]) >= 4))

    def once(out: Column, x: Column) -> Column:
        at = F.instr(out, x["word"])
        return F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), x["target"], F.substring(out, at + F.length(x["word"]), F.length(out)))).otherwise(out)

    return F.when(text.rlike(pattern), F.aggregate(fixes, text, once)).otherwise("")


#: Fixed value: what stands for drawn letters, which have no text.
ART_MARK = "POTENTIAL_ASCII_ART_INJECTION"


def art_mark(text: Column) -> Column:
    return F.when(is_block_art(text), ART_MARK).otherwise("")


#: Decoders in order. Names are the obfuscation types; those without a function are in Python.
DECODERS: dict[str, Decoder | None] = {
    "base64": base64_text, "hex": hex_text, "url": url_text, "html_entity": html_text, "rot13": rot13_text, "homoglyph": lookalike_text, "ascii_art": vertical_text,
    "reverse": reversed_text, "unicode_tags": tag_text, "invisible": visible_text, "gzip": None, "unicode_escape": escape_text, "octal_escape": octal_text, "base32": None,
    "typoglycemia": typoglycemia_text, "leetspeak": leet_text, "block_ascii": art_mark,
}


#: Format characters that RE2 may not know as such.
_NEWER_FORMATS = r"\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{890}\x{891}\x{8E2}\x{180E}\x{110BD}\x{110CD}\x{13430}-\x{1345F}\x{1BCA0}-\x{1BCAF}\x{1D173}-\x{1D17A}"
_RUN = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}")
_UNPRINTABLE = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def _leeted(phrase: str) -> str:
    """A pattern for what becomes the phrase when leetspeak characters become letters."""
    return "".join("[" + re.escape(c + "".join(x for x, y in zip(LEET_FROM, LEET_TO) if y == c)) + "]" if c in LEET_TO else re.escape(c) for c in phrase)


def _may_attack(write: Callable[[str], str]) -> tuple[list[str], list[str]]:
    """Patterns of which one is found at least, and of which each is found else, where attack_predicate holds for a text in which phrases are written so."""
    p = tables.grouped("attack")
    any_case = lambda own: f"(?i:{'|'.join(map(write, own))})|\\x{{130}}"  # noqa: E731 (a capital I with a dot has two small characters)
    return [any_case([*p["extraction"], *p["jailbreak"], *p["exfil"]])], [any_case(p["override"]), any_case(p["instruction"])]


@functools.lru_cache(1)
def _gates() -> dict[str, list[list[str]]]:
    """For decoders that cost much: lists of RE2 patterns; where none of the lists is found whole, the decoder gives nothing."""
    turned = lambda x: re.escape(x[::-1])
    (alone, pair), (leet, leets) = _may_attack(turned), _may_attack(_leeted)
    words = _scrambled()[0].removeprefix("(?i)(?<![a-z])").removesuffix("(?![a-z])")
    drawn, blank = DRAWN[1:-1], r"(?:[\s\x{0B}\x{85}\p{Z}]*\n)?"
    line = f"[{drawn}][^\\n]*[{drawn}]"
    return {
        "hex": [[r"\\x[0-9a-fA-F]{2}|[0-9a-fA-F]{12}"]],
        "homoglyph": [["[" + LOOKALIKES + "]"]],
        "rot13": [[f"(?i:{'|'.join(ROT_STEMS)})"]],
        "reverse": [alone, pair, [r"\A[\n\r\x{85}\x{2028}\x{2029}]{0,2}[A-Za-z0-9+/=]{17,}\z"]],
        "unicode_tags": [[r"[\x{E0001}-\x{E007F}]"]],
        "invisible": [[rf"[\p{{Cf}}\x{{FE0E}}\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}\x{{20E3}}{_NEWER_FORMATS}]"]],
        "typoglycemia": [[rf"(?i)(?:\A|[^a-z])(?:{words})(?:\z|[^a-z])"]],
        "leetspeak": [leet, leets],
        "block_ascii": [[rf"{line}[^\n]*\n{blank}[^\n]*{line}[^\n]*\n{blank}[^\n]*{line}"]],
    }


#: Decoders that are asked only where a gate is open, by name.
GATED = ("base64", "hex", "homoglyph", "rot13", "reverse", "unicode_tags", "invisible", "typoglycemia", "leetspeak", "block_ascii")


def gates(texts: Column, decoders: dict[str, Decoder | None] | None = None) -> Column:
    """For an array of texts a number each, with a bit for every decoder of GATED (among the given) that may give something. Arrow searches the batch by RE2, so most texts are done with."""
    patterns, asked = _gates(), [n for n in GATED if n in (decoders or DECODERS)]
    drawn, binary, digits = np.zeros((3, 256), np.uint8)
    drawn[list(rb"|/_-\[](){}")] = binary[list(b"01 \n")] = digits[list(b"01")] = 1
    decodes: dict[str, bool] = {}

    def decodable(run: str) -> bool:
        if len(decodes) > 1 << 18:
            decodes.clear()
        try:
            decodes[run] = not _UNPRINTABLE.search(base64.b64decode(run).decode())
        except ValueError:
            decodes[run] = False
        return decodes[run]

    def has_base64(text: str | None) -> bool:
        return any(decodes[x] if x in decodes else decodable(x) for x in _RUN.findall(text or "") if len(x) % 4 == 0)

    def open_(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().fill_null("").cast(pa.string())
        n = len(flat)
        offs = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1] if n else np.zeros(1, np.int32)
        raw = flat.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offs)
        filled, bits = np.flatnonzero(sizes), np.zeros(n, np.int64)
        found = lambda p: pc.match_substring_regex(flat, p).to_numpy(zero_copy_only=False)

        def share(table: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            if len(filled):
                out[filled] = np.add.reduceat(table[data], (offs[:-1] - offs[0])[filled], dtype=np.int64) / sizes[filled]
            return out

        for name in asked:
            if name == "base64":
                hit = np.fromiter((has_base64(t) for some in _stretches(flat) for t in some.to_pylist()), bool, n)
            else:
                hit = functools.reduce(lambda a, own: a | functools.reduce(lambda x, y: x & y, map(found, own)), patterns[name], np.zeros(n, bool))
            if name == "block_ascii":
                hit |= (sizes >= 20) & ((share(drawn) > 0.4) | (share(binary) > 0.5) & (share(digits) > 0.3))
            bits |= hit.astype(np.int64) << GATED.index(name)
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(bits), mask=lists.is_null())

    return F.arrow_udf(open_, "array<bigint>")(texts)


def _stretches(texts: pa.Array, size: int = 1000):
    return (texts.slice(lo, size) for lo in range(0, len(texts), size))


def _gated(name: str, decoder: Decoder, text: Column, gate: Column) -> Column:
    """What a decoder gives; it is not asked where its gate is shut."""
    if name not in GATED or decoder is not DECODERS[name]:
        return decoder(text)
    return F.when(gate.bitwiseAND(F.lit(1 << GATED.index(name))) != 0, decoder(text)).otherwise("")


def decoded_once(rows: DataFrame, decoders: dict[str, Decoder], text_col: str = "text") -> DataFrame:
    """rows with a row for every decoder that gives something new: ord, decoder, decoded_text."""
    asked = rows.withColumn("_gate", F.get(gates(F.array(text_col), decoders), 0))
    found = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("decoder"), F.coalesce(_gated(n, f, F.col(text_col), F.col("_gate")), F.lit("")).alias("decoded_text")) for i, (n, f) in enumerate(decoders.items()) if f))
    return asked.withColumn("x", F.explode_outer(F.filter(found, lambda x: (x["decoded_text"] != "") & (x["decoded_text"] != F.col(text_col))))).filter("x is not null").select(*rows.columns, "x.*")


def _gunzipped(raw: bytes) -> str | None:
    try:
        out = zlib.decompressobj(31).decompress(raw, MOST).decode()
    except (ValueError, zlib.error):
        return None
    return out if out and all(c.isprintable() or c.isspace() for c in out) else None


def _unpacked(text: str) -> str | None:
    for run in re.findall(r"H4sI[A-Za-z0-9+/]*={0,2}", text):
        try:
            out = _gunzipped(base64.b64decode(run + "=" * (-len(run) % 4)))
        except ValueError:
            continue
        if out:
            return out
    return None


def _base32(text: str) -> str | None:
    parts = []
    for run in re.findall(r"[A-Z2-7]{8,}=*", text):
        bare = run.rstrip("=")
        try:
            out = base64.b32decode(bare + "=" * (-len(bare) % 8)).decode()
        except ValueError:
            continue
        if len(out) > 2 and all(c.isprintable() or c.isspace() for c in out):
            parts.append(out)
    return " ".join(parts) or None


def _in_python(texts: Column) -> Column:
    """For an array of texts, those in gzip and base32 of each."""

    def found(lists: pd.Series) -> pd.Series:
        one = lambda t: None if t is None else {"gzip": _unpacked(t), "base32": _base32(t)}
        return lists.map(lambda own: None if own is None else [one(t) for t in own])

    return F.pandas_udf(found, "array<struct<gzip:string,base32:string>>")(texts)


def raw_gzip_text(raw: Column) -> Column:
    """Text of gzip data in a binary column: by its magic, up to 1 MiB of printable UTF-8; null for others."""

    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else _gunzipped(bytes(x)))

    return F.pandas_udf(found, "string")(F.when(F.hex(F.substring(raw, 1, 2)) == "1F8B", raw))


def _asked(text: Column) -> Column:
    """The text if a decoder in Python may find something in it."""
    return F.when(text.contains("H4sI") | text.rlike("[A-Z2-7]{8,}"), text)


def decoded_in_python(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, decoder, decoded_text) for gzip in base64 and for base32, over the texts that may hold either."""
    some = rows.select("doc_id", _asked(F.col("text")).alias("text")).filter("text is not null").select("doc_id", F.get(_in_python(F.array("text")), 0).alias("x"))
    each = F.array(*(F.struct(F.lit(list(DECODERS).index(n)).alias("ord"), F.lit(n).alias("decoder"), F.col(f"x.{n}").alias("decoded_text")) for n in ("gzip", "base32")))
    return some.select("doc_id", F.inline(F.filter(each, lambda x: x["decoded_text"].isNotNull())))


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns, each made once a row: projections on top of one another would be merged, and what they share made again for each use."""
    names = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*names, F.inline(F.array(F.struct(*(x.alias(n) for n, x in columns.items())))))


_FOUND = "array<struct<pass:int,path:array<int>,decoder:string,decoded_text:string>>"


def traced(corpus: DataFrame, passes: int = 2, decoders: dict[str, Decoder | None] | None = None, raw_col: str | None = None) -> DataFrame:
    """corpus with found: what each pass gives, in order, as structs of pass, path (the decoders' places on the way to it), decoder and decoded_text.

    Each pass reads what the one before gave, each text once, if over three bytes. All of a text stays in its row: nothing is shuffled, joined or kept,
    and rows whose ids are null or repeat are rows each. More decoders are given by name. raw_col: a binary column beside the text, for gzip data.
    """
    decoders = decoders or DECODERS
    names = list(decoders)
    python = [n for n, f in decoders.items() if f is None]
    entry = "array<struct<path:array<int>,text:string>>"
    rows = corpus.withColumn("_now", F.array(F.struct(F.array().cast("array<int>").alias("path"), F.coalesce("text", F.lit("")).alias("text"))).cast(entry)).withColumn("found", F.array().cast(_FOUND))
    for p in range(1, passes + 1):
        if python:
            rows = _fixed(rows, _asked=F.transform("_now", lambda e: _asked(e["text"])))
            rows = rows.withColumn("_py", _in_python(F.when(F.exists("_asked", lambda t: t.isNotNull()), F.col("_asked"))))
        rows = rows.withColumn("_gates", gates(F.col("_now.text"), decoders))
        raw = raw_gzip_text(F.col(raw_col)) if raw_col and p == 1 else F.lit(None).cast("string")

        def all_of(text: Column, path: Column, own: Column | None, gate: Column, p=p) -> Column:
            made = []
            for i, n in enumerate(names):
                out = _gated(n, decoders[n], text, gate) if decoders[n] else own[n]
                if n == "gzip" and raw_col and p == 1:
                    out = F.coalesce(out, F.col("_raw"))
                made.append(F.struct(F.lit(p).alias("pass"), F.concat(path, F.array(F.lit(i))).alias("path"), F.lit(n).alias("decoder"), F.coalesce(out, F.lit("")).alias("decoded_text")))
            return F.filter(F.array(*made), lambda x: (x["decoded_text"] != "") & (x["decoded_text"] != text))

        if p == 1:
            rows = rows.withColumn("_raw", raw) if raw_col else rows
            first = F.get("_py", 0) if python else None
            new = all_of(F.coalesce("text", F.lit("")), F.array().cast("array<int>"), first, F.get("_gates", 0))
        else:
            new = F.flatten(F.transform("_now", lambda e, i: all_of(e["text"], e["path"], F.get("_py", i) if python else None, F.get("_gates", i))))
        rows = _fixed(rows, _new=new.cast(_FOUND))
        on = F.transform(F.filter("_new", lambda x: F.octet_length(x["decoded_text"]) > 3), lambda x: F.struct(x["path"].alias("path"), x["decoded_text"].alias("text")))
        rows = _fixed(rows, found=F.concat("found", "_new"), _on=on)
        if p < passes:
            rows = _fixed(rows, _now=F.filter("_on", lambda x, i: F.array_position(F.col("_on.text"), x["text"]) == i + 1))
    return rows.drop("_now", "_asked", "_py", "_gates", "_raw", "_new", "_on")


def deobfuscate(corpus: DataFrame, passes: int = 2, decoders: dict[str, Decoder | None] | None = None, raw_col: str | None = None) -> DataFrame:
    """(doc_id, pass, path, decoder, decoded_text): a row for all that traced finds."""
    return traced(corpus, passes, decoders, raw_col).select("doc_id", F.inline("found"))


def rolled(rows: DataFrame, passes: int = 2) -> DataFrame:
    """rows (of traced) with decoded_text, layers, types, segments, layer_sequence and multiplier in the place of found.

    decoded_text: the distinct outputs, without the text itself: of two passes in their order, of three those of the second, the third, the first. types: in order
    of their first output, which is their segment. layer_sequence: the first pass's types, then in each pass those that the first text that gave any gave.
    """
    found, of = F.col("found"), lambda p: F.filter("found", lambda x: x["pass"] == p)
    rows = rows.withColumn("layers", F.coalesce(F.array_max(F.transform(found, lambda x: x["pass"])), F.lit(0)))
    ordered = F.when(F.lit(passes >= 3), F.concat(F.filter(found, lambda x: x["pass"] > 1), of(1))).otherwise(found)
    return _rolled(_fixed(rows, _ordered=ordered, types=F.array_distinct(F.col("found.decoder"))), of).drop("_ordered", "found")


def _rolled(rows: DataFrame, of: Callable[[int], Column]) -> DataFrame:
    texts = F.filter(F.array_distinct(F.col("_ordered.decoded_text")), lambda t: t != F.coalesce(F.col("text"), F.lit("")))
    first = lambda t: F.get(F.filter("found", lambda x: x["decoder"] == t), 0)["decoded_text"]
    stem = lambda x, p: F.slice(x["path"], 1, p - 1)
    lead = lambda p: F.transform(F.filter(of(p), lambda x: stem(x, p) == stem(F.get(of(p), 0), p)), lambda x: x["decoder"])
    sequence = F.concat(F.transform(of(1), lambda x: x["decoder"]), lead(2), lead(3))
    return rows.withColumns(
        {
            "decoded_text": F.array_join(texts, " "),
            "segments": F.map_from_entries(F.transform("types", lambda t: F.struct(t, F.when(t == "block_ascii", "block_detected").otherwise(first(t))))),
            "layer_sequence": sequence,
            "multiplier": F.when(F.col("layers") <= 1, 1.0).when(F.col("layers") == 2, 1.1).otherwise(1.3),
        }
    )


ROLLED = ("decoded_text", "layers", "types", "segments", "layer_sequence", "multiplier")


def decoded_rollup(corpus: DataFrame, passes: int = 2, **options) -> DataFrame:
    """(doc_id, decoded_text, layers, types, segments, layer_sequence, multiplier) of the texts in which a decoder finds something."""
    rows = traced(corpus.select("doc_id", "text", *([options["raw_col"]] if options.get("raw_col") else [])), passes, **options)
    return rolled(rows.filter(F.size("found") > 0), passes).select("doc_id", *ROLLED)


#: First letter of each run of styled capitals, small letters or digits, and what it stands for.
STYLED = ((0xFF21, "A"), (0xFF41, "a"), (0xFF10, "0"), (0x1D400, "A"), (0x1D41A, "a"), (0x1D434, "A"), (0x1D44E, "a"), (0x1D538, "A"), (0x1D552, "a"), (0x24B6, "A"), (0x24D0, "a"))
_STYLED_FROM = "".join(chr(first + i) for first, c in STYLED for i in range(10 if c == "0" else 26))
_STYLED_TO = "".join(chr(ord(c) + i) for first, c in STYLED for i in range(10 if c == "0" else 26))
#: Characters written for letters: digits and signs, Cyrillic, Greek.
WRITTEN_FROM, WRITTEN_TO = "0123456789@$!+|" + "аеіорсухАВСЕНОРТХ" + "αβεηικνρτυχ", "oizeasgtbgasiti" + "aeiopcyxABCEHOPTX" + "abenikvptux"
assert len(WRITTEN_FROM) == len(WRITTEN_TO)
_BLANKS = r"[\t\n\x0B\f\r\x85\p{Z}]+"


def normalize_chain(corpus: DataFrame) -> DataFrame:
    """(doc_id, normalized, steps): format characters out, styled letters plain, substitutes mapped, spaces collapsed."""
    steps = [("remove_invisible", lambda c: F.regexp_replace(c, r"\p{Cf}", "")), ("normalize_unicode", lambda c: F.translate(c, _STYLED_FROM, _STYLED_TO)), ("char_substitution", lambda c: F.translate(c, WRITTEN_FROM, WRITTEN_TO)), ("normalize_spacing", lambda c: F.trim(F.regexp_replace(c, _BLANKS, " ")))]
    rows = corpus.select("doc_id", F.col("text").alias("_0"))
    for i, (_, f) in enumerate(steps):
        rows = rows.withColumn(f"_{i + 1}", f(F.col(f"_{i}")))
    return rows.select("doc_id", F.col(f"_{len(steps)}").alias("normalized"), F.array_compact(F.array(*(F.when(F.col(f"_{i}") != F.col(f"_{i + 1}"), F.lit(n)) for i, (n, _) in enumerate(steps)))).alias("steps"))


def normalize_nfkc(corpus: DataFrame) -> DataFrame:
    """corpus with text in compatibility form and whether that changed it. Spark has no such function, so texts go through Arrow.

    From there only texts come back that are changed, and a batch is taken in stretches, so little is held beside it.
    """

    def nfkc(texts: pa.Array) -> pa.Array:
        out = []
        for some in _stretches(texts, 100):
            kept = [t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in some.to_pylist()]
            out.append(pc.if_else(pc.equal(some, made := pa.array(kept, pa.string())), pa.scalar(None, pa.string()), made))
        return pa.chunked_array(out, pa.string()).combine_chunks()

    # Plain ASCII is in that form already.
    other = F.arrow_udf(nfkc, "string")(F.when(F.col("text").rlike(r"[^\x00-\x7F]"), F.col("text")))
    return corpus.withColumn("normalized", F.coalesce(other, F.col("text"))).withColumn("was_normalized", F.col("normalized") != F.col("text"))


#: Characters that letters are drawn with.
DRAWN = r"[|/_\-\\\[\](){}]"


def is_block_art(text: Column) -> Column:
    """From 20 bytes on: three dense lines in a row (blank ones aside), over 0.4 of all bytes drawn, or text in noughts and ones. Lines of over five bytes are dense over 0.3."""
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    bare = lambda x: F.regexp_replace(x, f"^{_BLANKS}|{_BLANKS}$", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.octet_length(bare(x)).alias("n")))
    dense = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: F.when((x["n"] > 5) & (count(x["line"], DRAWN) / x["n"] > 0.3), F.lit("1")).otherwise("0"))
    n = F.octet_length(text)
    binary = (count(text, r"[01 \n]") / n > 0.5) & (count(text, "[01]") / n > 0.3) & (n > 20)
    # A dense line has two drawn characters or more, so most texts need no look at their lines.
    drawn = count(text, DRAWN)
    return F.when(n < 20, False).otherwise((drawn / n > 0.4) | binary | ((drawn >= 6) & F.array_join(dense, "").contains("111")))


def block_art(corpus: DataFrame) -> DataFrame:
    """(doc_id, is_art)."""
    return corpus.select("doc_id", is_block_art(F.col("text")).alias("is_art"))


def unscrambled(corpus: DataFrame) -> DataFrame:
    """(doc_id, decoded_text) of the texts with scrambled words."""
    return corpus.select("doc_id", "text", typoglycemia_text(F.col("text")).alias("decoded_text")).filter("decoded_text not in ('', text)").drop("text")
