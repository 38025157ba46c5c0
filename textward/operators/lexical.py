"""Lexical anomaly signals: characters, entropy, scripts, structure and benign vocabulary."""

from __future__ import annotations

import functools
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import _TOKEN, _stretches, ascii_counts, count_of, counts_of, standing
from textward.operators.heuristics import entropy, words

_SPACE = "[\\t\\n\\x0B\\f\\r\\x20\\x85\\xA0]"


def char_profile(corpus: DataFrame) -> DataFrame:
    """doc_id with shares of symbols and digits, invisible characters and the anomaly score."""
    # Patterns are asked only of the characters beyond ASCII: a pattern's matches are cut out one by one.
    count = lambda p: F.when(F.col("_x.rest") == "", 0).otherwise(F.regexp_count("_x.rest", F.lit(p)))
    c = corpus.select("doc_id", F.length("text").alias("n"), ascii_counts(F.col("text"), {"letters": string.ascii_letters, "digits": string.digits, "spaces": "\t\n\x0b\f\r "}).alias("_x"))
    c = c.select("doc_id", "n", "_x", count(r"\p{L}").alias("foreign"), count(r"\p{Nd}").alias("_d"), count("[\x85\xA0]").alias("_s"), count(r"\p{Cf}").alias("invisible"), count(r"\p{IsLatin}").alias("_l"), count(r"[\p{IsCyrillic}\p{IsGreek}]").alias("confusable"))
    x = lambda a, b: (F.col(f"_x.{a}") + F.col(b)).cast("int")
    c = c.select("doc_id", "n", x("letters", "foreign").alias("letters"), x("digits", "_d").alias("digits"), x("spaces", "_s").alias("spaces"), "invisible", x("letters", "_l").alias("latin"), "confusable", "foreign")
    col = F.col
    c = c.withColumn("symbols", col("n") - col("letters") - col("digits") - col("spaces") - col("invisible"))
    share = lambda x: F.when(col("n") > 0, col(x) / col("n")).otherwise(0.0)
    c = c.withColumn("symbol_ratio", share("symbols")).withColumn("digit_ratio", share("digits"))
    mixed = (col("latin") > 0) & (col("confusable") > 0) & (col("latin") > 0.2 * col("letters")) & (col("confusable") > 0.05 * col("letters"))
    parts = [
        F.when(col("symbol_ratio") > 0.15, col("symbol_ratio") * 2),
        F.when(col("digit_ratio") > 0.25, col("digit_ratio") * 1.5),
        F.when(col("invisible") > 0, F.least(0.5 + share("invisible") * 2, F.lit(1.0))),
        F.when(mixed, share("foreign")),
    ]
    score = F.least(functools.reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)), F.lit(1.0))
    return c.select("doc_id", "letters", "digits", "symbols", "invisible", F.round("symbol_ratio", 6).alias("symbol_ratio"), F.round("digit_ratio", 6).alias("digit_ratio"), F.round(score, 6).alias("anomaly_score"))


def entropy_anomaly(corpus: DataFrame, usual: float = 4.5, between: float = 1.0) -> DataFrame:
    """doc_id with entropy and the anomaly score (null where entropy is near the usual, or the text under 25 bytes)."""
    n = F.octet_length("text")
    limit = F.when(n < 50, 2.5).when(n < 100, 1.5).when(n > 200, 0.3).otherwise(between)
    rows = corpus.select("doc_id", n.alias("n"), entropy(F.col("text"), False).alias("h"), limit.alias("limit"))
    off = F.abs(F.col("h") - usual)
    return rows.select("doc_id", F.round("h", 6).alias("entropy"), F.round(F.when((F.col("n") >= 25) & (off > F.col("limit")), F.least(off / 2, F.lit(1.0))), 6).alias("anomaly_score"))


def benign_context(text: Column) -> Column:
    """Credits of benign vocabulary, three a group at most, 0.4 each."""
    p = tables.grouped("benign")
    n = counts_of(F.lower(text), p)
    return functools.reduce(lambda a, b: a + b, (F.least(n[g], F.lit(3)) for g in p)) * F.lit(0.4)


def structure_flags(corpus: DataFrame) -> DataFrame:
    """doc_id with structural patterns and their score."""
    corpus = corpus.select("doc_id", "text", ascii_counts(F.col("text"), STRUCTURE_CLASSES).alias("_x"))
    found, score = structure_tests(F.col("text"), F.col("_x"))
    return corpus.select("doc_id", found.alias("patterns"), score.alias("structure_score"))


#: What structure_tests reads of a text, by ascii_counts.
STRUCTURE_CLASSES = {"quotes": "\"'`", "brackets": "{}[]"}


def structure_tests(text: Column, counts: Column) -> tuple[Column, Column]:
    """Structural patterns of a text and their score."""
    has, n = text.contains, F.octet_length(text)
    tests = [
        ("deep_nesting", 0.2, counts["quotes"] > 2),
        ("code_block", 0.15, has("```")),
        ("comment_markers", 0.1, functools.reduce(lambda a, b: a | b, map(has, ("<!--", "-->", "/*", "*/", "//", "#")))),
        ("policy_structure", 0.25, functools.reduce(lambda a, b: a | b, map(has, ("<policy", "<system", '"safety"', '"restrictions"')))),
        ("high_brackets", 0.15, F.when(n > 0, counts["brackets"] / n > 0.1).otherwise(False)),
    ]
    found = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, _, t in tests)))
    score = functools.reduce(lambda a, b: a + b, (F.when(t, F.lit(w)).otherwise(0.0) for _, w, t in tests))
    return found, F.round(score, 6)


def mixed_script_tokens(corpus: DataFrame) -> DataFrame:
    """doc_id with the words that mix Latin letters with Cyrillic or Greek ones."""
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    mixed = F.filter(tokens, lambda t: t.rlike(r"\p{IsLatin}") & t.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
    # Most texts have no letter of the other scripts.
    other = F.col("text").rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    return corpus.select("doc_id", F.when(other, mixed).otherwise(F.when(F.col("text").isNotNull(), F.array().cast("array<string>"))).alias("tokens"))


#: Words that a worker remembers with their likes.
_KNOWN = 1 << 18


def _edits(a: str, b: str, most: int) -> int:
    """Edits between two words, or more than `most`."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
        if min(row) > most:
            return most + 1
    return row[-1]


def _letters(words: list[str]) -> np.ndarray:
    """How often each of 32 groups of characters stands in each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    return np.bincount(np.repeat(np.arange(len(words)), sizes) * 32 + codes, minlength=32 * len(words)).reshape(len(words), 32).astype(np.int16)


def _likes(words: list[str], wanted: list[str]) -> dict[str, list[tuple[str, float]]]:
    """For words that are similar to any by more than 0.7: the wanted words, and how similar. Edits are at least the characters that one word lacks of the other."""
    out: dict[str, list[tuple[str, float]]] = {}
    theirs, m = _letters(wanted), np.array([len(w) for w in wanted])
    for lo in range(0, len(words), 4096):
        some = words[lo : lo + 4096]
        own, n = _letters(some), np.array([len(w) for w in some])
        longest = np.maximum(n[:, None], m)
        most = (longest * 0.3 + 1e-9).astype(np.int64)
        near = np.argwhere(np.abs(n[:, None] - m) <= most)
        lack = longest[near[:, 0], near[:, 1]] - np.minimum(own[near[:, 0]], theirs[near[:, 1]]).sum(axis=1)
        for i, j in near[lack <= most[near[:, 0], near[:, 1]]].tolist():
            size = int(longest[i, j])
            sim = 1 - _edits(some[i], wanted[j], int(most[i, j])) / size
            if sim > 0.7:
                out.setdefault(some[i], []).append((wanted[j], sim))
    return out


def _first_like(low: Column, wanted: list[str]) -> Column:
    """map of anchor words to the similarity of the text's first word that is like it; words of over four bytes count."""
    known: set[str] = set()
    like: dict[str, list[tuple[str, float]]] = {}

    def found(texts: pa.Array) -> pa.Array:
        offsets, keys, sims = [0], [], []
        for some in _stretches(texts.fill_null("").to_pylist()):
            every = [dict.fromkeys(_TOKEN.findall(t)) for t in some]
            if len(known) > _KNOWN:
                known.clear()
                like.clear()
            new = set().union(*every) - known
            like.update(_likes([w for w in new if len(w.encode()) > 4], wanted))
            known.update(new)
            for tokens in every:
                own: dict[str, float] = {}
                if not like.keys().isdisjoint(tokens):
                    for anchor, sim in (x for t in tokens if t in like for x in like[t]):
                        own.setdefault(anchor, sim)
                keys += own
                sims += own.values()
                offsets.append(len(keys))
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(sims, pa.float64()))

    return F.arrow_udf(found, "map<string,double>")(low)


def anchor_match(corpus: DataFrame) -> DataFrame:
    """doc_id with the best threat category, its score, the number of its anchor phrases (phrases), and the damping by benign vocabulary (damp).

    The score: 0.5 an anchor phrase, 0.15 by similarity for the first like word of an anchor word, damped.
    Distinct words of an Arrow batch are compared with anchor words once, within their length band: no word leaves its text's row.
    """
    p = tables.grouped("anchor")
    rows = corpus.select("doc_id", "text", F.lower("text").alias("low"))
    wanted = sorted({w for a in p.values() for x in a for w in x.split() if len(w.encode()) > 4})
    damp = F.greatest(1 - F.least(benign_context(F.col("text")), F.lit(1.0)) * 0.75, F.lit(0.25))
    joined = rows.select("doc_id", F.coalesce(_first_like(F.col("low"), wanted), F.create_map().cast("map<string,double>")).alias("sims"), standing(F.col("low"), sorted({a for own in p.values() for a in own})).alias("stand"), damp.alias("damp"))

    def category(name: str) -> Column:
        total = F.lit(0.0)
        for anchor in p[name]:
            meaningful = [w for w in anchor.split() if len(w.encode()) > 4]
            found = [F.coalesce(F.try_element_at("sims", F.lit(w)), F.lit(0.0)) for w in meaningful]
            total = total + F.when(F.array_contains("stand", anchor), 0.5).otherwise(0.0)
            for s in found:
                total = total + s * 0.15
            if len(meaningful) > 1:
                total = total + F.when(functools.reduce(lambda a, b: a + b, ((s > 0).cast("int") for s in found)) >= len(meaningful) - 1, 0.2).otherwise(0.0)
        return F.least(total, F.lit(1.0))

    best = F.array_min(F.array(*(F.struct((-F.round(category(g), 6)).alias("s"), F.lit(g).alias("g")) for g in sorted(p))))
    joined = joined.withColumn("_b", best)
    score = -F.col("_b.s")
    phrases = functools.reduce(lambda c, g: c.when(F.col("_b.g") == g, F.size(F.array_intersect("stand", F.array(*map(F.lit, p[g]))))), sorted(p), F.when(F.lit(False), F.lit(0)))
    return joined.select("doc_id", F.when(score > 0, F.col("_b.g")).alias("category"), F.round(score * F.col("damp"), 6).alias("score"), F.when(score > 0, phrases).otherwise(0).alias("phrases"), "damp")


#: Scripts whose first character decides the language of a seed.
SEED_SCRIPTS = ((r"\x{4E00}-\x{9FFF}", "zh"), (r"\x{3040}-\x{30FF}", "ja"), (r"\x{AC00}-\x{D7AF}", "ko"), (r"\x{0600}-\x{06FF}", "ar"), (r"\x{0590}-\x{05FF}", "he"), (r"\x{0400}-\x{04FF}", "ru"), (r"\x{0900}-\x{097F}", "hi"))
#: Words that decide for accented Latin texts, in order.
SEED_WORDS = (("ignoriere|zeige", "de"), ("ignora|toutes", "fr"), ("olvida", "es"), ("ignorar|esqueça", "pt"))


def seed_language(text: Column) -> Column:
    """Language by the first character of a listed script, else by words of accented texts, else en."""
    first = F.regexp_extract(text, "[" + "".join(r for r, _ in SEED_SCRIPTS) + "]", 0)
    by_script = functools.reduce(lambda c, x: c.when(first.rlike(f"[{x[0]}]"), x[1]), SEED_SCRIPTS, F.when(F.lit(False), ""))
    low = F.lower(text)
    by_word = functools.reduce(lambda c, x: c.when(low.rlike(x[0]), x[1]), SEED_WORDS, F.when(F.lit(False), ""))
    return F.coalesce(by_script, F.when(text.rlike(r"[\x{C0}-\x{17F}]"), by_word), F.lit("en"))


def code_switching(corpus: DataFrame) -> DataFrame:
    """doc_id with the script families in order of first use and the number of changes between them."""
    letters = F.col("text")
    for pattern, mark in ((r"\p{IsLatin}", "1"), (r"\p{IsCyrillic}", "2"), (r"\p{IsGreek}", "3"), (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "4"), (r"\p{IsArabic}", "5")):
        letters = F.regexp_replace(letters if mark != "1" else F.regexp_replace(letters, r"\p{Nd}", ""), pattern, mark)
    runs = F.regexp_replace(F.regexp_replace(letters, "[^1-5]", ""), r"([1-5])\1+", "$1")
    return corpus.select("doc_id", runs.alias("r")).select("doc_id", F.array_join(F.array_distinct(F.filter(F.split("r", ""), lambda x: x != "")), "").alias("families"), F.greatest(F.length("r") - 1, F.lit(0)).alias("switches"))


def combine_lexical(signals: DataFrame, threat: float = 0.4) -> DataFrame:
    """(doc_id, score, is_threat): mean by confidence, raised for two signals and more for three. signals: doc_id, score, confidence."""
    rows = signals.filter("score > 0").groupBy("doc_id").agg(F.sum(F.col("score") * F.col("confidence")).alias("a"), F.sum("confidence").alias("b"), F.count("*").alias("n"))
    score = F.least(F.col("a") / F.col("b") * F.when(F.col("n") >= 3, 1.4).when(F.col("n") == 2, 1.2).otherwise(1.0), F.lit(1.0))
    return rows.select("doc_id", score.alias("score"), (score >= threat).alias("is_threat"))


def fuzzy_match(corpus: DataFrame, phrases: list[str], tolerance: float = 0.2) -> DataFrame:
    """(doc_id, phrase, score) of the first phrase of whose words at least 0.8 are near some word of the text: within a share of the phrase word's bytes in edits.

    Each text's distinct words are compared in place; lengths rule most of them out before any edits are counted.
    """
    low = [" ".join(p.lower().split()) for p in phrases]
    wanted = sorted({w for p in low for w in p.split()})
    rows = corpus.select("doc_id", F.array_distinct(words(F.lower("text"))).alias("w"))

    def near(word: str) -> Column:
        most = int(len(word.encode()) * tolerance)
        return F.exists("w", lambda t: (F.abs(F.length(t) - len(word)) <= most) & (F.levenshtein(t, F.lit(word), most) >= 0))

    flags = rows.select("doc_id", F.create_map(*(x for w in wanted for x in (F.lit(w), near(w)))).alias("m"))
    chosen = []
    for phrase, plain in zip(phrases, low):
        own = plain.split()
        if own:
            share = functools.reduce(lambda a, b: a + b, (F.element_at("m", F.lit(w)).cast("int") for w in own)) / len(own)
            chosen.append(F.when(share >= 0.8, F.struct(F.lit(phrase).alias("phrase"), share.alias("score"))))
    return flags.withColumn("x", F.coalesce(*chosen)).filter("x is not null").select("doc_id", "x.phrase", "x.score")


def ranked_categories(corpus: DataFrame) -> DataFrame:
    """(doc_id, category, score, rank) of all threat categories: 0.3 an anchor phrase, 0.1 by similarity for every like pair of anchor word and text word; 1 at most, ties by name."""
    p = tables.grouped("anchor")
    pairs = [(g, w) for g in sorted(p) for a in p[g] for w in a.split()]
    targets = corpus.sparkSession.createDataFrame([(w, len(w)) for w in sorted({w for _, w in pairs})], "anchor_word string, m int")
    weights = corpus.sparkSession.createDataFrame(pairs, "category string, anchor_word string").groupBy("category", "anchor_word").agg(F.count("*").alias("times"))
    counts = corpus.select("doc_id", F.explode(words(F.lower("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    distinct = counts.select("word").distinct().withColumn("len", F.length("word"))
    # Similar by more than 0.7, so lengths differ by less than three tenths; only words that can be like an anchor word go on.
    banded = distinct.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("len") * 0.7)).cast("int"), F.ceil(F.col("len") / 0.7).cast("int"))))
    like = banded.join(F.broadcast(targets), "m").withColumn("sim", 1 - F.levenshtein("word", "anchor_word") / F.greatest("len", "m")).filter("sim > 0.7")
    near = counts.join(like.select("word", "anchor_word", "sim"), "word").groupBy("doc_id", "anchor_word").agg(F.sum(F.col("n") * F.col("sim")).alias("s"))
    parts = near.join(F.broadcast(weights), "anchor_word").groupBy("doc_id", "category").agg(F.sum(F.col("s") * F.col("times") * 0.1).alias("words"))
    low = corpus.select("doc_id", F.lower("text").alias("low"))
    phrases = low.select("doc_id", F.inline(F.array(*(F.struct(F.lit(g).alias("category"), (count_of(F.col("low"), p[g]) * 0.3).alias("phrases")) for g in sorted(p)))))
    rows = phrases.join(parts, ["doc_id", "category"], "left").select("doc_id", "category", F.round(F.least(F.col("phrases") + F.coalesce("words", F.lit(0.0)), F.lit(1.0)), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "category")))
