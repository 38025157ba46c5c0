"""Predicates and heuristic scores over a text column."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import any_of, counts_of, looked_up, matched, matches, matches_of, one_pass, standing
from textward.operators.scan import crypto_score

#: Order in which rule families are asked.
FAMILIES = ("persona", "buried", "extraction", "multi_turn", "policy", "flip", "markup", "tool")
#: Characters that stand for letters.
LEET_FROM, LEET_TO = "130@$", "ieoas"
#: Tripwire strings; a parameter of canary_filter.
CANARIES = ("8f4b2e1a-9c3d-5e7f", "project_zero_access_code")

_SPACE = "[\\t\\n\\x0B\\f\\r\\x20\\x85\\xA0]"


def attack_predicate(text: Column) -> Column:
    """Override word and instruction word, or a phrase of extraction, jailbreak or exfiltration. One pattern a list, so the lower-case text is made few times."""
    low, p = F.lower(text), tables.grouped("attack")
    return low.rlike(one_pass([*p["extraction"], *p["jailbreak"], *p["exfil"]])) | (low.rlike(one_pass(p["override"])) & low.rlike(one_pass(p["instruction"])))


def asks_for_prompt(text: Column) -> Column:
    return counts_of(F.lower(text), tables.grouped("blocklist"))["blocklist"] > 0


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def substantive(text: Column) -> Column:
    """Over twelve words; or seven and more with a security word."""
    n = F.size(words(text))
    return F.when(n <= 6, False).when(n > 12, True).otherwise(any_of(F.lower(text), tables.grouped("substantive")["substantive"]))


def canary_hit(text: Column, canaries: tuple[str, ...] = CANARIES) -> Column:
    return any_of(text, list(canaries))


def family_best(corpus: DataFrame, family: str) -> DataFrame:
    """(doc_id, text, score, label) of a rule family: the largest score, the first rule of it; 0 and null without a hit."""
    chosen = [r for r in tables.rows("input_tiers") if r[0] == family]
    chosen = sorted(enumerate(chosen), key=lambda x: (-float(x[1][1]), x[0]))
    low = corpus.withColumn("_low", F.lower("text"))
    best = F.coalesce(*(F.when(matches(F.col("text"), F.col("_low"), r[3]), F.struct(F.lit(float(r[1])).alias("score"), F.lit(r[2]).alias("label"))) for _, r in chosen))
    return low.withColumn("_best", best).select("doc_id", "text", F.coalesce(F.col("_best.score"), F.lit(0.0)).alias("score"), F.col("_best.label").alias("label"))


def tier(text: Column, low: Column, families: tuple[str, ...] = FAMILIES, maybe: Column | None = None) -> Column:
    """struct(family, score) of the first family with a hit; the tool family counts from 0.7 on and is mapped to 0.75 and up. maybe: numbers of rules that may hit."""
    every, out = list(enumerate(tables.rows("input_tiers"))), []
    hits = matched(text, [r[3] for _, r in every]) if maybe is None else None
    asked = lambda i, regex: F.array_contains(hits, i) if maybe is None else matches_of(text, maybe, i, regex)
    for family in families:
        own = sorted((r for r in every if r[1][0] == family), key=lambda r: -float(r[1][1]))
        for score in dict.fromkeys(float(r[1]) for _, r in own):
            if family == "tool" and score < 0.7:
                continue
            hit = functools.reduce(lambda a, b: a | b, (asked(i, r[3]) for i, r in own if float(r[1]) == score))
            out.append(F.when(hit, F.struct(F.lit(family).alias("family"), F.lit(0.75 + (score - 0.7) * 0.67 if family == "tool" else score).alias("score"))))
    return F.coalesce(*out)


def entropy(text: Column, per_byte: bool) -> Column:
    """Shannon bits over characters; shares are of the text's bytes or of its characters. Null and empty texts have none (0).

    Characters of all texts of an Arrow batch are counted at once, by sorting: linear but for the sort, however many different ones there are.
    In column functions a text would be searched once for each.
    """

    def bits(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        filled = texts.fillna("").tolist()
        sizes = np.array([len(t) for t in filled], np.int64)
        stops = np.cumsum(sizes)
        lo = 0
        while lo < len(filled):  # some million characters at a time
            hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + (1 << 22), side="right")))
            codes = np.frombuffer("".join(filled[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            key, counts = np.unique(codes + (np.repeat(np.arange(hi - lo), sizes[lo:hi]) << 21), return_counts=True)
            row = key >> 21
            total = np.array([len(t.encode("utf-8", "surrogatepass")) for t in filled[lo:hi]]) if per_byte else sizes[lo:hi]
            p = counts / total[row]
            out[lo:hi] = np.bincount(row, weights=-p * np.log2(p), minlength=hi - lo)
            lo = hi
        return pd.Series(out)

    return F.pandas_udf(bits, "double")(text)


def blanks(text: Column) -> Column:
    """Number of white-space characters (0 for null), counted in Arrow batches: a pattern would cut out each."""

    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(map(t.count, "\t\n\x0b\f\r\x20\x85\xa0")) for t in texts.fillna("")], dtype="int64")

    return F.pandas_udf(counted, "long")(text)


def compressed(text: Column, spaces: Column | None = None) -> Column:
    """text, and after it the text without white space if over a quarter of its bytes are white space. spaces: the number of its blanks."""
    spaces = blanks(text) if spaces is None else spaces
    return F.when((F.octet_length(text) > 10) & (spaces > F.floor(F.octet_length(text) / 4)), F.concat(text, F.lit(" "), F.regexp_replace(text, _SPACE, ""))).otherwise(text)


#: Fixed value: a character that stands for a letter, between letters.
LEET = r"[\p{L}@$][013][\p{L}@$]|\p{L}[@$]\p{L}"


def has_leet(text: Column) -> Column:
    return text.rlike(LEET)


def unleeted(text: Column) -> Column:
    plain = F.translate(text, LEET_FROM, LEET_TO)
    return F.when(has_leet(text) & (plain != text), F.concat(text, F.lit(" "), plain)).otherwise(text)


#: Characters that become blanks.
BLANKED = '{}":,[]'


def cleaned(text: Column) -> Column:
    return F.translate(text, BLANKED, " " * len(BLANKED))


def built_in_keywords() -> list[tuple[str, float]]:
    return [(k, float(w)) for k, w in tables.rows("keywords")]


def keyword_score(rows: DataFrame, text_col: str, out: str, keywords: list[tuple[str, float]] | None = None) -> DataFrame:
    """rows with out: weights of one-word keywords for every token of text_col (cleaned already) that holds them, and of phrases once."""
    return rows.withColumn(out, looked_up(F.lower(text_col), keywords or built_in_keywords())["points"])


#: One of these stands in every text with a bonus.
SECRET_LITERALS = ("AKIA", "sk-", "sk_live_", "rk_live_", "sk_test_", "AIza", "xoxb-", "xoxp-", "/etc/shadow", "/etc/passwd", "id_rsa")


def secret_bonus(text: Column) -> Column:
    """Fifty points for each of six tests on keys and system paths."""
    n, has = F.octet_length(text), text.contains
    tests = [has("AKIA") & (n > 20), has("sk-") & (has("sk-proj-") | (n > 40)), has("sk_live_") | has("rk_live_") | has("sk_test_"), has("AIza") & (n > 35), has("xoxb-") | has("xoxp-"), has("/etc/shadow") | has("/etc/passwd") | has("id_rsa")]
    return functools.reduce(lambda a, b: a + b, (F.when(t, F.lit(50.0)).otherwise(0.0) for t in tests))


def foreign_penalty(text: Column, score: Column) -> Column:
    # Three characters beyond ASCII; each takes two bytes or more.
    foreign = (F.octet_length(text) - F.length(text) > 2) & text.rlike(r"(?:[^\x00-\x7F][\x00-\x7F]*){3}")
    return F.when((score > 0.3) & foreign, score + 1.5).otherwise(score)


def logistic(score: Column) -> Column:
    return F.when(score == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-score + 0.5)))


def heuristic_score(corpus: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """(doc_id, heuristic_score, heuristic_path). decoded: (doc_id, decoded_text) that is appended before scoring."""
    if decoded is not None:
        corpus = corpus.join(decoded, "doc_id", "left").select("doc_id", F.when((F.col("decoded_text") != "") & (F.col("decoded_text") != F.col("text")), F.concat_ws(" ", "text", "decoded_text")).otherwise(F.col("text")).alias("text"))
    text, t = F.col("text"), F.col("_t")
    step = corpus.select("doc_id", "text", entropy(F.when(F.octet_length(text) > 50, text), True).alias("_bits"), blanks(text).alias("_blanks"))
    step = step.withColumn("_t", compressed(text, F.col("_blanks"))).withColumn("_t", unleeted(t)).withColumn("_t", cleaned(t))
    # One look at the tokens tells the keywords' points, the rules that may hit (the text begins what is looked at) and whether a key or tripwire may stand there.
    literals = (*(k for k, _ in tables.rows("crypto")), *SECRET_LITERALS, *CANARIES)
    step = step.withColumn("_look", looked_up(F.lower(t), built_in_keywords(), tuple(r[3] for r in tables.rows("input_tiers")), literals, BLANKED))
    step = step.select("doc_id", "text", "_t", "_bits", F.col("_look.points").alias("_points"), F.col("_look.maybe").alias("_maybe"), F.col("_look.some").alias("_some"))
    families = lambda own: F.when(F.size("_maybe") > 0, tier(text, F.lower(text), own, F.col("_maybe")))
    step = step.select("doc_id", "_t", "_some", families(FAMILIES[:6]).alias("_a"), F.when(F.col("_bits") > 5.8, F.lit(0.95)).alias("_e"), families(FAMILIES[6:]).alias("_b"), (F.when(F.col("_some"), crypto_score(t) + secret_bonus(t)).otherwise(0.0) + F.col("_points")).alias("_raw"))
    score = F.coalesce(F.col("_a.score"), F.col("_e"), F.col("_b.score"), F.when(F.col("_some") & canary_hit(t), 1.0), logistic(foreign_penalty(t, F.col("_raw"))))
    path = F.coalesce(F.col("_a.family"), F.when(F.col("_e").isNotNull(), "entropy"), F.col("_b.family"), F.lit("keywords"))
    return step.select("doc_id", score.alias("heuristic_score"), path.alias("heuristic_path"))


def domain_keywords(text: Column) -> Column:
    """Discountable keywords that stand in the text, sorted."""
    names = sorted({k for k, _, _ in tables.rows("domain_discounts")})
    return standing(F.lower(text), names)


def benign_discount(text: Column, phrases: list[tuple[str, float]]) -> Column:
    """Sum of the (negative) weights of benign phrases, -0.65 at least."""
    low = F.lower(text)
    return F.greatest(functools.reduce(lambda a, b: a + b, (F.when(low.contains(p), F.lit(w)).otherwise(0.0) for p, w in phrases), F.lit(0.0)), F.lit(-0.65))


