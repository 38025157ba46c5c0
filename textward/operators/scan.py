"""Rule scans, output verdicts and redaction over a corpus (doc_id, text)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import java, matched

#: A rule: name, category, severity, description, regex (RE2).
Rule = tuple[str, str, str, str, str]

#: Categories of the default output scan, in the order in which they are asked.
OUTPUT_CATEGORIES = ("credential", "injection_attack", "indirect_injection", "path_traversal", "exfiltration", "network_recon", "privilege_escalation", "deserialization")


def rules(categories: tuple[str, ...] | list[str] | None = None) -> list[Rule]:
    """Built-in rules of the categories, in the categories' order, then in registration order."""
    every = [*tables.rows("output_rules"), *tables.rows("input_rules")]
    if categories is None:
        return every
    return [r for c in categories for r in every if r[1] == c]


def with_hits(corpus: DataFrame, chosen: list[Rule]) -> DataFrame:
    """corpus with `hits`: numbers of the rules that match, ascending."""
    return corpus.withColumn("hits", matched(F.col("text"), [r[4] for r in chosen]) if chosen else F.array().cast("array<int>"))


def _literal_array(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def match_all(corpus: DataFrame, chosen: list[Rule]) -> DataFrame:
    """(doc_id, ord, name, category, severity, description, text): a row for every rule that matches."""
    # By explode_outer, as from explode Spark infers a filter, for which the rules would be asked once more.
    found = with_hits(corpus, chosen).select("doc_id", "text", F.explode_outer("hits").alias("ord")).filter("ord is not null")
    pick = lambda k, kind: F.element_at(_literal_array([r[k] for r in chosen], kind), F.col("ord") + 1)
    return found.select("doc_id", "ord", pick(0, "string").alias("name"), pick(1, "string").alias("category"), pick(2, "int").alias("severity"), pick(3, "string").alias("description"), "text")


def match_any(corpus: DataFrame, chosen: list[Rule]) -> DataFrame:
    """(doc_id, name, description) of the first rule that matches; nulls where none does."""
    first = with_hits(corpus, chosen).withColumn("first", F.get("hits", 0))
    pick = lambda k: F.when(F.col("first").isNotNull(), F.get(_literal_array([r[k] for r in chosen], "string"), F.col("first")))
    return first.select("doc_id", "text", pick(0).alias("name"), pick(3).alias("description"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 100, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")


def action(score: Column, warn: float, block: float) -> Column:
    return F.when(score >= block, "BLOCK").when(score >= warn, "WARN").otherwise("ALLOW")


def scan_output(corpus: DataFrame, chosen: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdict of every text: safe or not, summed severity, level, categories and findings. Under ten bytes nothing is tried and the level is empty. keep: columns that stay."""
    low = with_hits(corpus, chosen)
    tried = F.octet_length("text") >= 10
    hits = F.when(tried, F.col("hits")).otherwise(F.array().cast("array<int>"))
    names, severities, categories = (_literal_array([r[k] for r in chosen], kind) for k, kind in ((0, "string"), (2, "int"), (1, "string")))
    out = low.select("doc_id", *keep, tried.alias("tried"), hits.alias("hits"))
    out = out.withColumn("risk_score", F.aggregate("hits", F.lit(0), lambda a, i: a + F.element_at(severities, i + 1)))
    return out.select(
        "doc_id",
        *keep,
        (F.size("hits") == 0).alias("is_safe"),
        "risk_score",
        F.when(F.col("tried"), risk_level(F.col("risk_score"))).otherwise("").alias("risk_level"),
        F.transform("hits", lambda i: F.element_at(names, i + 1)).alias("findings"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda i: F.element_at(categories, i + 1)))).alias("categories"),
    )


def excerpts(corpus: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Findings with the matched text: credentials keep four characters at each end, others are cut to fifty."""
    found = match_all(corpus, chosen)
    match = functools.reduce(lambda c, r: c.when(F.col("ord") == r[0], F.regexp_extract("text", java(r[1][4]), 0)), enumerate(chosen), F.when(F.lit(False), ""))
    found = found.withColumn("match", match)
    m = F.col("match")
    shown = F.when((F.col("category") == "credential") & (F.octet_length(m) <= 10), "[REDACTED]").when(F.col("category") == "credential", F.concat(F.left(m, F.lit(4)), F.lit("..."), F.right(m, F.lit(4)), F.lit("[REDACTED]")))
    shown = shown.when(F.octet_length(m) > 50, F.concat(F.left(m, F.lit(47)), F.lit("..."))).otherwise(m)
    found = found.withColumn("excerpt", shown)
    short = F.when(F.octet_length("excerpt") > 30, F.concat(F.left("excerpt", F.lit(27)), F.lit("..."))).otherwise(F.col("excerpt"))
    return found.select("doc_id", "name", "category", "severity", "excerpt", F.concat("description", F.lit(": "), short).alias("finding"))


def redactors() -> tuple[list[tuple[str, str]], str, str]:
    """Ordered (kind, regex), then the address pattern and the version pattern that stops it."""
    every = list(tables.rows("redactors"))
    return every[:-2], every[-2][1], every[-1][1]


def redact(text: Column) -> Column:
    """text with secrets replaced by [KIND_REDACTED], one kind after the other; addresses last, unless a version number stands anywhere."""
    ordered, address, version = redactors()
    for kind, regex in ordered:
        text = F.regexp_replace(text, java(regex), f"[{kind}_REDACTED]")
    return text


def has_secrets(text: Column) -> Column:
    """Whether redact changes the text: the first pattern that is found in it does."""
    return F.size(matched(text, [regex for _, regex in redactors()[0]])) > 0


def redact_secrets(corpus: DataFrame) -> DataFrame:
    """(doc_id, redacted, was_redacted)."""
    _, address, version = redactors()
    once = corpus.select("doc_id", "text", redact(F.col("text")).alias("_r"))
    last = F.when(F.col("_r").rlike(java(version)), F.col("_r")).otherwise(F.regexp_replace("_r", java(address), "[IP_ADDRESS_REDACTED]"))
    return once.select("doc_id", "text", last.alias("redacted")).select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("was_redacted"))


def redaction_counts(corpus: DataFrame) -> DataFrame:
    """(kind, texts, places) over the corpus: how often each kind of secret stands in the original texts."""
    ordered, address, _ = redactors()
    kinds = [*ordered, ("IP_ADDRESS", address)]
    counts = corpus.select(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(java(r))).alias("n")) for k, r in kinds)).alias("x"))
    return counts.select(F.inline("x")).groupBy("kind").agg(F.sum((F.col("n") > 0).cast("long")).alias("texts"), F.sum("n").alias("places"))


def crypto_score(text: Column, literals: tuple = ()) -> Column:
    """Points for cryptographic material: 50 for any literal that is worth it, else the sum, 50 at most."""
    table = literals or [(k, float(v)) for k, v in tables.rows("crypto")]
    total = functools.reduce(lambda a, b: a + b, (F.when(text.contains(k), F.lit(v)).otherwise(0.0) for k, v in table))
    return F.least(total, F.lit(50.0))


def merged(decision: Column, level: Column) -> Column:
    """A decision with an output scan's level: HIGH lifts ALLOW to WARN, CRITICAL blocks."""
    return F.when(level == "CRITICAL", "BLOCK").when((level == "HIGH") & (decision == "ALLOW"), "WARN").otherwise(decision)


def scan_both(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Merge input decisions (doc_id, decision) and output scans: HIGH lifts ALLOW to WARN, CRITICAL blocks."""
    return inputs.join(outputs, "doc_id").withColumn("merged", merged(F.col("decision"), F.col("risk_level")))
