"""Context, domain, purpose and intent of texts, and the score changes that follow from them."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import any_of, count_of, counts_of, starts_with_any
from textward.operators.heuristics import asks_for_prompt, domain_keywords

#: Profile, block and warn threshold, discounts for education, fiction, history and profession.
PROFILES = (
    ("strict", 0.65, 0.45, 0.05, 0.05, 0.05, 0.10),
    ("balanced", 0.75, 0.55, 0.15, 0.15, 0.15, 0.20),
    ("permissive", 0.85, 0.70, 0.30, 0.35, 0.30, 0.35),
)
#: Domain names of the discount table's groups.
DOMAIN_NAMES = {"k8s": "kubernetes", "js": "javascript"}
#: Weight of a phrase for each purpose.
PURPOSE_WEIGHT = {"educational": 0.2, "creative": 0.2, "historical": 0.2, "professional": 0.25}


def context_flags(corpus: DataFrame) -> DataFrame:
    """corpus with flags and confidence: a log sets 0.9 outright, an educational prefix 0.8, the rest raise it."""
    p = tables.grouped("context")
    low = F.lower(F.trim("text"))
    out = corpus.withColumn("_low", low).withColumn("_n", counts_of(F.col("_low"), {g: p[g] for g in ("educational", "defensive", "log", "negation", "review")}))
    low, holds = F.col("_low"), lambda g: F.col(f"_n.{g}") > 0
    flags = {
        "is_extraction": asks_for_prompt(F.col("text")),
        "_prefix": starts_with_any(low, p["educational_prefix"]),
        "_word": holds("educational"),
        "is_defensive": holds("defensive"),
        "is_log": holds("log"),
        "is_negated": holds("negation"),
        "is_question": F.trim("text").endswith("?") | starts_with_any(low, p["question_prefix"]),
        "is_review": holds("review"),
    }
    out = out.select("*", *(v.alias(k) for k, v in flags.items()))
    start = F.when(F.col("_prefix"), 0.8).when(F.col("is_extraction"), 0.95).otherwise(0.0)
    raised = F.greatest(start, F.when(F.col("_word"), 0.7).otherwise(0.0), F.when(F.col("is_defensive"), 0.7).otherwise(0.0))
    confidence = F.greatest(F.when(F.col("is_log"), 0.9).otherwise(raised), F.when(F.col("is_review"), 0.6).otherwise(0.0))
    return out.withColumn("is_educational", F.col("_prefix") | F.col("_word")).withColumn("confidence", confidence).drop("_low", "_n", "_prefix", "_word")


def context_modifier(score: Column) -> Column:
    """The score after the flags of context_flags: smaller for harmless contexts, larger for prompt extraction."""
    high, c = score >= 0.85, F.col("confidence")
    between = lambda lo, hi: F.lit(lo) + F.lit(hi - lo) * (1 - c)
    pick = lambda h, n: F.when(high, between(*h)).otherwise(between(*n))
    factors = [
        F.when(F.col("is_educational") & F.col("is_question"), pick((0.6, 0.8), (0.3, 0.6))).when(F.col("is_educational"), pick((0.7, 0.9), (0.5, 0.7))).otherwise(1.0),
        F.when(F.col("is_defensive"), pick((0.7, 0.9), (0.4, 0.7))).otherwise(1.0),
        F.when(F.col("is_log"), between(0.2, 0.4)).otherwise(1.0),
        F.when(F.col("is_review"), pick((0.7, 0.9), (0.5, 0.7))).otherwise(1.0),
        F.when(F.col("is_negated") & ~F.col("is_log"), 0.7).otherwise(1.0),
    ]
    lower = score * functools.reduce(lambda a, b: a * b, factors)
    return F.when(score <= 0, score).when(F.col("is_extraction"), F.least(score * 1.2, F.lit(1.0))).when(high, F.greatest(lower, score * 0.52)).otherwise(lower)


def domain_of(corpus: DataFrame) -> DataFrame:
    """corpus with domain (null under two keywords; ties: first by name) and domain_confidence."""
    groups = {DOMAIN_NAMES.get(g, g): w for g, w in tables.grouped("domain").items()}
    counts = corpus.withColumn("_n", counts_of(F.lower("text"), groups))
    best = counts.withColumn("_b", F.array_min(F.array(*(F.struct((-F.col("_n")[g]).alias("n"), F.lit(g).alias("g")) for g in sorted(groups)))))
    n = -F.col("_b.n")
    return best.select(*corpus.columns, F.when(n >= 2, F.col("_b.g")).alias("domain"), F.when(n >= 5, 0.9).when(n >= 3, 0.7).when(n >= 2, 0.5).otherwise(0.0).alias("domain_confidence"))


def domain_modifier(scored: DataFrame) -> DataFrame:
    """scored (text, domain, score) with domain_score: times the discount of every matched keyword in the domain, for scores over 0.1."""
    factors = F.create_map(*(F.lit(x) for k, d, f in tables.rows("domain_discounts") for x in (f"{k}|{DOMAIN_NAMES.get(d, d)}", float(f))))
    found = domain_keywords(F.col("text"))
    product = F.aggregate(found, F.lit(1.0), lambda a, k: a * F.coalesce(F.try_element_at(factors, F.concat_ws("|", k, F.col("domain"))), F.lit(1.0)))
    return scored.withColumn("domain_score", F.when((F.col("score") > 0.1) & F.col("domain").isNotNull(), F.col("score") * product).otherwise(F.col("score")))


def purpose_scores(corpus: DataFrame) -> DataFrame:
    """corpus with a score for each purpose and the code-review flag."""
    p = tables.grouped("purpose")
    low = corpus.withColumn("_low", F.lower("text"))
    out = low.select("*", *((count_of(F.col("_low"), p[g]) * F.lit(w)).alias(f"{g}_score") for g, w in PURPOSE_WEIGHT.items()), any_of(F.col("_low"), p["code_review"]).alias("is_code_review"))
    return out.drop("_low")


def purpose_discount(scored: DataFrame, profile: str = "balanced", score_col: str = "score") -> DataFrame:
    """scored (with purpose scores) with discounted_score: the profile's discounts by purpose score, half at most."""
    row = next(r for r in PROFILES if r[0] == profile)
    total = functools.reduce(lambda a, b: a + b, (F.lit(row[3 + i]) * F.col(f"{g}_score") for i, g in enumerate(PURPOSE_WEIGHT)))
    return scored.withColumn("discounted_score", F.col(score_col) * (1 - F.least(total, F.lit(0.5))))


def intents(corpus: DataFrame) -> DataFrame:
    """corpus with primary and secondary intent: 0.15 a keyword, attacks half as much again; ties go by name."""
    p = tables.grouped("intent")
    low = corpus.withColumn("_n", counts_of(F.lower("text"), p))
    scores = [F.struct(F.round(F.col("_n")[g] * F.lit(-0.225 if g == "ATTACK" else -0.15), 6).alias("s"), F.lit(g).alias("g")) for g in sorted(p)]
    out = low.withColumn("_s", F.array_sort(F.array(*scores)))
    first, second = F.col("_s")[0], F.col("_s")[1]
    talk = -first["s"] < 0.1
    return out.select(*corpus.columns, F.when(talk, "CONVERSATIONAL").otherwise(first["g"]).alias("intent"), F.when(talk, 0.5).otherwise(F.least(-first["s"], F.lit(1.0))).alias("intent_confidence"), F.when(second["s"] < 0, second["g"]).alias("second_intent"), (-second["s"] + 0.0).alias("second_score"))


def with_profile_action(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """A row for every profile: BLOCK, WARN or ALLOW by its thresholds."""
    spark = scored.sparkSession
    profiles = spark.createDataFrame([r[:3] for r in PROFILES], "profile string, block double, warn double")
    s = F.col(score_col)
    # Three rows on the right, so every text gives three.
    return scored.join(F.broadcast(profiles)).withColumn("action", F.when(s >= F.col("block"), "BLOCK").when(s >= F.col("warn"), "WARN").otherwise("ALLOW")).drop("block", "warn")


#: Intent, profile and base discount.
INTENT_PROFILES = (
    ("EDUCATIONAL", "permissive", 0.35),
    ("CREATIVE", "permissive", 0.60),
    ("HISTORICAL", "permissive", 0.35),
    ("PROFESSIONAL", "ai_safety", 0.45),
    ("TECHNICAL", "code_assistant", 0.80),
    ("CONVERSATIONAL", "balanced", 0.85),
    ("SUSPICIOUS", "balanced", 0.0),
    ("ATTACK", "strict", 0.0),
)


def intent_discount(found: DataFrame) -> DataFrame:
    """found (intent, intent_confidence) with the intent's profile and its discount by confidence. The dimension has eight rows."""
    table = found.sparkSession.createDataFrame(list(INTENT_PROFILES), "intent string, profile string, _base double")
    rows = found.join(F.broadcast(table), "intent", "left")
    return rows.withColumn("profile", F.coalesce("profile", F.lit("balanced"))).withColumn("discount", F.coalesce("_base", F.lit(0.0)) * F.col("intent_confidence")).drop("_base")


def intent_explain(found: DataFrame) -> DataFrame:
    """found (text, intent) with keywords: those of the chosen intent that stand in the text, in the table's order."""
    p, low = tables.grouped("intent"), F.lower("text")
    every = functools.reduce(lambda c, g: c.when(F.col("intent") == g, F.array_compact(F.array(*(F.when(low.contains(k), F.lit(k)) for k in dict.fromkeys(p[g]))))), sorted(p), F.when(F.lit(False), F.array().cast("array<string>")))
    return found.withColumn("keywords", F.coalesce(every, F.array().cast("array<string>")))


#: Structure, share of the score that it takes, and the least that is left.
STRUCTURES = (
    ("test_code", 0.65, 0.15), ("log_format", 0.65, 0.15), ("training_data", 0.65, 0.15), ("cli_help", 0.65, 0.15), ("code_block", 0.60, 0.20), ("json_data", 0.55, 0.20),
    ("email_headers", 0.55, 0.20), ("documentation", 0.55, 0.20), ("citation", 0.55, 0.20), ("quoted_example", 0.50, 0.25), ("config", 0.45, 0.25), ("job_posting", 0.60, 0.20),
    ("academic_study", 0.60, 0.20), ("quoted_speech", 0.55, 0.25), ("legal_document", 0.60, 0.15), ("invoice_receipt", 0.65, 0.10),
)


def structural_dampen(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """scored (structure, structure_confidence) with dampened: the score less the structure's share by confidence, not below its least. Scores of no structure stay."""
    table = scored.sparkSession.createDataFrame(list(STRUCTURES), "structure string, _share double, _least double")
    lower = F.greatest(F.col(score_col) * (1 - F.col("_share") * F.col("structure_confidence")), F.col("_least"))
    return scored.join(F.broadcast(table), "structure", "left").withColumn("dampened", F.when(F.col("_share").isNull(), F.col(score_col)).otherwise(lower)).drop("_share", "_least")


def dampen_classifier(verdicts: DataFrame, sure: float = 0.98) -> DataFrame:
    """verdicts (label, confidence, structure, structure_confidence) with dampened: only an INJECTION below `sure` is lowered."""
    low = structural_dampen(verdicts, "confidence")
    return low.withColumn("dampened", F.when((F.col("label") == "INJECTION") & (F.col("confidence") < sure), F.col("dampened")).otherwise(F.col("confidence")))


def _agentic() -> dict[str, list[str]]:
    p = tables.grouped("agentic")
    return p | {"ref_inside": [*p["ref_inside"], *(f"://172.{i}." for i in range(16, 32))]}


#: Checks of tool and JSON-RPC text in order: type, the groups that must all hold a phrase ("=x": x itself must stand there; "!x": ends the search), least hits of the last.
AGENTIC = (
    ("mcp_description_injection", ("description",), 1),
    ("mcp_resource_exfil", ("resource_gate", "resource"), 1),
    ("mcp_schema_attack", ("schema_gate", "schema"), 1),
    ("jsonrpc_dangerous_method", ("=jsonrpc", "=method", "method"), 1),
    ("callback_hijack", ("callback", "callback_host"), 1),
    ("data_exfiltration", ("exfiltration",), 1),
    ("cache_poisoning", ("cache_gate", "cache"), 1),
    ("prototype_pollution", ("prototype",), 2),
    ("python_dangerous_method", ("python",), 1),
    ("mcp_tool_call_abuse", ("call_gate", "call"), 1),
    ("schema_ref_file_access", ("ref_gate", "=file://"), 1),
    ("schema_validation_bypass", ("ref_gate", "=validation", "unchecked"), 1),
    ("schema_ref_attacker_infra", ("ref_gate", "ref_host"), 1),
    ("schema_ref_ssrf", ("ref_gate", "ref_inside"), 1),
    ("", ("ref_gate", "ref_own"), 1),
    ("", ("ref_gate", "ref_known"), 1),
    ("schema_ref_with_attack_indicator", ("ref_gate", "web", "ref_intent"), 1),
)


def agentic_type(low: Column) -> Column:
    """Type of the first check that holds for a lower-case text; null without one (an internal or well-known schema reference ends the search)."""
    p = _agentic() | {"web": ["http://", "https://"]}
    n = counts_of(low, {g: [g[1:]] if g[0] == "=" else p[g] for _, groups, _ in AGENTIC for g in groups})

    def test(groups: tuple[str, ...], least: int) -> Column:
        parts = [n[g] >= least for g in groups]
        return functools.reduce(lambda a, b: a & b, parts)

    found = functools.reduce(lambda c, x: c.when(test(x[1], x[2]), x[0]), AGENTIC[1:], F.when(test(AGENTIC[0][1], 1), AGENTIC[0][0]))
    return F.when(found != "", found)


def agentic_attack_type(corpus: DataFrame) -> DataFrame:
    """(doc_id, attack_type), null for texts without one."""
    return corpus.select("doc_id", F.lower("text").alias("low")).select("doc_id", agentic_type(F.col("low")).alias("attack_type"))


#: Structures in the order in which they are tried, least points, confidence a point and its cap.
DETECTORS = (
    ("code_block", 3, 0.15, 0.95), ("json_data", 2, 0.25, 0.90), ("email_headers", 3, 0.2, 0.90), ("invoice_receipt", 4, 0.12, 0.90), ("log_format", 2, 0.2, 0.95),
    ("documentation", 3, 0.15, 0.95), ("academic_study", 2, 0.2, 0.90), ("legal_document", 3, 0.15, 0.95), ("quoted_example", 2, 0.25, 0.90), ("training_data", 3, 0.25, 0.95),
    ("citation", 2, 0.3, 0.90), ("cli_help", 3, 0.2, 0.95), ("job_posting", 4, 0.15, 0.90), ("quoted_speech", 3, 0.2, 0.90), ("config", 4, 0.12, 0.85),
)
#: Words that make a question no sign of study, and a setting no sign of a configuration.
NO_STUDY = ("bypass", "avoid detection", "hack", "exploit")
NO_CONFIG = ("ignore", "bypass", "override", "disregard", "forget", "reveal", "exfiltrate", "pretend", "jailbreak")
#: Tests of a line, as (what it reads, how): bare is the line without outer blanks.
LINE_TESTS = {"prefix": ("bare", "starts"), "contains": ("bare", "holds"), "lower_prefix": ("low", "starts"), "lower_contains": ("low", "holds"), "upper_prefix": ("upper", "starts")}
#: Groups whose phrases are read in several ways: how many of the first are prefixes, the others are contained; forwarding marks have theirs by place.
MIXED = {"test": ("bare", (0, 1)), "assert": ("bare", (0,)), "return": ("bare", (0,)), "forward": ("low", (0, 1, 3))}
#: Characters that are cut off at the ends of a line: tabs, line ends and all separators of Unicode.
_BLANK = r"[\t\n\x0B\f\r\x85\p{Z}]+"
_BLANKS = "\t\n\x0b\f\r\x85\x20\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Structures whose points come from lines, and lines with a price.
BY_LINE = ("code_block", "email_headers", "log_format", "documentation", "academic_study", "cli_help", "job_posting", "quoted_speech", "config")
PRICES = ("$", ".00", ".99", ".95")


def _one_of(phrases, prefixes=()) -> str:
    """A pattern of RE2 for lines that begin with one of the prefixes or hold one of the phrases."""
    return "|".join([rf"\A(?:{'|'.join(map(re.escape, prefixes))})"] * bool(prefixes) + [re.escape(x) for x in phrases])


def _line_tests() -> dict[str, list[tuple[int, list[tuple[str, str, bool]]]]]:
    """For each structure the points and tests of its line groups. A test: what is read of a line (line, bare, low, upper, next), a pattern of RE2, and whether it is to be found; all must hold."""
    out: dict[str, list[tuple[int, list[tuple[str, str, bool]]]]] = {n: [] for n in BY_LINE}
    for name, points, test, *phrases in tables.rows("structures"):
        if name not in out or test.startswith(("text", "raw", "quoted")):
            continue
        if test in LINE_TESTS:
            read, how = LINE_TESTS[test]
            tests = [(read, _one_of((), phrases) if how == "starts" else _one_of(phrases), True)]
        elif test == "question":
            tests = [("low", _one_of(phrases), True), ("low", _one_of(NO_STUDY), False)]
        else:
            read, prefixes = MIXED[test]
            tests = [(read, _one_of([x for i, x in enumerate(phrases) if i not in prefixes], [x for i, x in enumerate(phrases) if i in prefixes]), True)]
        out[name].append((int(points), tests))
    out["log_format"] += [(1, [("bare", r"\A(?:\[|20[23][0-9]-)", True)]), (1, [("bare", " - ", True), ("bare", ":", True)])]
    out["documentation"] += [(1, [("bare", r"(?s)\A[1-9]\..", True)]), (1, [("next", "\\A[\"']", True)])]
    out["cli_help"] += [(1, [("bare", "--", True), ("bare", r" |--\z", True)]), (1, [("bare", r"(?s)\A-[^-].", True), ("bare", " ", True)])]
    # A setting: the first blank stands after a colon that has a name before it, and no word of NO_CONFIG follows.
    out["config"] += [(1, [("bare", r"\A[^ #][^ ]*: ", True), ("low", rf"(?s)\A[^ ]*: .*(?:{_one_of(NO_CONFIG)})", False)]), (1, [("line", r"(?s)\A[ \t]..", True), ("line", ":", True)]), (1, [("bare", r"\A[\[\]{}]", True)]), (1, [("bare", r"\A-", True)])]
    return out


def line_points(text: Column) -> Column:
    """struct of a number for each structure of BY_LINE, summed over the text's lines, and `prices`, its lines with a price. Null for null.

    All lines of some hundred texts are searched at once, by RE2 over Arrow.
    """
    by_name = _line_tests()

    def found(texts: pa.Array, lows: pa.Array, uppers: pa.Array) -> pa.Array:
        parts = [some(*(x.slice(lo, 500).fill_null("").cast(pa.string()) for x in (texts, lows, uppers))) for lo in range(0, len(texts), 500)]
        sums = np.concatenate(parts, axis=1) if parts else np.zeros((len(BY_LINE) + 1, 0), np.int32)
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], names=[*BY_LINE, "prices"], mask=texts.is_null())

    def some(texts: pa.Array, lows: pa.Array, uppers: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(texts, "\n")
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        trimmed = lambda x: pc.utf8_trim(x, characters=_BLANKS)
        read = {"line": lists.flatten(), "low": trimmed(pc.split_pattern(lows, "\n").flatten()), "upper": trimmed(pc.split_pattern(uppers, "\n").flatten())}
        read["bare"] = trimmed(read["line"])
        nexts = np.arange(1, len(read["line"]) + 1)
        nexts[np.append(starts[1:], len(nexts)) - 1] = len(nexts)  # after a text's last line there is nothing
        read["next"] = pa.concat_arrays([read["bare"], pa.array([""])]).take(pa.array(nexts))

        def hits(tests: list[tuple[str, str, bool]]) -> np.ndarray:
            return functools.reduce(lambda a, b: a & b, (pc.match_substring_regex(read[r], p).to_numpy(zero_copy_only=False) == wanted for r, p, wanted in tests))

        total = [sum(hits(tests) * np.int32(points) for points, tests in by_name[n]) for n in BY_LINE]
        return np.add.reduceat(np.array([*total, hits([("line", _one_of(PRICES), True)])], np.int32), starts, axis=1)

    return F.arrow_udf(found, ", ".join(f"{n} int" for n in (*BY_LINE, "prices")))(text, F.lower(text), F.upper(text))


def structural_points(corpus: DataFrame) -> DataFrame:
    """corpus with points (a struct with a number for each structure), attack and json (whether the text is a JSON value)."""
    groups = [(r[0], int(r[1]), r[2], list(r[3:])) for r in tables.rows("structures")]
    text, low = F.col("text"), F.col("_low")
    # Phrases of whole texts, each group under its number; of quoted phrases each is a group with its quotes.
    asked = {f"g{i}": phrases for i, (_, _, test, phrases) in enumerate(groups) if test in ("text_each", "text_any")}
    asked |= {f"g{i}_{j}": [q + p for q in "\"'\u201c\u2018"] for i, (_, _, test, phrases) in enumerate(groups) if test == "quoted" for j, p in enumerate(phrases)}
    n = F.col("_n")

    def of_text(name: str) -> Column:
        total = F.lit(0)
        for i, (structure, points, test, phrases) in enumerate(groups):
            if structure != name:
                continue
            if test == "text_each":
                total = total + n[f"g{i}"] * points
            elif test in ("text_any", "raw_any"):
                total = total + F.when(n[f"g{i}"] > 0 if test == "text_any" else any_of(text, phrases), points).otherwise(0)
            elif test == "quoted":
                total = total + functools.reduce(lambda a, b: a + b, (F.when(n[f"g{i}_{j}"] > 0, points).otherwise(0) for j in range(len(phrases))))
        return total

    split = corpus.withColumn("_low", F.lower("text")).withColumn("_n", counts_of(low, asked)).withColumn("_x", line_points(text))
    sums = {name: F.col(f"_x.{name}") for name in BY_LINE}
    sums |= {name: of_text(name) for name in ("legal_document", "quoted_example", "training_data", "invoice_attack", "legal_strong")}
    sums["citation"] = of_text("citation") + F.when(text.contains("(20") & text.contains(")"), 1).otherwise(0)
    sums["invoice_receipt"] = of_text("invoice_receipt") + F.when(F.col("_x.prices") >= 2, 2).otherwise(0)
    whole = F.regexp_replace(text, f"^{_BLANK}|{_BLANK}\\z", "")
    json = (whole.startswith("{") & whole.endswith("}")) | (whole.startswith("[") & whole.endswith("]"))
    # Most texts have no bracket at either end, so they need not be cut.
    json = F.when(text.rlike(rf"\A(?:{_BLANK})?[{{\[]"), json).otherwise(F.when(text.isNotNull(), False))
    sums["json_data"] = F.when(text.contains('":'), 2).otherwise(0) + F.when(text.contains('",') | text.contains('": '), 1).otherwise(0) + F.when(text.contains("{") | text.contains("["), 1).otherwise(0)
    out = split.withColumn("points", F.struct(*(v.alias(k) for k, v in sums.items()))).withColumn("json", json)
    return out.withColumn("attack", agentic_type(F.when(F.col("json"), low))).drop("_low", "_n", "_x")


def structural_context(corpus: DataFrame) -> DataFrame:
    """corpus with structure (null for none) and structure_confidence: the first structure with enough points. A JSON value that holds an agentic attack has none."""
    scored = structural_points(corpus)
    p, chosen = F.col("points"), []
    for name, least, step, cap in DETECTORS:
        enough, sure = p[name] >= least, p[name] * step
        if name == "json_data":
            chosen.append(F.when(F.col("attack").isNotNull(), F.struct(F.lit(None).cast("string").alias("s"), F.lit(0.0).alias("c"))))
            enough = enough & F.col("json")
        elif name == "invoice_receipt":
            enough = enough & (p["invoice_attack"] == 0)
        elif name == "legal_document":
            enough, sure = enough | (p["legal_strong"] >= 1), sure + p["legal_strong"] * 0.3
        # A code block is tried before the attack ends the search.
        chosen.append(F.when(enough, F.struct(F.lit(name).alias("s"), F.least(sure, F.lit(cap)).cast("double").alias("c"))))
    found = scored.withColumn("_x", F.coalesce(*chosen))
    return found.select(*corpus.columns, F.col("_x.s").alias("structure"), F.coalesce("_x.c", F.lit(0.0)).alias("structure_confidence"))
