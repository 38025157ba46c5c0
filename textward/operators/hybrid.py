"""The full verdict of a text: decoders, rules, lexical signals, context, structure and intent, with optional layers of other models.

`evidence` gathers what the operators say of each text; `hybrid_verdict` is an ordered chain of decisions over it, of which the first counts.

Defined results: null text is empty; layers that are absent, and texts without a row in one, leave the score as it is; rows that share a
doc_id must share the text. A text is decoded in three passes, and what they give is scored without being decoded again.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.functions.paths import settled
from textward.functions.text import count_of
from textward.operators import context, decode, heuristics, lexical, scan

#: Structures in which credentials are expected.
TRUSTED = ("log_format", "code_block", "test_code", "email_headers", "documentation", "config", "json_data", "legal_document", "invoice_receipt")
#: Share of the rules and of the semantic layer in the combined score, weight of the first classifier, score above which an attack intent adds nothing.
RULES_SHARE, SEMANTIC_SHARE, CLASSIFIER_WEIGHT, INTENT_CAP = 0.4, 0.6, 0.7, 0.9
#: Optional layers by doc_id: their columns.
LAYERS = {
    "semantic": "semantic_score double",
    "classifier": "is_threat boolean, ml_confidence double",
    "judge": "judge_class string, judge_confidence double, task_conflict boolean",
    "intent_model": "label string, model_confidence double",
    "safeguard": "is_safe boolean",
    "session": "session_block boolean, session_confidence double, session_score double, session_phase string, session_turn bigint",
}
#: Fixed value: confidence over which a blocked session blocks a text at once.
SESSION_SURE = 0.85


def session_layer(texts: DataFrame, verdicts: DataFrame, span: int = 4096) -> DataFrame:
    """The session layer: for each text (doc_id, session_id, at) its session's latest verdict up to it. verdicts: session_id, at and the columns of the layer.

    An as-of join by union: within stretches of `span` of a session's `at` (turns, or seconds) the last verdict goes on to the texts after it, and
    what stands at a stretch's end is carried to the next ones. So a session of any length is many groups, and no pair is made. At one `at`
    verdicts come first, and the one of the largest values counts; texts without a verdict before them, a session or an `at` have none.
    """
    names = [c.split()[0] for c in LAYERS["session"].split(", ")]
    held = F.struct(*names)
    b = F.floor(F.col("at") / span).alias("b")
    placed = F.col("session_id").isNotNull() & F.col("at").isNotNull()
    left = texts.filter(placed).select("doc_id", "session_id", "at", b, F.lit(None).cast(verdicts.select(held.alias("x")).schema["x"].dataType).alias("own"), F.lit(1).alias("side"))
    right = verdicts.filter(placed).select(F.lit(None).cast(texts.schema["doc_id"].dataType).alias("doc_id"), "session_id", "at", b, held.alias("own"), F.lit(0).alias("side"))
    stretches = right.groupBy("session_id", "b").agg(F.max_by("own", F.struct("at", "own")).alias("end")).unionByName(left.select("session_id", "b", F.lit(None).cast(right.schema["own"].dataType).alias("end")))
    stretches = stretches.groupBy("session_id", "b").agg(F.max("end").alias("end"))
    before = F.last("end", True).over(W.partitionBy("session_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    carried = stretches.withColumn("carried", before).filter("carried is not null").select("session_id", "b", "carried")
    inside = F.last("own", True).over(W.partitionBy("session_id", "b").orderBy("at", "side", "own").rowsBetween(W.unboundedPreceding, 0))
    rows = left.unionByName(right).withColumn("inside", inside).filter("side = 1").join(carried, ["session_id", "b"], "left")
    rows = rows.select("doc_id", F.coalesce("inside", "carried").alias("x")).select("doc_id", *(F.col(f"x.{n}").alias(n) for n in names))
    alone = texts.filter(~placed).select("doc_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LAYERS["session"].split(", ")))
    return rows.unionByName(alone)


def of_session_verdicts(verdicts: DataFrame) -> DataFrame:
    """Unified session verdicts (conv_id, turn, verdict, score, confidence, pattern_name) as verdicts for session_layer."""
    return verdicts.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), (F.col("verdict") == "BLOCK").alias("session_block"), F.col("confidence").alias("session_confidence"), F.col("score").alias("session_score"), F.col("pattern_name").alias("session_phase"), F.col("turn").alias("session_turn"))


def full_score(rows: DataFrame, passes: int = 2) -> DataFrame:
    """The heuristic score of normalised texts with all that the decoders give."""
    plain = decode.normalize_nfkc(rows).select("doc_id", F.col("normalized").alias("text"))
    found = decode.rolled(decode.traced(plain, passes), passes)
    return heuristics.heuristic_score(found.select("doc_id", F.concat_ws(" ", "text", F.when(F.col("decoded_text") != "", F.col("decoded_text"))).alias("text")))


def lexical_score(rows: DataFrame) -> DataFrame:
    """(doc_id, score, is_threat): characters, entropy, anchors, structure and mixed scripts combined. doc_id may be of any type."""
    anchors = lexical.anchor_match(rows)
    sure = F.when(F.col("phrases") > 0, F.least(F.col("phrases") * 0.3, F.lit(1.0)) * F.col("damp")).otherwise(F.col("score") * 0.5)
    parts = [
        lexical.char_profile(rows).select("doc_id", F.col("anomaly_score").alias("score"), F.lit(0.8).alias("confidence")),
        lexical.entropy_anomaly(rows).select("doc_id", F.coalesce("anomaly_score", F.lit(0.0)).alias("score"), F.lit(0.7).alias("confidence")),
        anchors.select("doc_id", F.when(F.col("score") > 0.3, F.col("score")).otherwise(0.0).alias("score"), sure.alias("confidence")),
        lexical.structure_flags(rows).select("doc_id", F.col("structure_score").alias("score"), F.lit(0.7).alias("confidence")),
        lexical.mixed_script_tokens(rows).select("doc_id", F.when(F.size("tokens") > 0, 0.55).otherwise(0.0).alias("score"), F.lit(0.75).alias("confidence")),
    ]
    return lexical.combine_lexical(functools.reduce(DataFrame.unionByName, parts))


def evidence(corpus: DataFrame, benign: tuple = (), passes: int = 3) -> DataFrame:
    """A row a text with what hybrid_verdict reads, as a table of its own. benign: (phrase, negative weight) that lower a score.

    What the decoders give, and the result, are written to the shared folder: four branches read the one, and some sixty steps follow on the other.
    """
    texts = corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = decode.normalize_nfkc(texts).select("doc_id", F.col("normalized").alias("text"))
    none = F.array().cast("array<string>")
    hidden = settled(decode.decoded_rollup(plain, passes).filter("decoded_text <> ''").select("doc_id", "decoded_text", "types", "layers", "multiplier"))
    # Each text is scored as it is and as it was decoded, in one pass over both.
    key = lambda k: F.struct("doc_id", F.lit(k).alias("kind")).alias("doc_id")
    inner = hidden.select(key(1), F.col("decoded_text").alias("text"))
    appended = plain.join(hidden.select("doc_id", "decoded_text"), "doc_id", "left").select(key(0), F.concat_ws(" ", "text", "decoded_text").alias("text"))
    scores = heuristics.heuristic_score(appended.unionByName(inner)).select("doc_id", F.col("heuristic_score").alias("h"), F.lit(None).cast("double").alias("l"), F.lit(False).alias("t"))
    lexicals = lexical_score(texts.select(key(0), "text").unionByName(inner)).select("doc_id", F.lit(None).cast("double").alias("h"), F.col("score").alias("l"), F.col("is_threat").alias("t"))
    of = lambda c, k: F.max(F.when(F.col("doc_id.kind") == k, F.col(c)))
    both = scores.unionByName(lexicals).groupBy(F.col("doc_id.doc_id").alias("id")).agg(of("h", 0).alias("score_plain"), of("h", 1).alias("score_decoded"), of("l", 0).alias("lexical_plain"), of("l", 1).alias("lexical_decoded"), of("t", 0).alias("threat_plain"), of("t", 1).alias("threat_decoded"))
    rows = context.structural_context(context.domain_of(context.context_flags(texts)))
    rows = context.intent_discount(context.intents(rows))
    table = corpus.sparkSession.createDataFrame(list(context.STRUCTURES), "structure string, structure_share double, structure_least double")
    rows = rows.join(F.broadcast(table), "structure", "left")
    text = F.col("text")
    low = F.lower(text)
    rows = rows.withColumns(
        {
            "agentic": context.agentic_type(low),
            "has_secrets": scan.has_secrets(text),
            "n_benign": count_of(low, [p for p, _ in benign]) if benign else F.lit(0),
            "benign_discount": heuristics.benign_discount(text, list(benign)) if benign else F.lit(0.0),
            "has_domain_keywords": F.size(heuristics.domain_keywords(text)) > 0,
            "score": F.lit(1.0),
            "is_substantive": heuristics.substantive(text),
        }
    )
    rows = context.domain_modifier(rows).withColumnRenamed("domain_score", "domain_factor").drop("text", "score")
    attacks = hidden.select("doc_id", "types", "layers", "multiplier", heuristics.attack_predicate(F.col("decoded_text")).alias("decoded_attack"))
    rows = rows.join(attacks, "doc_id", "left").join(both.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return settled(rows.withColumn("deobfuscated", F.col("types").isNotNull()).withColumn("types", F.coalesce("types", none)))


def deeper_analysis(rows: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """rows (evidence, a score and, where there is one, semantic_score) with deeper_score: what rules, decoders, semantic and lexical layers find with stricter eyes.

    The largest of: the score; that of the decoded text; 0.75 for scrambled letters, 0.80 for tag characters, 0.70 for two kinds of disguise;
    the semantic score from `threshold` on; 0.75 for an attack in the decoded text; the lexical score of a threat. For disguised texts 1.3 times, from 0.4 on.
    """
    at_least = lambda c, v: F.when(c, F.lit(v))
    semantic = F.when(F.col("semantic_score") >= threshold, F.col("semantic_score")) if "semantic_score" in rows.columns else F.lit(None).cast("double")
    threat = F.when(F.col("deobfuscated"), F.when(F.col("threat_decoded"), F.col("lexical_decoded"))).otherwise(F.when(F.col("threat_plain"), F.col("lexical_plain")))
    found = F.greatest(
        F.coalesce(score, F.lit(0.0)),
        "score_decoded",
        at_least(F.array_contains("types", "typoglycemia"), 0.75),
        at_least(F.array_contains("types", "unicode_tags"), 0.80),
        at_least(F.size("types") >= 2, 0.70),
        semantic,
        at_least(F.col("decoded_attack"), 0.75),
        threat,
    )
    return rows.withColumn("deeper_score", F.when(F.col("deobfuscated") & (found >= 0.4), F.least(found * 1.3, F.lit(1.0))).otherwise(found))


def hybrid_verdict(found: DataFrame, block: float = 0.80, allow: float = 0.10, use_intent: bool = True, **layers: DataFrame) -> DataFrame:
    """(doc_id, combined_score, risk_level, action, decision_path, reason, rule_score) of evidence rows. layers: DataFrames by doc_id, named as in LAYERS."""
    rows = found
    for name, columns in LAYERS.items():
        names = [c.split()[0] for c in columns.split(", ")]
        if name in layers:
            rows = rows.join(layers[name].select("doc_id", *names), "doc_id", "left")
        else:
            rows = rows.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns.split(", ")})
    col = F.col
    rows = rows.withColumn("_out", F.lit(None).cast("struct<score:double,level:string,action:string,path:string,reason:string>"))
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit(" %"))

    def decide(rows: DataFrame, when: Column, score, level: str, action: str, path, *reason) -> DataFrame:
        why = F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in reason))
        made = F.struct(F.lit(score).cast("double").alias("score"), F.lit(level).alias("level"), F.lit(action).alias("action"), F.lit(path).alias("path"), why.alias("reason"))
        return rows.withColumn("_out", F.coalesce("_out", F.when(when, made)))

    def change(rows: DataFrame, when: Column, new: Column, name: str = "score") -> DataFrame:
        return rows.withColumn(name, F.when(when, new).otherwise(col(name)))

    # Rules on the text and on what was decoded; lexical signals, agentic attacks and layers of disguise raise the score.
    decoded = F.coalesce(col("score_decoded") > col("score_plain"), F.lit(False))
    rows = rows.withColumn("score", F.greatest("score_plain", "score_decoded"))
    rows = rows.withColumn("_lex", F.when(decoded, F.when(col("threat_decoded"), col("lexical_decoded"))).otherwise(F.when(col("threat_plain"), col("lexical_plain"))))
    rows = rows.withColumn("score", F.greatest("score", "_lex", F.when(col("agentic").isNotNull(), F.lit(0.75))))
    rows = change(rows, (col("layers") > 1) & (col("score") > 0.1), F.least(col("score") * col("multiplier"), F.lit(1.0))).withColumn("rule_score", col("score"))
    rows = decide(rows, col("session_block") & (col("session_confidence") > SESSION_SURE), col("session_score"), "HIGH", "BLOCK", "MULTI_TURN_HIGH_CONFIDENCE", "session attack:", col("session_phase"), percent(col("session_confidence")), "sure, turn", col("session_turn").cast("string"))
    rows = decide(rows, col("has_secrets") & ~F.coalesce(col("structure").isin(list(TRUSTED)), F.lit(False)), 1.0, "CRITICAL", "BLOCK", "TIER_0_SECRETS", "credentials in the text")
    # Context, domain and benign phrases lower what is neither clear nor certain.
    rows = rows.withColumn("_context", col("is_educational") | col("is_defensive") | col("is_review"))
    open_ = (col("score") > 0.1) & (col("score") < 0.9)
    rows = change(rows, open_ & col("_context"), context.context_modifier(col("score")))
    rows = change(rows, open_ & (col("domain_confidence") >= 0.5) & col("has_domain_keywords"), col("score") * col("domain_factor"))
    rows = change(rows, open_ & (col("benign_discount") < 0), F.greatest(col("score") + col("benign_discount"), F.lit(0.0)))
    rows = rows.withColumn("_structured", col("structure").isNotNull() & (col("structure_confidence") >= 0.5))
    dampened = lambda c: F.greatest(c * (1 - col("structure_share") * col("structure_confidence")), col("structure_least"))
    rows = change(rows, col("_structured") & (col("score") > 0.15), dampened(col("score")))
    attack = F.lit(use_intent) & (col("intent") == "ATTACK")
    if use_intent:
        rows = change(rows, (col("discount") > 0) & (col("score") > 0.1) & (col("score") < block) & col("agentic").isNull(), col("score") * (1 - col("discount")))
        rows = change(rows, attack & (col("intent_confidence") >= 0.35) & ~col("_structured"), F.least(col("score") + 0.5 + 0.3 * col("intent_confidence"), F.lit(INTENT_CAP)))
    hidden = col("deobfuscated")
    rows = decide(rows, (col("score") >= block) & ~col("_context"), col("score"), "CRITICAL", "BLOCK", "FAST_PATH_BLOCK", "rules are sure of an attack")
    rows = decide(rows, ~hidden & col("_context") & (col("score") <= 0.20), col("score"), "MINIMAL", "ALLOW", "FAST_PATH_CONTEXT", F.when(col("is_educational"), "educational context").when(col("is_defensive"), "defensive context").otherwise("code review"))
    rows = decide(rows, (col("score") <= allow) & ~hidden & ~attack, col("score"), "MINIMAL", "ALLOW", "FAST_PATH_ALLOW", "rules find nothing")
    # The first classifier.
    threat, sure = col("is_threat"), col("ml_confidence")
    rows = decide(rows, threat & (sure >= 0.90), sure, "CRITICAL", "BLOCK", "HUGOT_HIGH_CONFIDENCE_BLOCK", "first classifier: attack,", percent(sure), "sure")
    rows = decide(rows, ~threat & (sure >= 0.95) & (col("score") <= 0.15) & ~hidden, 0.05, "MINIMAL", "ALLOW", "HUGOT_HIGH_CONFIDENCE_ALLOW", "first classifier: harmless,", percent(sure), "sure")
    moved = F.when(threat & (sure >= 0.70), F.least(col("score") + CLASSIFIER_WEIGHT * 0.5 * sure, F.lit(1.0))).when(~threat & (sure >= 0.80) & (col("score") < 0.7), col("score") * (1 - CLASSIFIER_WEIGHT * 0.3 * sure))
    rows = rows.withColumn("score", F.coalesce(moved, "score"))
    rows = rows.withColumn("_path", F.when(threat & (sure >= 0.50) & (sure < 0.70), "HUGOT_UNCERTAIN_ESCALATE").otherwise(""))
    # The judge.
    malicious, judged = col("judge_class") == "MALICIOUS", col("judge_confidence")
    rows = decide(rows, malicious & (judged > 0.8), 1.0, "CRITICAL", "BLOCK", col("_path"), "judge: attack,", percent(judged), "sure")
    rows = decide(rows, (col("judge_class") == "BENIGN") & (judged > 0.9), 0.0, "MINIMAL", "ALLOW", col("_path"), "judge: harmless,", percent(judged), "sure")
    rows = decide(rows, (malicious | (col("judge_class") == "SUSPICIOUS")) & col("task_conflict"), 0.95, "HIGH", "BLOCK", col("_path"), "judge: conflict with the task")
    # Rules and semantic score as one, lowered by structure and context.
    semantic = F.coalesce("semantic_score", F.lit(0.0))
    mean = lambda s: RULES_SHARE * col("score") + SEMANTIC_SHARE * s
    rows = rows.withColumn("combined", F.least(F.when(semantic > 0, mean(semantic)).otherwise(col("score")), F.lit(1.0)))
    rows = change(rows, col("_structured") & (col("combined") > 0.30), F.when(semantic > 0, mean(semantic * 0.7)).otherwise(dampened(col("combined"))), "combined")
    c, strong = col("combined"), col("confidence") >= 0.7
    learned = F.when(c >= 0.9, c * F.when(col("n_benign") >= 3, 0.35).otherwise(0.45)).when(c >= 0.4, c * 0.6).otherwise(c)
    defended = F.when(c >= 0.9, c * 0.5).when(c >= 0.4, c * 0.7).otherwise(c)
    rows = rows.withColumn("combined", F.when(col("is_educational") & strong, learned).when(col("is_defensive") & strong, defended).otherwise(c))
    # The second classifier, asked where the score is doubtful or the text is disguised.
    doubtful = ((c >= 0.3) & (c <= 0.7)) | hidden | attack | col("is_substantive") | (col("rule_score") >= 0.5)
    label, told = F.when(doubtful, col("label")), F.when(doubtful, col("model_confidence"))
    bad, safe = label == "INJECTION", label == "SAFE"
    rows = rows.withColumn("_sure", F.when(bad & (told > 0.85) & (told < 0.98) & col("structure").isNotNull(), dampened(told)).otherwise(told))
    eff = col("_sure")
    rows = decide(rows, bad & ((eff > 0.95) | ((eff > 0.85) & ~col("_context"))), 0.95, "HIGH", "BLOCK", "BERT_HIGH_CONFIDENCE_BLOCK", "second classifier: injection,", percent(told), F.when(eff != told, F.concat(F.lit("less by structure: "), percent(eff))))
    rows = deeper_analysis(rows)
    rows = decide(rows, safe & (told < 0.70) & hidden & (col("deeper_score") >= 0.6), col("deeper_score"), "HIGH", "BLOCK", "BIDIRECTIONAL_GO_VETO", "disguise found where the second classifier saw none:", F.array_join("types", ", "))
    rows = decide(rows, bad & (told < 0.70) & hidden, F.least((col("score") + told) / 2 * 1.3, F.lit(1.0)), "HIGH", "BLOCK", "BIDIRECTIONAL_AGREEMENT_BOOST", "disguise and injection,", percent(told), "sure")
    rows = decide(rows, safe & (told > 0.90) & ~hidden, 0.15, "MINIMAL", "ALLOW", "BERT_HIGH_CONFIDENCE_ALLOW", "second classifier: harmless,", percent(told), "sure")
    weight = F.least(F.greatest(0.6 + (eff - 0.70) * 0.8, F.lit(0.4)), F.lit(0.85))
    heard = F.when(bad & (eff > 0.70) & ~(told - eff > told * 0.25) & ~col("_structured"), c * (1 - weight) + eff * weight).when(safe & (told > 0.75) & col("agentic").isNull(), c * (1 - told * 0.85))
    rows = rows.withColumn("combined", F.coalesce(heard, "combined"))
    asked = (c >= 0.4) & (c <= 0.7)
    rows = decide(rows, asked & ~col("is_safe"), 0.95, "HIGH", "BLOCK", col("_path"), "safeguard: unsafe")
    rows = change(rows, asked & col("is_safe"), F.lit(0.2), "combined")
    # What has moved the score, if nothing has decided alone.
    ends = (F.when(col("is_safe") & asked, "safeguard: safe;"), F.when(heard.isNotNull(), F.concat(F.lit("second classifier: likely "), F.when(bad, "injection").otherwise("harmless"), F.lit(";"))), F.when(col("is_educational"), "educational context;"), F.when(col("is_defensive"), "defensive context;"), F.when(col("_structured"), F.concat(F.lit("structure: "), col("structure"), F.lit(";"))), "score", percent(c))
    last = F.when(col("_path") == "", "AGGREGATED_SCORE").otherwise(col("_path"))
    for least, level, action in ((0.9, "CRITICAL", "BLOCK"), (0.7, "HIGH", "BLOCK"), (0.5, "MEDIUM", "WARN"), (0.4, "LOW", "WARN")):
        rows = decide(rows, c >= least, c, level, action, last, *ends)
    rows = decide(rows, F.lit(True), c, "MINIMAL", "ALLOW", last, *ends)
    return rows.select("doc_id", col("_out.score").alias("combined_score"), col("_out.level").alias("risk_level"), col("_out.action").alias("action"), col("_out.path").alias("decision_path"), F.trim("_out.reason").alias("reason"), "rule_score")
