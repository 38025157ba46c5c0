"""Signals of several layers to one verdict, and its rates against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each signal source; 0.5 for others.
SOURCE_WEIGHTS = (("heuristic", 0.4), ("semantic", 0.6), ("intent_model", 0.75), ("classifier", 0.8), ("safeguard", 0.9), ("judge", 0.7), ("deeper", 0.7), ("context", 0.3), ("task_drift", 0.8))


def _weights() -> Column:
    table = F.create_map(*(F.lit(x) for pair in SOURCE_WEIGHTS for x in pair))
    return F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.5))


def weighted_score(signals: DataFrame) -> DataFrame:
    """(doc_id, score): mean of the signals by weight and confidence. signals: doc_id, source, score, confidence."""
    w = _weights() * F.col("confidence")
    rows = signals.groupBy("doc_id").agg(F.sum(F.col("score") * w).alias("a"), F.sum(w).alias("b"))
    return rows.select("doc_id", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("score"))


def obfuscation_union(signals: DataFrame) -> DataFrame:
    """(doc_id, was_obfuscated, types): over the arrays obfuscation_types of all signals."""
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_list("obfuscation_types"))))
    return signals.groupBy("doc_id").agg(types.alias("types")).select("doc_id", (F.size("types") > 0).alias("was_obfuscated"), "types")


def score_action(score: Column) -> Column:
    return F.when(score >= 0.7, "BLOCK").when(score >= 0.4, "WARN").otherwise("ALLOW")


def score_level(score: Column) -> Column:
    return F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.3, "LOW").otherwise("MINIMAL")


def aggregate_verdict(signals: DataFrame, sure: float = 0.85, boost: float = 1.3) -> DataFrame:
    """(doc_id, final_score, action, decision_path). Tiers in order: secrets, a sure score of 0.95 and more, agreement of all sure signals,
    obfuscation against a safe classifier or with a malicious one, the weighted mean (raised for obfuscated texts in the middle).

    signals: doc_id, source, score, confidence, label, secrets (boolean), obfuscated (boolean).
    """
    w = _weights() * F.col("confidence")
    certain = F.col("confidence") >= sure
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    rows = signals.groupBy("doc_id").agg(
        F.bool_or("secrets").alias("secrets"),
        F.max(F.when(certain & (F.col("score") >= 0.95), F.col("score"))).alias("top"),
        F.max_by("score", F.when(certain, F.struct("confidence", "source"))).alias("sure_score"),
        F.count_distinct(F.when(certain, F.col("label"))).alias("sure_labels"),
        F.bool_or("obfuscated").alias("obfuscated"),
        of("heuristic", "score").alias("h"),
        of("classifier", "score").alias("c"),
        of("classifier", "confidence").alias("cc"),
        of("classifier", "label").alias("cl"),
        F.sum(F.col("score") * w).alias("a"),
        F.sum(w).alias("b"),
    )
    col = F.col
    raised = F.least(col("h") * boost, F.lit(1.0))
    both = F.least((col("c") + col("h")) / 2 * boost, F.lit(1.0))
    mean = F.when(col("b") > 0, col("a") / col("b")).otherwise(0.0)
    last = F.when(col("obfuscated") & (mean >= 0.3) & (mean < 0.7), F.least(mean * boost, F.lit(1.0))).otherwise(mean)
    tier = lambda c, s, p: F.when(c, F.struct(s.alias("s"), F.lit(p).alias("p")))
    chosen = F.coalesce(
        tier(col("secrets"), F.lit(1.0), "TIER_0_SECRETS"),
        tier(col("top").isNotNull(), col("top"), "TIER_0_HIGH_SCORE"),
        tier(col("sure_labels") == 1, col("sure_score"), "TIER_1_HIGH_CONFIDENCE_AGREEMENT"),
        tier(col("obfuscated") & (col("cl") == "SAFE") & (col("cc") < sure) & (raised >= 0.5), raised, "TIER_2_OBFUSCATION_VETO"),
        tier(col("obfuscated") & (col("cl") == "MALICIOUS") & (col("h") >= 0.4), both, "TIER_2_OBFUSCATION_BOOST"),
        tier(F.lit(True), last, "TIER_3_WEIGHTED_AGGREGATION"),
    )
    out = rows.withColumn("x", chosen)
    fixed = F.col("x.p").startswith("TIER_0")
    return out.select("doc_id", F.col("x.s").alias("final_score"), F.when(fixed, "BLOCK").otherwise(score_action(F.col("x.s"))).alias("action"), F.when(fixed, "CRITICAL").otherwise(score_level(F.col("x.s"))).alias("risk_level"), F.col("x.p").alias("decision_path"))


def escalation(signals: DataFrame, low: float = 0.30, high: float = 0.85, judged: tuple[float, float] = (0.40, 0.70), apart: float = 0.3) -> DataFrame:
    """(doc_id, classifier, judge, deeper): three independent tests of what else should look at a text.

    classifier: obfuscated, or a weighted mean in [low, high). judge: classifier and heuristic differ by more than `apart`, or an unsure
    classifier calls an obfuscated text safe, or the mean lies within `judged` and no signal is sure. deeper: the classifier is
    unsure (below 0.7) and calls an obfuscated text safe, or contradicts the heuristic.
    """
    w = _weights() * F.col("confidence")
    first = lambda s: F.max(F.when(F.col("source") == s, F.struct("score", "confidence", "label")))
    rows = signals.groupBy("doc_id").agg(F.sum(F.col("score") * w).alias("a"), F.sum(w).alias("b"), F.bool_or("obfuscated").alias("o"), F.max("confidence").alias("top"), first("classifier").alias("c"), first("heuristic").alias("h"))
    c, h, o = F.col("c"), F.col("h"), F.col("o")
    mean = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    safe, bad = c["label"].isin("SAFE", "BENIGN"), c["label"].isin("INJECTION", "MALICIOUS", "UNSAFE")
    differ = F.round(F.abs(c["score"] - h["score"]), 9) > apart
    judge = (c.isNotNull() & h.isNotNull() & (differ | ((c["confidence"] < 0.6) & o & safe))) | ((mean >= judged[0]) & (mean <= judged[1]) & (F.col("top") < 0.85))
    deeper = c.isNotNull() & (c["confidence"] < 0.7) & ((o & safe) | (h.isNotNull() & ((bad & (h["score"] < 0.3)) | (safe & (h["score"] > 0.4)))))
    sure = lambda x: F.coalesce(x, F.lit(False))
    return rows.select("doc_id", sure(o | ((mean >= low) & (mean < high))).alias("classifier"), sure(judge).alias("judge"), sure(deeper).alias("deeper"))


#: Preset, block and warn threshold.
PRESETS = (("strict", 0.40, 0.20), ("default", 0.55, 0.35), ("usable", 0.70, 0.50))


def preset_actions(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """A row for every text and preset: BLOCK, WARN or ALLOW by its thresholds."""
    s = F.col(score_col)
    each = F.array(*(F.struct(F.lit(n).alias("preset"), F.when(s >= block, "BLOCK").when(s >= warn, "WARN").otherwise("ALLOW").alias("action")) for n, block, warn in PRESETS))
    return scored.select("*", F.inline(each))


def gateway_verdict(scored: DataFrame, classifier: DataFrame | None = None, semantic: DataFrame | None = None, judge: DataFrame | None = None, warn: float = 0.35, block: float = 0.55, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, decision, reason). scored: doc_id, heuristic_score and any layer's columns; optional layers by doc_id: classifier (is_threat, ml_confidence), semantic (semantic_score, semantic_threat), judge (judge_class, judge_confidence). keep: columns that stay."""
    empty = {"is_threat": "boolean", "ml_confidence": "double", "semantic_score": "double", "semantic_threat": "boolean", "judge_class": "string", "judge_confidence": "double"}
    out = scored
    for layer in (classifier, semantic, judge):
        out = out.join(layer, "doc_id", "left") if layer is not None else out
    for name, kind in empty.items():
        out = out if name in out.columns else out.withColumn(name, F.lit(None).cast(kind))
    h, middle = F.col("heuristic_score"), (F.col("heuristic_score") >= 0.3) & (F.col("heuristic_score") < 0.85)
    say = lambda c, d, r: F.when(c, F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")))
    chosen = F.coalesce(
        say(h >= 0.85, "BLOCK", "heuristic"),
        say(F.col("is_threat") & (F.col("ml_confidence") > 0.9), "BLOCK", "classifier"),
        say(F.col("semantic_threat") & (F.col("semantic_score") > 0.85), "BLOCK", "semantic"),
        say(middle & (F.col("judge_class") == "MALICIOUS") & (F.col("judge_confidence") > 0.8), "BLOCK", "judge"),
        say(middle & (F.col("judge_class") == "SUSPICIOUS"), "WARN", "judge"),
        say(h >= block, "BLOCK", "threshold"),
        say(h >= warn, "WARN", "threshold"),
        F.struct(F.lit("ALLOW").alias("d"), F.lit("").alias("r")),
    )
    return out.select("doc_id", *keep, chosen.alias("x")).select("doc_id", *keep, F.col("x.d").alias("decision"), F.col("x.r").alias("reason"))


def label_join(verdicts: DataFrame, labels: DataFrame, truth: str = "toxic") -> DataFrame:
    """(doc_id, blocked, truth) of labelled texts. verdicts: doc_id, decision."""
    return verdicts.join(labels.select("doc_id", (F.col(truth) == 1).alias("truth")), "doc_id").select("doc_id", (F.col("decision") == "BLOCK").alias("blocked"), "truth")


def evaluate(joined: DataFrame) -> DataFrame:
    """One row: texts, true-positive rate, true-negative rate and accuracy."""
    ok = F.col("blocked") == F.col("truth")
    return joined.agg(F.count("*").alias("texts"), F.round(F.try_divide(F.count_if(F.col("truth") & F.col("blocked")), F.count_if("truth")), 6).alias("tpr"), F.round(F.try_divide(F.count_if(~F.col("truth") & ~F.col("blocked")), F.count_if(~F.col("truth"))), 6).alias("tnr"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))
