"""Unified session verdicts: turn patterns, semantic scores, drift and distance in one score, damped by purpose and intent.

What a turn's score takes from the turn alone is made by DataFrame functions; only the patterns over earlier turns and the recurrence
(cumulative risk, lock) are a fold, which batch and stream share.

Defined results: a turn without text has a null verdict and changes nothing; layers that are absent count nothing; intents without a
profile, and profiles not listed, are balanced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.operators import context
from textward.operators.sessions import Session

#: Profile, least semantic score, block and warn threshold, discounts for education, fiction, history and profession.
PROFILES = (
    ("strict", 0.55, 0.65, 0.45, 0.05, 0.05, 0.05, 0.10),
    ("balanced", 0.65, 0.75, 0.55, 0.15, 0.15, 0.15, 0.20),
    ("permissive", 0.75, 0.85, 0.70, 0.30, 0.35, 0.30, 0.35),
    ("code_assistant", 0.70, 0.80, 0.60, 0.20, 0.10, 0.15, 0.30),
    ("ai_safety", 0.80, 0.90, 0.75, 0.35, 0.25, 0.35, 0.40),
)
#: Optional layers of a turn, by column.
LAYERS = {"semantic_confidence": "double", "aggregate_score": "double", "accelerating": "boolean", "distance": "double", "judge_unsafe": "boolean"}
#: Messages kept; risk below which a turn calms, what it takes off, share of a risky turn's score that adds up, most risk; score that locks.
KEPT, CALM, DECAY, SHARE, MOST, LOCKS = 20, 0.3, 0.15, 0.3, 2.0, 0.9
VERDICT = "verdict string, score double, confidence double, pattern_name string, cumulative_risk double, profile string"


def turn_signals(turns: DataFrame, profile: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role if there, text and any of LAYERS) with what the fold reads: extra, asked, unsafe, factor, block, warn, profile.

    profile: one for all turns; without, each turn's intent chooses its own.
    """
    own = [c for c in ("conv_id", "turn", "role") if c in turns.columns]
    layers = (F.coalesce(F.col(n) if n in turns.columns else F.lit(None), F.lit(0.0 if kind == "double" else False)).cast(kind).alias(n) for n, kind in LAYERS.items())
    rows = turns.select(*own, F.coalesce("text", F.lit("")).alias("text"), *layers)
    rows = context.intent_discount(context.intents(context.purpose_scores(rows)))
    names = [r[0] for r in PROFILES]
    chosen = F.lit(profile) if profile else F.col("profile")
    rows = rows.withColumn("profile", F.when(chosen.isin(names), chosen).otherwise("balanced"))
    purposes = list(context.PURPOSE_WEIGHT)
    table = turns.sparkSession.createDataFrame(list(PROFILES), "profile string, _least double, block double, warn double, " + ", ".join(f"_{p} double" for p in purposes))
    rows = rows.join(F.broadcast(table), "profile", "left")  # five rows
    semantic = (F.col("semantic_confidence") + F.col("aggregate_score")) / 2
    extra = F.when(semantic > F.col("_least"), semantic * 0.35).otherwise(0.0) + F.when(F.col("accelerating"), 0.15).otherwise(0.0) + F.when(F.col("distance") > 0.4, F.col("distance") * 0.15).otherwise(0.0)
    total = sum((F.col(f"_{p}") * F.col(f"{p}_score") for p in purposes), F.lit(0.0))
    factor = (1 - F.least(total, F.lit(0.5))) * (1 - F.col("discount"))
    return rows.select(*own, "text", extra.alias("extra"), (semantic * 2 >= 0.25).alias("asked"), F.col("judge_unsafe").alias("unsafe"), factor.alias("factor"), "block", "warn", "profile")


class Unified(Session):
    """State of one session under the unified rules."""

    def take(self, row) -> tuple:
        """Take one row of turn_signals: values of VERDICT."""
        if not row.text:
            return None, None, None, "", self.risk, row.profile
        if self.locked:
            return "BLOCK", 1.0, 1.0, "locked", self.risk, row.profile
        found = self._patterns(row.text)
        name, strongest = max(((p[0], p[1]) for p in found), key=lambda x: x[1], default=("", 0.0))
        boost = min(0.3 * strongest + 0.1 * (len(found) - 1), 0.5) if found else 0.0
        raw = 0.35 * boost + row.extra
        # A judge's reply counts where its score is doubtful, or late in a session that has gathered risk.
        if row.unsafe and (row.asked or (self.count >= 4 and self.risk > 0.5)):
            raw = max(raw, 0.85)
        score = min(raw, 1.0) * row.factor
        verdict = "BLOCK" if score >= row.block else "NEGOTIATE" if score >= row.warn else "ALLOW"
        self.count += 1
        self._note(found, self.count)
        self.messages = [*self.messages, (self.count, row.text, score)][-KEPT:]
        self.locked = verdict == "BLOCK" and score >= LOCKS
        self.risk = min(max(self.risk - DECAY, 0.0) if score < CALM else self.risk + SHARE * score, MOST)
        return verdict, score, 1 - score if verdict == "ALLOW" else score, name, self.risk, row.profile


def unified_session_verdicts(turns: DataFrame, profile: str | None = None) -> DataFrame:
    """Verdict of every turn (BLOCK, NEGOTIATE or ALLOW), each session folded in order of turns; only its state is held, not its rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, state = object(), None
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if row.conv_id != known:
                    known, state = row.conv_id, Unified()
                out.append((row.conv_id, row.turn, *state.take(row)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", *(x.split()[0] for x in VERDICT.split(", "))])

    rows = turn_signals(turns, profile)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(fold, f"conv_id bigint, turn bigint, {VERDICT}")
