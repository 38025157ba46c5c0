"""Conversation analysis over turns (conv_id, turn, text, risk): windows in batch, a shared fold for session verdicts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from textward.functions import tables
from textward.functions.text import any_of, java

#: Example turns and dangerous words in them (RE2).
EXAMPLE = r"(?i)(user|human|q):\s*.+\s*(assistant|ai|a):\s*.+"
DANGEROUS = r"(?i)(hack|exploit|attack|malware|inject|bypass|crack|break into)"
#: Profile -> kept messages, block, warn, decay (None: risk adds up without decay or cap).
SESSION_PROFILES = {"strict": (10, 0.60, 0.40, None), "balanced": (15, 0.75, 0.55, 0.15), "permissive": (20, 0.85, 0.70, 0.25)}



def by_turn() -> WindowSpec:
    return W.partitionBy("conv_id").orderBy("turn")


def whole() -> WindowSpec:
    return W.partitionBy("conv_id")


def before() -> WindowSpec:
    return by_turn().rowsBetween(W.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return by_turn().rowsBetween(W.unboundedPreceding, 0)


def session_window(turns: DataFrame, n: int = 15) -> DataFrame:
    """turns with the number and the first turn of the last n turns up to each."""
    w = by_turn().rowsBetween(-(n - 1), 0)
    return turns.withColumn("kept", F.count("*").over(w)).withColumn("from_turn", F.min("turn").over(w))


def _risk(name: str, confidence: Column, found: Column) -> list[Column]:
    return [F.lit(name).alias("pattern_name"), F.when(found, confidence).alias("confidence")]


def boiling_frog(turns: DataFrame) -> DataFrame:
    """Conversations of five turns and more in which over 0.7 of the steps raise the risk."""
    rise = (F.col("risk") > F.lag("risk").over(by_turn())).cast("int")
    rows = turns.select("conv_id", rise.alias("rise"))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("rise").alias("up"))
    return found.filter((F.col("n") >= 5) & (F.col("up") / (F.col("n") - 1) > 0.7)).select("conv_id", F.lit("boiling_frog").alias("pattern_name"), (F.col("up") / (F.col("n") - 1)).alias("confidence"))


def probing(turns: DataFrame) -> DataFrame:
    """Six turns and more with two high-low-high triples."""
    dip = (F.col("risk") > 0.5) & (F.lag("risk", 1).over(by_turn()) < 0.3) & (F.lag("risk", 2).over(by_turn()) > 0.5)
    found = turns.select("conv_id", dip.alias("dip")).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("dip").alias("dips"))
    return found.filter("n >= 6 and dips >= 2").select("conv_id", F.lit("probing").alias("pattern_name"), F.least(F.col("dips") / 3, F.lit(1.0)).alias("confidence"))


def context_manipulation(turns: DataFrame) -> DataFrame:
    """A claim of an earlier agreement with no agreeing word in any earlier turn."""
    p = tables.grouped("turns")
    low = turns.select("conv_id", "turn", F.lower("text").alias("low"))
    rows = low.select("conv_id", "turn", any_of(F.col("low"), p["claim"]).alias("claim"), any_of(F.col("low"), p["agreement"]).alias("agree"))
    rows = rows.withColumn("backed", F.coalesce(F.bool_or("agree").over(before()), F.lit(False)))
    return rows.filter("claim and not backed").select("conv_id").distinct().select("conv_id", F.lit("context_manipulation").alias("pattern_name"), F.lit(0.85).alias("confidence"))


def crescendo(turns: DataFrame) -> DataFrame:
    """Five turns and more with a turn over 0.6 in the last third, after a harmless and a suspicious one."""
    rows = turns.select("conv_id", "risk", (F.row_number().over(by_turn()) - 1).alias("i"), F.count("*").over(whole()).alias("n"), F.count_if(F.col("risk") < 0.3).over(upto()).alias("calm"), F.count_if((F.col("risk") >= 0.3) & (F.col("risk") < 0.6)).over(upto()).alias("odd"))
    found = rows.filter("n >= 5 and i >= floor(2 * n / 3) and risk > 0.6 and calm > 0 and odd > 0")
    return found.select("conv_id").distinct().select("conv_id", F.lit("crescendo").alias("pattern_name"), F.lit(0.8).alias("confidence"))


def icl_manipulation(turns: DataFrame) -> DataFrame:
    """Four turns and more with two example dialogues, over 0.3 of them dangerous."""
    example = F.col("text").rlike(java(EXAMPLE))
    rows = turns.select("conv_id", example.alias("e"), (example & F.col("text").rlike(java(DANGEROUS))).alias("d"))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("e").alias("e"), F.count_if("d").alias("d"))
    return found.filter("n >= 4 and e >= 2 and d >= 1 and d / e > 0.3").select("conv_id", F.lit("icl_manipulation").alias("pattern_name"), F.least(F.col("d") / F.col("e") + 0.5, F.lit(0.95)).alias("confidence"))


def skeleton_key(turns: DataFrame) -> DataFrame:
    """Role setup or educational framing with a policy override; partial if only the setup is there."""
    p = tables.grouped("turns")
    low = turns.select("conv_id", "turn", F.lower("text").alias("low"))
    rows = low.select("conv_id", "turn", *(any_of(F.col("low"), p[g]).alias(g) for g in ("role", "education", "policy", "exploit")))
    # Phases in order of turns. Before the first policy turn the first role or education turn opens; an education turn primes.
    first_policy = F.min(F.when(F.col("policy"), F.col("turn"))).over(whole())
    rows = rows.withColumn("fp", first_policy).withColumn("lp", F.max(F.when(F.col("policy"), F.col("turn"))).over(whole()))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("n"), *(F.count_if(g).alias(g) for g in ("role", "education", "policy", "exploit")), F.count_if(F.col("exploit") & (F.col("turn") >= F.col("lp"))).alias("after"), F.max("lp").alias("lp"))
    col = F.col
    full = (col("role") + col("education") > 0) & (col("policy") > 0)
    base = F.when((col("role") > 0) & (col("education") > 0), 0.9).otherwise(0.7)
    confidence = F.when(full, F.when(col("exploit") > 0, F.least(base + 0.1, F.lit(1.0))).otherwise(base)).otherwise(F.when(col("education") > 0, 0.75).otherwise(0.7) * 0.5)
    phase = F.when(full, F.when(col("after") > 0, "EXPLOIT").otherwise("OVERRIDE")).otherwise(F.when(col("education") > 0, "PRIME").otherwise("SETUP"))
    keep = found.filter((col("n") >= 3) & (col("role") + col("education") > 0))
    return keep.select("conv_id", F.lit("skeleton_key").alias("pattern_name"), F.round(confidence, 6).alias("confidence"), phase.alias("phase"), (~full).alias("is_partial"))


def all_patterns(turns: DataFrame) -> DataFrame:
    """(conv_id, pattern_name, confidence, is_partial) of all detectors."""
    plain = functools.reduce(DataFrame.unionByName, (f(turns) for f in (boiling_frog, probing, context_manipulation, crescendo, icl_manipulation)))
    return skeleton_key(turns).drop("phase").unionByName(plain.withColumn("is_partial", F.lit(False)))


def pattern_boost(risks: DataFrame) -> DataFrame:
    """conv_id with both boosts: by the strongest pattern, and by the sum of all; 0.5 at most."""
    part = F.col("confidence") * F.when(F.col("is_partial"), 0.3).otherwise(0.5)
    return risks.groupBy("conv_id").agg(F.least(F.max("confidence") * 0.3 + 0.1 * (F.count("*") - 1), F.lit(0.5)).alias("boost_by_strongest"), F.least(F.sum(part), F.lit(0.5)).alias("boost_by_sum"))


def should_block(risks: DataFrame, current: DataFrame) -> DataFrame:
    """conv_id with block: a strong skeleton key or false claim, or any strong pattern at a risk over 0.6. current: conv_id, risk."""
    strong = F.col("pattern_name").isin("skeleton_key", "context_manipulation") & (F.col("confidence") > 0.8)
    rows = risks.join(current, "conv_id")
    return rows.groupBy("conv_id").agg(F.bool_or(strong | ((F.col("confidence") > 0.7) & (F.col("risk") > 0.6))).alias("block"))


def token_estimate(turns: DataFrame, limit: int = 8192) -> DataFrame:
    """Per conversation: bytes / 3 rounded down and up, and whether the session fits the limit."""
    n = F.octet_length("text")
    return turns.groupBy("conv_id").agg(F.sum(F.floor(n / 3)).alias("tokens"), F.sum(F.ceil(n / 3)).alias("tokens_up")).withColumn("fits", F.col("tokens") <= limit)


def model_route(tokens: Column) -> Column:
    return F.when(tokens <= 8192, "short").when(tokens <= 128_000, "long").otherwise("longest")


#: Marks that stand for what was cut.
CUT_TEXT, CUT_TURNS = "\n\n[... middle context truncated for length ...]\n\n", "[... earlier turns truncated ...]"


def smart_truncate(text: Column, limit: int, marker: str = CUT_TEXT) -> Column:
    """Over the limit (three bytes a token): the first fifth and the last half of it, with a marker between; texts that both parts cover stay whole.

    Parts are taken in characters, so none is cut inside one.
    """
    first, last = int(limit * 3 * 0.2), int(limit * 3 * 0.5)
    short = (F.floor(F.octet_length(text) / 3) <= limit) | (F.octet_length(text) <= first + last)
    return F.when(short, text).otherwise(F.concat(F.left(text, F.lit(first)), F.lit(marker), F.right(text, F.lit(last))))


def truncate_turns(turns: DataFrame, limit: int) -> DataFrame:
    """(conv_id, turn, text, is_marker): sessions within the token limit (ten more a turn) or of four turns and fewer as they are; of others the first two turns, a marker and the last half."""
    n, i = F.count("*").over(whole()), F.row_number().over(by_turn())
    total = F.sum(F.floor(F.octet_length("text") / 3) + 10).over(whole())
    rows = turns.select("conv_id", "turn", "text", n.alias("n"), i.alias("i"), total.alias("total"))
    rows = rows.withColumn("whole", (F.col("total") <= limit) | (F.col("n") <= 4))
    last = F.greatest(F.floor(F.col("n") / 2), F.lit(2))
    kept = rows.filter(F.col("whole") | (F.col("i") <= 2) | (F.col("i") > F.col("n") - last))
    # The second turn of a cut session is followed by the marker.
    mark = F.when(~F.col("whole") & (F.col("i") == 2), F.array(F.struct("text", F.lit(False).alias("is_marker")), F.struct(F.lit(CUT_TURNS).alias("text"), F.lit(True).alias("is_marker")))).otherwise(F.array(F.struct("text", F.lit(False).alias("is_marker"))))
    return kept.select("conv_id", "turn", F.inline(mark))


def combine_turns(turns: DataFrame, numbered: bool = True) -> DataFrame:
    """One text a conversation, in order of turns (bounded by the session)."""
    line = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(": "), F.col("text")) if numbered else F.col("text")
    rows = turns.select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("conv_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("combined"))


#: Tokens and turns of a session, remote calls of an hour, tokens of a request, dollars per thousand tokens (local, remote), dollars of a session.
BUDGET = {"tokens": 50_000, "turns": 100, "calls": 60, "request": 16_000, "local": 0.0001, "remote": 0.0005, "cost": 0.10}


def spend(used: list, need: int, far: bool, b: dict) -> tuple[bool, str, str, list]:
    """One turn of `need` tokens against what its session has used (tokens, turns, calls, cost): allowed, advice, limit and what is used now."""
    cost = need / 1000 * b["remote" if far else "local"]
    large = need > b["request"]
    if used[0] + need > b["tokens"]:
        limit, advice = "tokens", "truncate" if large else "reject"
    elif used[1] >= b["turns"]:
        limit, advice = "turns", "reject"
    elif far and used[2] >= b["calls"]:
        limit, advice = "calls", "truncate"
    elif used[3] + cost > b["cost"]:
        limit, advice = "cost", "truncate"
    else:
        limit, advice = "", "truncate" if large else "proceed"
        used = [used[0] + need, used[1] + 1, used[2] + int(far), used[3] + cost]
    return not limit, advice, limit, used


BUDGETS = "allowed boolean, advice string, limit string, tokens_used bigint, turns_used bigint, calls_made bigint, cost double"


def budget_requests(turns: DataFrame, remote: str) -> DataFrame:
    """(conv_id, turn, need, far): estimated tokens of a turn, and whether it is a remote call."""
    need = F.coalesce(F.floor(F.octet_length("text") / 3), F.lit(0))
    return turns.select("conv_id", "turn", need.alias("need"), F.coalesce(F.expr(remote), F.lit(False)).alias("far"))


def session_budget(turns: DataFrame, budget: dict | None = None, remote: str = "role = 'user'") -> DataFrame:
    """(conv_id, turn, allowed, advice, limit, tokens_used, turns_used, calls_made, cost): limits in the order tokens, turns, calls, cost.

    A turn that is not allowed uses nothing up, so each depends on the ones before: a fold in order of turns. remote: which turns are remote
    calls. advice: proceed, truncate or reject.
    """
    b = BUDGET | (budget or {})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, used = object(), [0, 0, 0, 0.0]
        for rows in batches:
            out = []
            for conv, turn, need, far in zip(rows["conv_id"], rows["turn"], rows["need"], rows["far"]):
                if conv != known:
                    known, used = conv, [0, 0, 0, 0.0]
                allowed, advice, limit, used = spend(used, need, far, b)
                out.append((conv, turn, allowed, advice, limit, *used))
            yield pd.DataFrame(out, columns=["conv_id", "turn", *(x.split()[0] for x in BUDGETS.split(", "))])

    ordered = budget_requests(turns, remote).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(fold, f"conv_id bigint, turn bigint, {BUDGETS}")


def session_stats(turns: DataFrame, n: int = 15) -> DataFrame:
    """One row: sessions, turns and retained messages."""
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("sessions"), F.sum("n").alias("turns"), F.sum(F.least("n", F.lit(n))).alias("retained"))


class Session:
    """State of one session: the fold that batch and stream share."""

    _example, _dangerous = re.compile(EXAMPLE), re.compile(DANGEROUS)

    def __init__(self, profile: str = "balanced"):
        self.profile = profile
        self.messages: list[tuple[int, str, float]] = []
        # What was found, also in turns that are kept no more: pattern -> phase, confidence, number of the turn.
        self.signals: dict[str, tuple[str | None, float, int]] = {}
        self.phase: str | None = None
        self.count, self.risk, self.locked = 0, 0.0, False

    def status(self) -> tuple[str, int, float, bool]:
        """What a stream keeps besides messages and signals."""
        return self.profile, self.count, self.risk, self.locked

    @classmethod
    def restored(cls, status: tuple, messages: list[tuple], signals: dict[str, tuple]) -> Session:
        out = cls()
        out.profile, out.count, out.risk, out.locked = status
        out.messages, out.signals = [tuple(m) for m in messages], dict(signals)
        out.phase = out.signals.get("skeleton_key", (None,))[0]
        return out

    def _note(self, found: list[tuple[str, float, bool]], number: int) -> None:
        self.signals |= {name: (self.phase if name == "skeleton_key" else None, sure, number) for name, sure, _ in found}

    def _patterns(self, content: str) -> list[tuple[str, float, bool]]:
        p = tables.grouped("turns")
        low = [m[1].lower() for m in self.messages] + [content.lower()]
        risks = [m[2] for m in self.messages] + [0.0]  # the current turn has no risk yet
        has = lambda text, group: any(x in text for x in p[group])
        out, n = [], len(low)
        prior = self.phase in ("SETUP", "PRIME")
        role = prior + sum(has(x, "role") for x in low)
        edu, exploit = sum(has(x, "education") for x in low), sum(has(x, "exploit") for x in low)
        policy = (self.phase == "OVERRIDE") + sum(has(x, "policy") for x in low)
        phase, sure = None, 0.0
        for x in low:
            if has(x, "role") and phase is None:
                phase, sure = "SETUP", 0.7
            if has(x, "education") and phase in (None, "SETUP"):
                phase, sure = "PRIME", 0.75
            if has(x, "policy"):
                phase, sure = "OVERRIDE", 0.85
            if has(x, "exploit") and phase == "OVERRIDE":
                phase, sure = "EXPLOIT", 0.95
        if n >= (1 if prior else 3) and (role or edu or prior):
            if policy:
                c = 0.85 if prior else 0.9 if role and edu else 0.7
                out.append(("skeleton_key", min(c + 0.1, 1.0) if exploit else c, False))
                self.phase = phase or self.phase
            elif phase:
                out.append(("skeleton_key", sure * 0.5, True))
                self.phase = phase
        if n >= 5:
            up = sum(b > a for a, b in zip(risks, risks[1:])) / (n - 1)
            if up > 0.7:
                out.append(("boiling_frog", up, False))
        if n >= 6:
            dips = sum(c > 0.5 and b < 0.3 and a > 0.5 for a, b, c in zip(risks, risks[1:], risks[2:]))
            if dips >= 2:
                out.append(("probing", min(dips / 3, 1.0), False))
        if any(has(x, "claim") and not any(has(y, "agreement") for y in low[:i]) for i, x in enumerate(low)):
            out.append(("context_manipulation", 0.85, False))
        if n >= 5 and any(r > 0.6 and i >= 2 * n // 3 and any(q < 0.3 for q in risks[: i + 1]) and any(0.3 <= q < 0.6 for q in risks[: i + 1]) for i, r in enumerate(risks)):
            out.append(("crescendo", 0.8, False))
        if n >= 4:
            texts = [m[1] for m in self.messages] + [content]
            examples = [x for x in texts if self._example.search(x)]
            bad = sum(bool(self._dangerous.search(x)) for x in examples)
            if len(examples) >= 2 and bad and bad / len(examples) > 0.3:
                out.append(("icl_manipulation", min(bad / len(examples) + 0.5, 0.95), False))
        return out

    def turn(self, content: str, semantic: float = 0.0) -> tuple[str, float, str, float]:
        """Take one turn: verdict, score, strongest pattern and cumulative risk."""
        keep, block, warn, decay = SESSION_PROFILES[self.profile]
        self.count += 1
        if self.locked:
            return "BLOCK", 1.0, "locked", self.risk
        found = self._patterns(content)
        self._note(found, self.count)
        name, strongest = max(((p[0], p[1]) for p in found), key=lambda x: x[1], default=("", 0.0))
        boost = min(sum(c * (0.3 if part else 0.5) for _, c, part in found), 0.5)
        score = min(strongest + boost + 0.3 * max(semantic, 0.0) + 0.2 * self.risk, 1.0)
        verdict = "BLOCK" if score >= block else "WARN" if score >= warn else "ALLOW"
        self.risk = self.risk + 0.1 * score if decay is None else min(self.risk * (1 - decay) + 0.1 * score, 1.0)
        self.locked = verdict == "BLOCK"
        self.messages = [*self.messages, (self.count, content, score)][-keep:]
        return verdict, score, name, self.risk


VERDICT = "verdict string, score double, pattern_name string, cumulative_risk double"


def session_verdicts(turns: DataFrame, profile: str = "balanced") -> DataFrame:
    """Verdict of every turn, each session folded in order of turns. A turn feeds the next one's score, so a session is one group.

    Rows of a session come in batches sorted by turn; only the session's state is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, state = object(), None
        for rows in batches:
            out = []
            for conv, turn, text in zip(rows["conv_id"], rows["turn"], rows["text"]):
                if conv != known:
                    known, state = conv, Session(profile)
                out.append((conv, turn, *state.turn(text or "")))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "verdict", "score", "pattern_name", "cumulative_risk"])

    ordered = turns.select("conv_id", "turn", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(fold, f"conv_id bigint, turn bigint, {VERDICT}")
