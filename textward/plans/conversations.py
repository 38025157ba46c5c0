"""Queries over conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import grouped
from textward.operators import heuristics as heu
from textward.operators import semantic as sem
from textward.operators import sessions as ses
from textward.operators import unified as uni
from textward.plans.planted import TURN_ROWS, turns
from textward.plans.scores import _any

#: A risk for every turn, from its ids: the given tables have none.
RISK = "(pmod(conv_id * 7 + turn * 3, 10) / 10)"
RISK_SQL = "(((conv_id * 7 + turn * 3) % 10 + 10) % 10 / 10::double)"
RISKY = f"{TURN_ROWS}, t as (select *, {RISK_SQL} as risk, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from turns)"


def risky(s, d):
    return turns(s, d).withColumn("risk", F.expr(RISK))


def _layered(s, d):
    """turns with drift and distance of hashed vectors; the score of the rules stands where a trained classifier's would."""
    rows = turns(s, d)
    counts = sem.hashed_vectors(rows.select(F.struct("conv_id", "turn").alias("doc_id"), "text"), unit=False).select("doc_id.conv_id", "doc_id.turn", "embedding")
    moved = sem.aggregate_drift(counts, "conv_id", "turn").select("conv_id", "turn", (F.col("acceleration") > 0).alias("accelerating"))
    vectors = counts.withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(sem.dot(F.col("embedding"), F.col("embedding")))))
    score = F.coalesce(heu.tier(F.col("text"), F.lower("text"))["score"], F.lit(0.0))
    return rows.withColumn("semantic_confidence", score).join(moved, ["conv_id", "turn"], "left").join(sem.centroid_distance(vectors, "conv_id", "turn"), ["conv_id", "turn"], "left")


LIMITS = {"tokens": 300, "turns": 6, "calls": 3, "request": 60, "local": 0.1, "remote": 0.2, "cost": 0.05}
P = grouped("turns")
_PATTERNS = {
    "boiling_frog": "select conv_id, 'boiling_frog' as pattern_name, sum(up) / (max(n) - 1)::double as confidence from (select *, cast(risk > lag(risk) over (partition by conv_id order by turn) as integer) as up from t) group by conv_id having max(n) >= 5 and sum(up) / (max(n) - 1) > 0.7",
    "probing": "select conv_id, 'probing' as pattern_name, least(count(*) filter (dip) / 3, 1.0)::double as confidence from (select *, risk > 0.5 and lag(risk, 1) over w < 0.3 and lag(risk, 2) over w > 0.5 as dip from t window w as (partition by conv_id order by turn)) group by conv_id having max(n) >= 6 and count(*) filter (dip) >= 2",
    "context_manipulation": f"select distinct c.conv_id, 'context_manipulation' as pattern_name, 0.85::double as confidence from t c where {_any('lower(c.text)', P['claim'])} and not exists (select 1 from t p where p.conv_id = c.conv_id and p.turn < c.turn and {_any('lower(p.text)', P['agreement'])})",
    "crescendo": "select distinct conv_id, 'crescendo' as pattern_name, 0.8::double as confidence from (select *, count(*) filter (risk < 0.3) over w as calm, count(*) filter (risk >= 0.3 and risk < 0.6) over w as odd from t window w as (partition by conv_id order by turn rows unbounded preceding)) where n >= 5 and i >= (2 * n) // 3 and risk > 0.6 and calm > 0 and odd > 0",
    "icl_manipulation": f"select conv_id, 'icl_manipulation' as pattern_name, least(count(*) filter (d) / count(*) filter (e) + 0.5, 0.95)::double as confidence from (select *, regexp_matches(text, '{ses.EXAMPLE}') as e, regexp_matches(text, '{ses.EXAMPLE}') and regexp_matches(text, '{ses.DANGEROUS}') as d from t) group by conv_id having max(n) >= 4 and count(*) filter (e) >= 2 and count(*) filter (d) >= 1 and count(*) filter (d) / count(*) filter (e) > 0.3",
}
_FLAGS = ", ".join(f"count(*) filter ({_any('lower(text)', P[g])}) as {g}" for g in ("role", "education", "policy", "exploit"))
_SKELETON = f"""select conv_id, 'skeleton_key' as pattern_name, round(case when policy > 0 then least(1.0, case when role > 0 and education > 0 then 0.9 else 0.7 end + case when exploit > 0 then 0.1 else 0 end) else 0.5 * case when education > 0 then 0.75 else 0.7 end end, 6)::double as confidence, policy = 0 as is_partial from (select conv_id, count(*) as n, {_FLAGS} from t group by conv_id) where n >= 3 and role + education > 0"""
_ALL = f"risks as ({_SKELETON} union all " + " union all ".join(f"select *, false from ({q})" for q in _PATTERNS.values()) + ")"


def _r(df):
    return df.withColumn("confidence", F.round("confidence", 6))


QUERIES = {
    "m1_session_window": lambda s, d: ses.session_window(turns(s, d), 4).select("conv_id", "turn", "kept", "from_turn"),
    "m2_skeleton_key": lambda s, d: ses.skeleton_key(turns(s, d)).drop("phase"),
    "m3_boiling_frog": lambda s, d: _r(ses.boiling_frog(risky(s, d))),
    "m4_probing": lambda s, d: _r(ses.probing(risky(s, d))),
    "m5_context_manipulation": lambda s, d: ses.context_manipulation(turns(s, d)),
    "j3_unsupported_claims": lambda s, d: ses.context_manipulation(turns(s, d)).select("conv_id"),
    "m6_crescendo": lambda s, d: ses.crescendo(risky(s, d)),
    "m7_icl_manipulation": lambda s, d: _r(ses.icl_manipulation(turns(s, d))),
    "m8_all_patterns": lambda s, d: _r(ses.all_patterns(risky(s, d))),
    "m9_pattern_boost": lambda s, d: ses.pattern_boost(ses.all_patterns(risky(s, d))).select("conv_id", F.round("boost_by_strongest", 6).alias("boost_by_strongest"), F.round("boost_by_sum", 6).alias("boost_by_sum")),
    "m10_should_block_session": lambda s, d: ses.should_block(ses.all_patterns(risky(s, d)), risky(s, d).groupBy("conv_id").agg(F.max_by("risk", "turn").alias("risk"))),
    "m11_session_verdicts": lambda s, d: ses.session_verdicts(turns(s, d)),
    "m12_unified_session_verdicts": lambda s, d: uni.unified_session_verdicts(_layered(s, d)).withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6)).withColumn("cumulative_risk", F.round("cumulative_risk", 6)),
    "m19_token_estimate": lambda s, d: ses.token_estimate(turns(s, d), 300),
    "m20_model_route": lambda s, d: ses.token_estimate(turns(s, d)).select("conv_id", ses.model_route(F.col("tokens") * 40).alias("route")),
    "m21_smart_truncate": lambda s, d: turns(s, d).select("conv_id", "turn", F.sha2(ses.smart_truncate(F.col("text"), 30), 256).alias("sha")),
    "m22_truncate_turns": lambda s, d: ses.truncate_turns(turns(s, d), 200).select("conv_id", "turn", "is_marker", F.sha2("text", 256).alias("sha")),
    "m23_combine_turns": lambda s, d: ses.combine_turns(turns(s, d)).select("conv_id", F.sha2("combined", 256).alias("sha")),
    "m24_session_budget": lambda s, d: ses.session_budget(turns(s, d), LIMITS).withColumn("cost", F.round("cost", 9)),
    "m25_session_stats": lambda s, d: ses.session_stats(turns(s, d), 5),
}

_T3, _LF2 = "strlen(text) // 3", "chr(10) || chr(10)"
ORACLE = {
    "m1_session_window": f"with {TURN_ROWS} select conv_id, turn, count(*) over w as kept, min(turn) over w as from_turn from turns window w as (partition by conv_id order by turn rows 3 preceding)",
    "m2_skeleton_key": f"with {RISKY} {_SKELETON}",
    **{f"{k}_{n}": f"with {RISKY} select conv_id, pattern_name, round(confidence, 6) as confidence from ({_PATTERNS[n]})" for k, n in (("m3", "boiling_frog"), ("m4", "probing"), ("m5", "context_manipulation"), ("m6", "crescendo"), ("m7", "icl_manipulation"))},
    "j3_unsupported_claims": f"with {RISKY} select conv_id from ({_PATTERNS['context_manipulation']})",
    "m8_all_patterns": f"with {RISKY}, {_ALL} select conv_id, pattern_name, round(confidence, 6) as confidence, is_partial from risks",
    "m9_pattern_boost": f"with {RISKY}, {_ALL} select conv_id, round(least(0.5, max(confidence) * 0.3 + 0.1 * (count(*) - 1)), 6)::double as boost_by_strongest, round(least(0.5, sum(confidence * case when is_partial then 0.3 else 0.5 end)), 6)::double as boost_by_sum from risks group by conv_id",
    "m10_should_block_session": f"with {RISKY}, {_ALL}, last as (select conv_id, arg_max(risk, turn) as risk from t group by conv_id) select conv_id, bool_or((pattern_name in ('skeleton_key', 'context_manipulation') and confidence > 0.8) or (confidence > 0.7 and risk > 0.6)) as block from risks join last using (conv_id) group by conv_id",
    "m19_token_estimate": f"with {TURN_ROWS} select conv_id, cast(sum({_T3}) as bigint) as tokens, cast(sum(ceil(strlen(text) / 3)) as bigint) as tokens_up, sum({_T3}) <= 300 as fits from turns group by conv_id",
    "m20_model_route": f"with {TURN_ROWS} select conv_id, case when sum({_T3}) * 40 <= 8192 then 'short' when sum({_T3}) * 40 <= 128000 then 'long' else 'longest' end as route from turns group by conv_id",
    "m21_smart_truncate": f"with {TURN_ROWS} select conv_id, turn, sha256(case when {_T3} <= 30 or strlen(text) <= 63 then text else left(text, 18) || {_LF2} || '[... middle context truncated for length ...]' || {_LF2} || right(text, 45) end) as sha from turns",
    "m22_truncate_turns": f"with {TURN_ROWS}, r as (select conv_id, turn, text, sum({_T3} + 10) over (partition by conv_id) as total, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as i from turns), k as (select *, total <= 200 or n <= 4 as entire from r) select conv_id, turn, false as is_marker, sha256(text) as sha from k where entire or i <= 2 or i > n - greatest(n // 2, 2) union all select conv_id, turn, true, sha256('[... earlier turns truncated ...]') from k where not entire and i = 2",
    "m23_combine_turns": f"with {TURN_ROWS} select conv_id, sha256(string_agg('Turn ' || turn || ': ' || text, chr(10) order by turn)) as sha from turns group by conv_id",
    "m24_session_budget": f"""with recursive {TURN_ROWS}, r as (select conv_id, turn, {_T3} as need, role = 'user' as far, row_number() over (partition by conv_id order by turn) as i from turns),
c as (select *, need / 1000 * case when far then 0.2::double else 0.1::double end as price from r),
f as (select conv_id, 0::bigint as i, 0::bigint as turn, true as allowed, '' as advice, '' as "limit", 0::bigint as tokens_used, 0::bigint as turns_used, 0::bigint as calls_made, 0::double as cost from (select distinct conv_id from turns)
  union all select x.conv_id, x.i, x.turn, x.hit = '', case x.hit when '' then case when need > 60 then 'truncate' else 'proceed' end when 'tokens' then case when need > 60 then 'truncate' else 'reject' end when 'turns' then 'reject' else 'truncate' end, x.hit,
    x.tokens_used + case x.hit when '' then need else 0 end, x.turns_used + case x.hit when '' then 1 else 0 end, x.calls_made + case when x.hit = '' and far then 1 else 0 end, x.cost + case x.hit when '' then price else 0 end
  from (select c.*, f.tokens_used, f.turns_used, f.calls_made, f.cost, case when f.tokens_used + need > 300 then 'tokens' when f.turns_used >= 6 then 'turns' when far and f.calls_made >= 3 then 'calls' when f.cost + price > 0.05 then 'cost' else '' end as hit from f join c on c.conv_id = f.conv_id and c.i = f.i + 1) x)
select conv_id, turn, allowed, advice, "limit", tokens_used, turns_used, calls_made, round(cost, 9) as cost from f where i > 0""",
    "m25_session_stats": f"with {TURN_ROWS}, e as (select conv_id, count(*) as n from turns group by conv_id) select count(*) as sessions, cast(sum(n) as bigint) as turns, cast(sum(least(n, 5)) as bigint) as retained from e",
}
