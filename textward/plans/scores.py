"""Queries over predicates, heuristic scores, context and lexical signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import grouped, rows, sql_values
from textward.operators import context as ctx
from textward.operators import heuristics as heu
from textward.operators import hybrid as hyb
from textward.operators import lexical as lex
from textward.operators import scan
from textward.operators import verdict as ver
from textward.plans.planted import CORPUS, corpus

#: A table of benign phrases; the operator takes any.
BENIGN = (("thank you", -0.2), ("documentation", -0.3), ("please", -0.1), ("review", -0.25), ("how to", -0.3))


def _text():
    return F.col("text")



def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(low: str, phrases: list[str], test: str = "contains") -> str:
    return "(" + " or ".join(f"{test}({low}, {_q(p)})" for p in phrases) + ")"


def _count(low: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({low}, {_q(p)}) as integer)" for p in phrases) + ")"


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}]"


def _with(template: str, column: str) -> str:
    return template.replace("@@", column)


_WORDS = f"list_filter(regexp_split_to_array(@@, '{_WS}+'), lambda w: w <> '')"
_A = grouped("attack")
_ATTACK = f"(({_any('low', _A['override'])} and {_any('low', _A['instruction'])}) or {_any('low', _A['extraction'])} or {_any('low', _A['jailbreak'])} or {_any('low', _A['exfil'])})"
LOW = f"{CORPUS}, l as (select doc_id, text, lower(text) as low from corpus)"
_TIERS = f"tiers(ord, family, score, label, regex) as (values {sql_values([(i, r[0], float(r[1]), r[2], r[3]) for i, r in enumerate(rows('input_tiers'))])})"
_FAMILY_ORDER = "case family " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(heu.FAMILIES)) + " end"
_TIER_HITS = f"hits as (select doc_id, family, {_FAMILY_ORDER} as fam, max(score) as s from corpus join tiers on regexp_matches(text, regex) group by doc_id, family), tier as (select doc_id, arg_min(family, fam) as family, arg_min(case family when 'tool' then 0.75 + (s - 0.7) * 0.67 else s end, fam) as score, min(fam) as fam from hits where family <> 'tool' or s >= 0.7 group by doc_id)"


def _entropy(total: str) -> str:
    return f"chars as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(text, '')) as c from corpus where text <> '') group by doc_id, c), h as (select doc_id, -sum(n / {total} * log2(n / {total})) as e from chars join corpus using (doc_id) group by doc_id)"


_KEYWORDS = f"keywords(k, w) as (values {sql_values([(k, float(w)) for k, w in rows('keywords')])})"
_CLEAN = "translate(@@, '{}\":,[]', '       ')"


def _keyword_ctes(source: str) -> str:
    """ks: doc_id and keyword points of source (doc_id, t)."""
    return f"""{_KEYWORDS}, tok as (select doc_id, unnest({_with(_WORDS, 'lower(t)')}) as w from {source}),
ks as (select doc_id, sum(x)::double as points from (select doc_id, keywords.w as x from tok join keywords on not contains(k, ' ') and contains(tok.w, k) union all select doc_id, w from {source} join keywords on contains(k, ' ') and contains(lower(t), k)) group by doc_id)"""


_BONUS = "(50.0 * (cast(contains(t, 'AKIA') and strlen(t) > 20 as integer) + cast(contains(t, 'sk-') and (contains(t, 'sk-proj-') or strlen(t) > 40) as integer) + cast(contains(t, 'sk_live_') or contains(t, 'rk_live_') or contains(t, 'sk_test_') as integer) + cast(contains(t, 'AIza') and strlen(t) > 35 as integer) + cast(contains(t, 'xoxb-') or contains(t, 'xoxp-') as integer) + cast(contains(t, '/etc/shadow') or contains(t, '/etc/passwd') or contains(t, 'id_rsa') as integer)))"
_CRYPTO = "least(50.0, " + " + ".join(f"case when contains(t, {_q(k)}) then {float(v)} else 0.0 end" for k, v in rows("crypto")) + ")"
_COMPRESS = f"case when strlen(@@) > 10 and len(regexp_extract_all(@@, '{_WS}')) > strlen(@@) // 4 then @@ || ' ' || regexp_replace(@@, '{_WS}', '', 'g') else @@ end"
_LEET = r"regexp_matches(@@, '[\p{L}@$][013][\p{L}@$]|\p{L}[@$]\p{L}')"
_UNLEET = f"case when {_LEET} and translate(@@, '130@$', 'ieoas') <> @@ then @@ || ' ' || translate(@@, '130@$', 'ieoas') else @@ end"
_FOREIGN = r"length(regexp_replace(@@, '[\x00-\x7F]', '', 'g')) > 2"

C = grouped("context")
_CONTEXT = f"""ctx0 as (select doc_id, text, trim(text) as tt, lower(trim(text)) as low from corpus),
ctx1 as (select doc_id, {_any('lower(text)', grouped('blocklist')['blocklist'])} as is_extraction, {_any('low', C['educational_prefix'], 'starts_with')} as pre, {_any('low', C['educational'])} as word, {_any('low', C['defensive'])} as is_defensive, {_any('low', C['log'])} as is_log, {_any('low', C['negation'])} as is_negated, ends_with(tt, '?') or {_any('low', C['question_prefix'], 'starts_with')} as is_question, {_any('low', C['review'])} as is_review from ctx0),
ctx as (select *, pre or word as is_educational, greatest(case when is_log then 0.9 else greatest(case when pre then 0.8 when is_extraction then 0.95 else 0.0 end, case when word then 0.7 else 0.0 end, case when is_defensive then 0.7 else 0.0 end) end, case when is_review then 0.6 else 0.0 end)::double as confidence from ctx1)"""
_B = lambda lo, hi: f"({lo} + ({hi} - {lo}) * (1 - confidence))"
_PICK = lambda h, n: f"case when s >= 0.85 then {_B(*h)} else {_B(*n)} end"
_LOWERED = f"s * case when is_educational and is_question then {_PICK((0.6, 0.8), (0.3, 0.6))} when is_educational then {_PICK((0.7, 0.9), (0.5, 0.7))} else 1.0 end * case when is_defensive then {_PICK((0.7, 0.9), (0.4, 0.7))} else 1.0 end * case when is_log then {_B(0.2, 0.4)} else 1.0 end * case when is_review then {_PICK((0.7, 0.9), (0.5, 0.7))} else 1.0 end * case when is_negated and not is_log then 0.7 else 1.0 end"
_MODIFIED = f"case when s <= 0 then s when is_extraction then least(s * 1.2, 1.0) when s >= 0.85 then greatest({_LOWERED}, s * 0.52) else {_LOWERED} end"
_D = {ctx.DOMAIN_NAMES.get(g, g): w for g, w in grouped("domain").items()}
_DOMAIN = f"dom0 as (select doc_id, text, low, greatest({', '.join(_count('low', _D[g]) for g in sorted(_D))}) as n, case greatest({', '.join(_count('low', _D[g]) for g in sorted(_D))}) {' '.join(f'when {_count("low", _D[g])} then {_q(g)}' for g in sorted(_D))} end as g from l), dom as (select doc_id, text, low, case when n >= 2 then g end as domain, (case when n >= 5 then 0.9 when n >= 3 then 0.7 when n >= 2 then 0.5 else 0.0 end)::double as domain_confidence from dom0)"
_P, _I = grouped("purpose"), grouped("intent")
_SECOND_WORD = r"regexp_extract_all(text, '[\p{L}\p{Nd}]+')"


def _scored(s, d):
    """The corpus with its heuristic score."""
    rows = corpus(s, d)
    return rows.join(heu.heuristic_score(rows).select("doc_id", F.round("heuristic_score", 6).alias("score")), "doc_id")


def _session_layer(s, d):
    """For every event of a user the latest purchase up to it, in the place of a verdict."""
    rows = s.read.parquet(f"{d}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    verdicts = rows.filter("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), "at", (F.col("value") > 20).alias("session_block"), F.lit(0.9).alias("session_confidence"), F.col("value").alias("session_score"), F.col("event_type").alias("session_phase"), F.col("event_id").alias("session_turn"))
    found = hyb.session_layer(rows.select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("session_id"), "at"), verdicts, 86_400_000_000)
    return found.select("doc_id", "session_block", "session_score", "session_turn")


_PSCORE = "(select heuristic_score from scores where sid = doc_id)"

QUERIES = {
    "f3_attack_predicate": lambda s, d: corpus(s, d).select("doc_id", heu.attack_predicate(_text()).alias("is_attack")),
    "f4_extraction_blocklist": lambda s, d: corpus(s, d).filter(heu.asks_for_prompt(_text())).select("doc_id"),
    "f5_substantive_filter": lambda s, d: corpus(s, d).select("doc_id", heu.substantive(_text()).alias("is_substantive")),
    "f6_canary_filter": lambda s, d: corpus(s, d).filter(heu.canary_hit(_text(), (*heu.CANARIES, "lorem", "password"))).select("doc_id"),
    "h1_tiered_rules": lambda s, d: corpus(s, d).withColumn("low", F.lower("text")).select("doc_id", heu.tier(_text(), F.col("low")).alias("t")).select("doc_id", F.col("t.family").alias("family"), F.round("t.score", 6).alias("score")),
    "h2_rule_family_hits": lambda s, d: heu.family_best(corpus(s, d), "multi_turn").select("doc_id", F.lit("multi_turn").alias("family"), "score", "label").unionByName(heu.family_best(corpus(s, d), "policy").select("doc_id", F.lit("policy").alias("family"), "score", "label")).unionByName(heu.family_best(corpus(s, d), "flip").select("doc_id", F.lit("flip").alias("family"), "score", "label")).filter("score > 0"),
    "h3_entropy": lambda s, d: corpus(s, d).select("doc_id", F.round(heu.entropy(_text(), True), 6).alias("by_bytes"), F.round(heu.entropy(_text(), False), 6).alias("by_characters")),
    "h4_high_entropy_block": lambda s, d: corpus(s, d).filter((F.octet_length("text") > 50) & (heu.entropy(_text(), True) > 4.4)).select("doc_id"),
    "h5_compress_spaced": lambda s, d: corpus(s, d).select("doc_id", F.sha2(heu.compressed(_text()), 256).alias("sha")),
    "h6_leet_gate": lambda s, d: corpus(s, d).select("doc_id", heu.has_leet(_text()).alias("is_leet"), F.sha2(heu.unleeted(_text()), 256).alias("sha")),
    "h7_keyword_score": lambda s, d: heu.keyword_score(corpus(s, d).select("doc_id", heu.cleaned(_text()).alias("t")), "t", "p").select("doc_id", F.round("p", 6).alias("points")),
    "h8_secret_bonus": lambda s, d: corpus(s, d).select("doc_id", heu.secret_bonus(_text()).alias("bonus")),
    "h9_foreign_penalty": lambda s, d: _scored(s, d).select("doc_id", F.round(heu.logistic(heu.foreign_penalty(_text(), F.col("score"))), 6).alias("p")),
    "h10_heuristic_score": lambda s, d: hyb.full_score(corpus(s, d)).select("doc_id", F.round("heuristic_score", 6).alias("heuristic_score"), "heuristic_path"),
    "h10_plain_score": lambda s, d: heu.heuristic_score(corpus(s, d)).select("doc_id", F.round("heuristic_score", 6).alias("heuristic_score"), "heuristic_path"),
    "h11_matched_domain_keywords": lambda s, d: corpus(s, d).select("doc_id", heu.domain_keywords(_text()).alias("keywords")),
    "h12_benign_discount": lambda s, d: corpus(s, d).select("doc_id", F.round(heu.benign_discount(_text(), list(BENIGN)), 6).alias("discount")),
    "f7_action_from_score": lambda s, d: _scored(s, d).select("doc_id", scan.action(F.col("score"), 0.35, 0.55).alias("action")),
    "c1_context_flags": lambda s, d: ctx.context_flags(corpus(s, d)).drop("text"),
    "c2_context_modifier": lambda s, d: ctx.context_flags(_scored(s, d)).select("doc_id", F.round(ctx.context_modifier(F.col("score")), 6).alias("modified")),
    "c3_domain_of": lambda s, d: ctx.domain_of(corpus(s, d)).drop("text"),
    "c4_domain_modifier": lambda s, d: ctx.domain_modifier(ctx.domain_of(_scored(s, d))).select("doc_id", F.round("domain_score", 6).alias("domain_score")),
    "c9_purpose_signals": lambda s, d: ctx.purpose_scores(corpus(s, d)).select("doc_id", *(F.round(f"{g}_score", 6).alias(f"{g}_score") for g in ctx.PURPOSE_WEIGHT), "is_code_review"),
    "c10_purpose_discount": lambda s, d: ctx.purpose_discount(ctx.purpose_scores(_scored(s, d)), "permissive").select("doc_id", F.round("discounted_score", 6).alias("discounted_score")),
    "c11_intent_keywords": lambda s, d: ctx.intents(corpus(s, d)).select("doc_id", "intent", F.round("intent_confidence", 6).alias("intent_confidence"), "second_intent", F.round("second_score", 6).alias("second_score")),
    "a9_risk_presets": lambda s, d: ver.preset_actions(_scored(s, d)).groupBy("preset", "action").agg(F.count("*").alias("texts")),
    "a6_hybrid_verdict": lambda s, d: hyb.hybrid_verdict(hyb.evidence(corpus(s, d), BENIGN)).select("doc_id", F.round("combined_score", 6).alias("combined_score"), "risk_level", "action", "decision_path", "reason"),
    "a6_session_layer": _session_layer,
    "a7_deeper_analysis": lambda s, d: hyb.deeper_analysis(hyb.evidence(corpus(s, d)), "score_plain").filter("deobfuscated").select("doc_id", "types", F.round("deeper_score", 6).alias("deeper_score")),
    "f7_profile_action": lambda s, d: ctx.with_profile_action(_scored(s, d)).groupBy("profile", "action").agg(F.count("*").alias("texts")),
    "l1_char_profile": lambda s, d: lex.char_profile(corpus(s, d)),
    "l2_entropy_anomaly": lambda s, d: lex.entropy_anomaly(corpus(s, d)),
    "l3_anchor_match": lambda s, d: lex.anchor_match(corpus(s, d)).select("doc_id", "category", "score"),
    "l4_benign_context": lambda s, d: corpus(s, d).select("doc_id", F.round(lex.benign_context(_text()), 6).alias("benign")),
    "l5_structure_flags": lambda s, d: lex.structure_flags(corpus(s, d)),
    "l7_mixed_script_tokens": lambda s, d: lex.mixed_script_tokens(corpus(s, d)),
}

_PERM = ctx.PROFILES[2]
ORACLE = {
    "f3_attack_predicate": f"with {LOW} select doc_id, {_ATTACK} as is_attack from l",
    "f4_extraction_blocklist": f"with {LOW} select doc_id from l where {_any('low', grouped('blocklist')['blocklist'])}",
    "f5_substantive_filter": f"with {LOW}, w as (select *, len({_with(_WORDS, 'text')}) as n from l) select doc_id, case when n <= 6 then false when n > 12 then true else {_any('low', grouped('substantive')['substantive'])} end as is_substantive from w",
    "f6_canary_filter": f"with {CORPUS} select doc_id from corpus where {_any('text', [*heu.CANARIES, 'lorem', 'password'])}",
    "h1_tiered_rules": f"with {CORPUS}, {_TIERS}, {_TIER_HITS} select doc_id, family, round(score, 6)::double as score from corpus left join tier using (doc_id)",
    "h2_rule_family_hits": f"with {CORPUS}, {_TIERS} select doc_id, family, max(score)::double as score, arg_max(label, score * 1000000 - ord) as label from corpus join tiers on regexp_matches(text, regex) where family in ('multi_turn', 'policy', 'flip') group by doc_id, family",
    "h3_entropy": f"with {CORPUS}, {_entropy('strlen(text)')}, {_entropy('length(text)').replace('chars as', 'chars2 as').replace('from chars join', 'from chars2 join').replace(' h as', ' h2 as')} select doc_id, round(coalesce(h.e, 0), 6) as by_bytes, round(coalesce(h2.e, 0), 6) as by_characters from corpus left join h using (doc_id) left join h2 using (doc_id)",
    "h4_high_entropy_block": f"with {CORPUS}, {_entropy('strlen(text)')} select doc_id from corpus join h using (doc_id) where strlen(text) > 50 and e > 4.4",
    "h5_compress_spaced": f"with {CORPUS} select doc_id, sha256({_with(_COMPRESS, 'text')}) as sha from corpus",
    "h6_leet_gate": f"with {CORPUS} select doc_id, {_with(_LEET, 'text')} as is_leet, sha256({_with(_UNLEET, 'text')}) as sha from corpus",
    "h7_keyword_score": f"with {CORPUS}, src as (select doc_id, {_with(_CLEAN, 'text')} as t from corpus), {_keyword_ctes('src')} select doc_id, round(coalesce(points, 0), 6) as points from corpus left join ks using (doc_id)",
    "h8_secret_bonus": f"with src as (with {CORPUS} select doc_id, text as t from corpus) select doc_id, {_BONUS}::double as bonus from src",
    "h9_foreign_penalty": f"with {CORPUS}, s as (select doc_id, case when {_with(_FOREIGN, 'text')} and {_PSCORE} > 0.3 then {_PSCORE} + 1.5 else {_PSCORE} end as x from corpus) select doc_id, round(case when x = 0 then 0 else 1 / (1 + exp(-x + 0.5)) end, 6)::double as p from s",
    "h10_plain_score": f"""with {CORPUS}, {_TIERS}, {_TIER_HITS}, {_entropy('strlen(text)')},
c1 as (select doc_id, {_with(_COMPRESS, 'text')} as t from corpus), c2 as (select doc_id, {_with(_UNLEET, 't')} as t from c1), src as (select doc_id, {_with(_CLEAN, 't')} as t from c2), {_keyword_ctes('src')},
pts as (select doc_id, t, {_CRYPTO} + {_BONUS} + coalesce(points, 0) as x from src left join ks using (doc_id)),
fin as (select doc_id, case when {_with(_FOREIGN, 't')} and x > 0.3 then x + 1.5 else x end as x, {_any('t', list(heu.CANARIES))} as canary from pts),
alltier as (select doc_id, arg_min(family, fam) filter (fam < 6) as fa, arg_min(s, fam) filter (fam < 6) as sa, arg_min(family, fam) filter (fam >= 6) as fb, arg_min(case family when 'tool' then 0.75 + (s - 0.7) * 0.67 else s end, fam) filter (fam >= 6) as sb from hits where family <> 'tool' or s >= 0.7 group by doc_id)
select doc_id, round(coalesce(sa, case when strlen(text) > 50 and e > 5.8 then 0.95 end, sb, case when canary then 1.0 end, case when x = 0 then 0 else 1 / (1 + exp(-x + 0.5)) end), 6)::double as heuristic_score, coalesce(fa, case when strlen(text) > 50 and e > 5.8 then 'entropy' end, fb, 'keywords') as heuristic_path
from corpus left join alltier using (doc_id) left join h using (doc_id) left join fin using (doc_id)""",
    "h11_matched_domain_keywords": f"with {LOW}, k(k) as (values {sql_values(sorted({(k,) for k, _, _ in rows('domain_discounts')}))}), m as (select doc_id, list(k order by k) as keywords from l join k on contains(low, k) group by doc_id) select doc_id, coalesce(keywords, []) as keywords from corpus left join m using (doc_id)",
    "h12_benign_discount": f"with {LOW} select doc_id, round(greatest(-0.65, {' + '.join(f'case when contains(low, {_q(p)}) then {w} else 0.0 end' for p, w in BENIGN)}), 6)::double as discount from l",
    "f7_action_from_score": f"with {CORPUS} select doc_id, case when {_PSCORE} >= 0.55 then 'BLOCK' when {_PSCORE} >= 0.35 then 'WARN' else 'ALLOW' end as action from corpus",
    "c1_context_flags": f"with {CORPUS}, {_CONTEXT} select doc_id, is_extraction, is_defensive, is_log, is_negated, is_question, is_review, is_educational, confidence from ctx",
    "c2_context_modifier": f"with {CORPUS}, {_CONTEXT}, s as (select *, {_PSCORE} as s from ctx) select doc_id, round({_MODIFIED}, 6)::double as modified from s",
    "c3_domain_of": f"with {LOW}, {_DOMAIN} select doc_id, domain, domain_confidence from dom",
    "c4_domain_modifier": f"with {LOW}, {_DOMAIN}, f(k, g, x) as (values {sql_values([(k, ctx.DOMAIN_NAMES.get(g, g), float(x)) for k, g, x in rows('domain_discounts')])}), m as (select doc_id, product(x) as x from dom join f on g = domain and contains(low, k) group by doc_id) select doc_id, round(case when {_PSCORE} > 0.1 then {_PSCORE} * coalesce(x, 1) else {_PSCORE} end, 6)::double as domain_score from corpus left join m using (doc_id)",
    "c9_purpose_signals": f"with {LOW} select doc_id, {', '.join(f'round({_count("low", _P[g])} * {w}, 6)::double as {g}_score' for g, w in ctx.PURPOSE_WEIGHT.items())}, {_any('low', _P['code_review'])} as is_code_review from l",
    "c10_purpose_discount": f"with {LOW} select doc_id, round({_PSCORE} * (1 - least(0.5, {' + '.join(f'{_PERM[3 + i]} * {w} * {_count("low", _P[g])}' for i, (g, w) in enumerate(ctx.PURPOSE_WEIGHT.items()))})), 6)::double as discounted_score from l",
    "c11_intent_keywords": f"with {LOW}, s as ({' union all '.join(f'select doc_id, {_q(g)} as g, round({_count("low", _I[g])} * {0.225 if g == "ATTACK" else 0.15}, 6) as s from l' for g in sorted(_I))}), r as (select *, row_number() over (partition by doc_id order by s desc, g) as n from s) select doc_id, case when max(s) < 0.1 then 'CONVERSATIONAL' else max(g) filter (n = 1) end as intent, (case when max(s) < 0.1 then 0.5 else least(1.0, max(s)) end)::double as intent_confidence, max(g) filter (n = 2 and s > 0) as second_intent, (max(s) filter (n = 2))::double as second_score from r group by doc_id",
    "a6_session_layer": "with v as (select user_id, ts, value, event_id from events where event_type = 'purchase') select e.event_id as doc_id, v.value > 20 as session_block, v.value as session_score, v.event_id as session_turn from events e asof left join v on e.user_id = v.user_id and e.ts >= v.ts",
    "f7_profile_action": f"with {CORPUS}, p(profile, block, warn) as (values {sql_values([r[:3] for r in ctx.PROFILES])}) select profile, case when {_PSCORE} >= block then 'BLOCK' when {_PSCORE} >= warn then 'WARN' else 'ALLOW' end as action, count(*) as texts from corpus, p group by all",
    "a9_risk_presets": f"with {CORPUS}, p(preset, block, warn) as (values ('strict', 0.40, 0.20), ('default', 0.55, 0.35), ('usable', 0.70, 0.50)) select preset, case when {_PSCORE} >= block then 'BLOCK' when {_PSCORE} >= warn then 'WARN' else 'ALLOW' end as action, count(*) as texts from corpus, p group by all",
    "l2_entropy_anomaly": f"with {CORPUS}, {_entropy('length(text)')}, s as (select doc_id, strlen(text) as n, coalesce(e, 0) as e from corpus left join h using (doc_id)) select doc_id, round(e, 6) as entropy, round(case when n >= 25 and abs(e - 4.5) > case when n < 50 then 2.5 when n < 100 then 1.5 when n > 200 then 0.3 else 1.0 end then least(abs(e - 4.5) / 2, 1.0) end, 6)::double as anomaly_score from s",
    "l4_benign_context": f"with {LOW} select doc_id, round(0.4 * ({' + '.join(f'least(3, {_count("low", w)})' for w in grouped('benign').values())}), 6)::double as benign from l",
    "l5_structure_flags": r"with {0}, t as (select doc_id, len(regexp_extract_all(text, '[\"''`]')) > 2 as a, contains(text, '```') as b, contains(text, '<!--') or contains(text, '-->') or contains(text, '/*') or contains(text, '*/') or contains(text, '//') or contains(text, '#') as c, contains(text, '<policy') or contains(text, '<system') or contains(text, '\"safety\"') or contains(text, '\"restrictions\"') as d, case when text = '' then false else len(regexp_extract_all(text, '[{{}}\[\]]')) / strlen(text) > 0.1 end as e from corpus) select doc_id, list_filter([case when a then 'deep_nesting' end, case when b then 'code_block' end, case when c then 'comment_markers' end, case when d then 'policy_structure' end, case when e then 'high_brackets' end], lambda x: x is not null) as patterns, round(0.2 * a::int + 0.15 * b::int + 0.1 * c::int + 0.25 * d::int + 0.15 * e::int, 6)::double as structure_score from t".replace('\\"', '"').format(CORPUS),
    "l7_mixed_script_tokens": f"with {CORPUS} select doc_id, list_filter({_SECOND_WORD}, lambda t: regexp_matches(t, '\\p{{Latin}}') and regexp_matches(t, '[\\p{{Cyrillic}}\\p{{Greek}}]')) as tokens from corpus",
}
# The SQL of what starts from a score has the scores before it.
SCORED = f"with scores as materialized (select doc_id as sid, heuristic_score from ({ORACLE['h10_plain_score']})), "
for _name in ("h9_foreign_penalty", "f7_action_from_score", "f7_profile_action", "c2_context_modifier", "c4_domain_modifier", "c10_purpose_discount", "a9_risk_presets"):
    ORACLE[_name] = SCORED + ORACLE[_name].removeprefix("with ")
