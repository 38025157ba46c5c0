"""Queries over structural and agentic context, scrambled and fuzzy words."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import grouped, rows, sql_values
from textward.operators import context as ctx
from textward.operators import lexical as lex
from textward.plans.planted import CORPUS, corpus
from textward.plans.scores import _PSCORE, SCORED, _any, _count, _q, _scored
from textward.plans.scores import ORACLE as SCORES

FUZZY = ("ignore previous instructions", "system prompt", "training data report")


def _agentic(low: str) -> str:
    p = ctx._agentic() | {"web": ["http://", "https://"]}

    def test(groups, least):
        return "(" + " and ".join(f"contains({low}, {_q(g[1:])})" if g[0] == "=" else f"{_count(low, p[g])} >= {least}" if least > 1 else _any(low, p[g]) for g in groups) + ")"

    return f"nullif(case {' '.join(f'when {test(g, n)} then {_q(t)}' for t, g, n in ctx.AGENTIC)} end, '')"


_GROUPS = [(r[0], int(r[1]), r[2], list(r[3:])) for r in rows("structures")]
_BARE = r"regexp_replace(@, '^[\t\n\x0B\f\r\x{85}\p{Z}]+|[\t\n\x0B\f\r\x{85}\p{Z}]+$', '', 'g')"
_READ = {"bare": "bare", "low": "lower(bare)", "upper": "upper(bare)"}


def _line_sql(name: str) -> str:
    parts = []
    for structure, points, test, phrases in _GROUPS:
        if structure != name or test.startswith(("text", "raw", "quoted")):
            continue
        if test in ctx.LINE_TESTS:
            read, how = ctx.LINE_TESTS[test]
            hit = _any(_READ[read], phrases, "starts_with" if how == "starts" else "contains")
        elif test == "question":
            hit = f"{_any('lower(bare)', phrases)} and not {_any('lower(bare)', list(ctx.NO_STUDY))}"
        else:
            read, prefixes = ctx.MIXED[test]
            hit = " or ".join(f"{'starts_with' if i in prefixes else 'contains'}({_READ[read]}, {_q(p)})" for i, p in enumerate(phrases))
        parts.append((points, hit))
    more = {
        "log_format": ["starts_with(bare, '[') or (strlen(bare) >= 4 and left(bare, 4) between '2020' and '2030')", "contains(bare, ' - ') and contains(bare, ':')"],
        "documentation": [r"regexp_matches(bare, '(?s)^[1-9]\..')", "starts_with(following, chr(34)) or starts_with(following, chr(39))"],
        "cli_help": ["contains(bare, '--') and (contains(bare, ' ') or ends_with(bare, '--'))", "regexp_matches(bare, '(?s)^-[^-].') and contains(bare, ' ')"],
        "config": [
            f"instr(bare, ': ') > 1 and not starts_with(bare, '#') and not contains(left(bare, instr(bare, ': ') - 1), ' ') and not {_any('lower(substr(bare, instr(bare, chr(58) || chr(32)) + 2))', list(ctx.NO_CONFIG))}",
            r"strlen(line) > 2 and regexp_matches(line, '^[ \t]') and contains(line, ':')",
            _any("bare", ["{", "}", "[", "]"], "starts_with"),
            "starts_with(bare, '-')",
        ],
    }
    return " + ".join(f"case when {hit} then {points} else 0 end" for points, hit in [*parts, *((1, x) for x in more.get(name, []))])


def _text_sql(name: str) -> str:
    parts = ["0"]
    for structure, points, test, phrases in _GROUPS:
        if structure == name and test == "text_each":
            parts.append(f"{_count('low', phrases)} * {points}")
        elif structure == name and test in ("text_any", "raw_any"):
            parts.append(f"case when {_any('low' if test == 'text_any' else 'text', phrases)} then {points} else 0 end")
        elif structure == name and test == "quoted":
            parts += [f"case when {_any('low', [q + p for q in (chr(34), chr(39), chr(0x201C), chr(0x2018))])} then {points} else 0 end" for p in phrases]
    return " + ".join(parts)


_BY_LINE = ("code_block", "email_headers", "log_format", "documentation", "academic_study", "cli_help", "job_posting", "quoted_speech", "config")
_BY_TEXT = ("legal_document", "quoted_example", "training_data", "invoice_attack", "legal_strong", "citation", "invoice_receipt")


def _structures() -> str:
    lines = ", ".join(f"cast(sum({_line_sql(n)}) as integer) as {n}_" for n in _BY_LINE)
    texts = ", ".join(f"{_text_sql(n)} as {n}_" for n in _BY_TEXT)
    choice = []
    for name, least, step, cap in ctx.DETECTORS:
        points = {"citation": "(citation_ + case when contains(text, '(20') and contains(text, ')') then 1 else 0 end)", "invoice_receipt": "(invoice_receipt_ + case when prices >= 2 then 2 else 0 end)", "json_data": "json_points"}.get(name, f"{name}_")
        enough, sure = f"{points} >= {least}", f"{points} * {step}::double"
        if name == "json_data":
            choice.append("when json and attack is not null then {'s': null::varchar, 'c': 0.0::double}")
            enough += " and json"
        elif name == "invoice_receipt":
            enough += " and invoice_attack_ = 0"
        elif name == "legal_document":
            enough, sure = f"({enough} or legal_strong_ >= 1)", f"{sure} + legal_strong_ * 0.3::double"
        choice.append(f"when {enough} then {{'s': '{name}', 'c': least({sure}, {cap}::double)}}")
    return f"""st0 as (select doc_id, text, lower(text) as low, {_BARE.replace('@', 'text')} as whole from corpus),
st1 as (select *, (starts_with(whole, '{{') and ends_with(whole, '}}')) or (starts_with(whole, '[') and ends_with(whole, ']')) as json, {_agentic('low')} as attack, case when contains(text, '":') then 2 else 0 end + case when contains(text, '",') or contains(text, '": ') then 1 else 0 end + case when contains(text, '{{') or contains(text, '[') then 1 else 0 end as json_points, {texts} from st0),
ln0 as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from corpus),
ln1 as (select *, {_BARE.replace('@', 'line')} as bare from ln0),
ln2 as (select *, coalesce(lead(bare) over (partition by doc_id order by i), '') as following from ln1),
ln as (select doc_id, count(*) filter ({_any('line', ['$', '.00', '.99', '.95'])}) as prices, {lines} from ln2 group by doc_id),
st as (select doc_id, case {' '.join(choice)} end as x from st1 join ln using (doc_id)),
structures as (select doc_id, x.s as structure, coalesce(x.c, 0)::double as structure_confidence from st)"""


def _structured(s, d):
    return ctx.structural_context(_scored(s, d))


QUERIES = {
    "c5_structural_context": lambda s, d: _structured(s, d).select("doc_id", "structure", F.round("structure_confidence", 6).alias("structure_confidence")),
    "c6_structural_dampen": lambda s, d: ctx.structural_dampen(_structured(s, d)).select("doc_id", F.round("dampened", 6).alias("dampened")),
    "c7_dampen_classifier": lambda s, d: ctx.dampen_classifier(_structured(s, d).selectExpr("*", "case when score >= 0.5 then 'INJECTION' else 'SAFE' end as label", "score as confidence")).select("doc_id", F.round("dampened", 6).alias("dampened")),
    "c8_agentic_attack_type": lambda s, d: ctx.agentic_attack_type(corpus(s, d)),
    "c13_intent_explain": lambda s, d: ctx.intent_explain(ctx.intents(corpus(s, d))).select("doc_id", "intent", "keywords"),
    "l9_fuzzy_match": lambda s, d: lex.fuzzy_match(corpus(s, d), list(FUZZY)).select("doc_id", "phrase", F.round("score", 6).alias("score")),
    "l10_rank_threat_categories": lambda s, d: lex.ranked_categories(corpus(s, d)).filter("score > 0"),
}
#: A word with each non-ASCII character as one byte, as edits are counted in bytes here.
_FLAT = r"regexp_replace(w, '[^\x00-\x7F]', chr(1), 'g')"
_DIM = f"dim(structure, share, least_) as (values {sql_values(ctx.STRUCTURES)})"
_LOWER = "case when share is null then {0} else greatest({0} * (1 - share * structure_confidence), least_) end"
_I = grouped("intent")
_A = grouped("anchor")
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r \x{85}\x{A0}]+'), lambda w: w <> '')"
_NEED = "(values " + ", ".join(f"({i}, {_q(p)}, {_q(w)}, {int(len(w.encode()) * 0.2)}, {len(p.split())})" for i, p in enumerate(FUZZY) for w in p.split()) + ") as need(i, phrase, pw, most, n)"
_PAIRS = sql_values([(g, w) for g in sorted(_A) for a in _A[g] for w in a.split()])
_OWN = " ".join("when intent = " + _q(g) + " then list_filter([" + ", ".join(f"case when contains(low, {_q(k)}) then {_q(k)} end" for k in dict.fromkeys(_I[g])) + "], lambda x: x is not null)" for g in sorted(_I))
ORACLE = {
    "c5_structural_context": f"with {CORPUS}, {_structures()} select doc_id, structure, round(structure_confidence, 6) as structure_confidence from structures",
    "c6_structural_dampen": f"{SCORED}{CORPUS}, {_structures()}, {_DIM}, sc as (select doc_id, {_PSCORE} as score from corpus) select doc_id, round({_LOWER.format('score')}, 6)::double as dampened from sc join structures using (doc_id) left join dim using (structure)",
    "c7_dampen_classifier": f"{SCORED}{CORPUS}, {_structures()}, {_DIM}, sc as (select doc_id, {_PSCORE} as score from corpus) select doc_id, round(case when score >= 0.5 and score < 0.98 then {_LOWER.format('score')} else score end, 6)::double as dampened from sc join structures using (doc_id) left join dim using (structure)",
    "c8_agentic_attack_type": f"with {CORPUS}, l as (select doc_id, lower(text) as low from corpus) select doc_id, {_agentic('low')} as attack_type from l",
    "c13_intent_explain": f"with i as ({SCORES['c11_intent_keywords']}), {CORPUS}, l as (select doc_id, lower(text) as low from corpus) select doc_id, intent, case {_OWN} else [] end as keywords from i join l using (doc_id)",
    "l9_fuzzy_match": f"with {CORPUS}, w as (select distinct doc_id, unnest({_WORDS}) as w from corpus), hit as (select doc_id, i, phrase, n, count(distinct pw) as k from w join {_NEED} on abs(length(w) - length(pw)) <= most and levenshtein({_FLAT}, pw) <= most group by all), ok as (select *, k / n as score, row_number() over (partition by doc_id order by i) as r from hit where k / n >= 0.8) select doc_id, phrase, round(score, 6)::double as score from ok where r = 1",
    "l10_rank_threat_categories": f"with {CORPUS}, pairs(category, aw) as (values {_PAIRS}), tw as (select doc_id, w, count(*) as n from (select doc_id, unnest({_WORDS}) as w from corpus) group by all), dw as (select distinct w from tw), sim as (select w, aw, 1 - levenshtein({_FLAT}, aw) / greatest(length(w), length(aw)) as s from dw join (select distinct aw from pairs) on length(w) between 0.7 * length(aw) - 1 and length(aw) / 0.7 + 1), wp as (select doc_id, category, sum(n * s * 0.1) as words from tw join sim using (w) join pairs using (aw) where s > 0.7 group by all), low as (select doc_id, lower(text) as low from corpus), ph as (" + " union all ".join(f"select doc_id, '{g}' as category, {_count('low', _A[g])} * 0.3 as phrases from low" for g in sorted(_A)) + "), sc as (select doc_id, category, round(least(phrases + coalesce(words, 0), 1.0), 6)::double as score from ph left join wp using (doc_id, category)), rk as (select *, cast(row_number() over (partition by doc_id order by score desc, category) as integer) as rank from sc) select * from rk where score > 0",
}
