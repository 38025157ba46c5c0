"""Queries over rule scans and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import rows, sql_values
from textward.operators import scan
from textward.plans.planted import CORPUS, corpus

INPUT_CATEGORIES = ("ssrf", "jailbreak", "prompt_extraction")


def _rules(categories) -> str:
    chosen = scan.rules(categories)
    return f"rules(ord, name, category, severity, description, regex) as (values {sql_values([(i, r[0], r[1], int(r[2]), r[3], r[4]) for i, r in enumerate(chosen)])})"


OUT = scan.OUTPUT_CATEGORIES
_LEVEL = "case when risk_score >= 100 then 'CRITICAL' when risk_score >= 70 then 'HIGH' when risk_score >= 40 then 'MEDIUM' when risk_score > 0 then 'LOW' else 'NONE' end"


def _scan_sql(categories) -> str:
    return f"""with {CORPUS}, {_rules(categories)},
hits as (select doc_id, ord, name, category, severity from corpus join rules on regexp_matches(text, regex) where strlen(text) >= 10),
sums as (select doc_id, cast(sum(severity) as integer) as risk_score, list(name order by ord) as findings, list_sort(list(distinct category)) as categories from hits group by doc_id)
select doc_id, risk_score_ is null as is_safe, coalesce(risk_score_, 0) as risk_score, case when strlen(text) < 10 then '' else {_LEVEL.replace('risk_score', 'coalesce(risk_score_, 0)')} end as risk_level,
coalesce(findings, []) as findings, coalesce(categories, []) as categories from corpus left join (select doc_id, risk_score as risk_score_, findings, categories from sums) using (doc_id)"""


def _nested_replace(column: str) -> str:
    for kind, regex in scan.redactors()[0]:
        column = f"regexp_replace({column}, '" + regex.replace("'", "''") + f"', '[{kind}_REDACTED]', 'g')"
    return column


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUERIES = {
    "p1_match_all": lambda s, d: scan.match_all(corpus(s, d), scan.rules()).drop("text"),
    "p2_match_any": lambda s, d: scan.match_any(corpus(s, d), scan.rules(INPUT_CATEGORIES)).select("doc_id", "name"),
    "p3_rules_by_category": lambda s, d: scan.match_all(corpus(s, d), scan.rules()).groupBy("category").agg(F.count_distinct("name").alias("rules_hit"), F.count("*").alias("hits"), F.count_distinct("doc_id").alias("texts")),
    "o1_scan_output": lambda s, d: scan.scan_output(corpus(s, d), scan.rules(OUT)),
    "o2_scan_output_categories": lambda s, d: scan.scan_output(corpus(s, d), scan.rules(INPUT_CATEGORIES)),
    "o3_scan_output_quick": lambda s, d: scan.match_any(corpus(s, d).filter(F.octet_length("text") >= 10), scan.rules(OUT)).select("doc_id", F.col("name").isNull().alias("safe"), F.coalesce("description", F.lit("")).alias("reason")),
    "o4_finding_excerpt": lambda s, d: scan.excerpts(corpus(s, d), scan.rules(OUT)),
    "o5_redact_secrets": lambda s, d: scan.redact_secrets(corpus(s, d)).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), "was_redacted"),
    "o6_redaction_counts": lambda s, d: scan.redaction_counts(corpus(s, d)),
    "o7_crypto_score": lambda s, d: corpus(s, d).select("doc_id", scan.crypto_score(F.col("text")).alias("crypto_score")),
    "f8_risk_level": lambda s, d: scan.scan_output(corpus(s, d), scan.rules(OUT)).groupBy("risk_level").agg(F.count("*").alias("texts"), F.max("risk_score").alias("highest")),
}

_ORDERED, _ADDRESS, _VERSION = scan.redactors()
ORACLE = {
    "p1_match_all": f"with {CORPUS}, {_rules(None)} select doc_id, ord, name, category, severity, description from corpus join rules on regexp_matches(text, regex)",
    "p2_match_any": f"with {CORPUS}, {_rules(INPUT_CATEGORIES)}, hits as (select doc_id, arg_min(name, ord) as name from corpus join rules on regexp_matches(text, regex) group by doc_id) select doc_id, name from corpus left join hits using (doc_id)",
    "p3_rules_by_category": f"with {CORPUS}, {_rules(None)} select category, count(distinct name) as rules_hit, count(*) as hits, count(distinct doc_id) as texts from corpus join rules on regexp_matches(text, regex) group by category",
    "o1_scan_output": _scan_sql(OUT),
    "o2_scan_output_categories": _scan_sql(INPUT_CATEGORIES),
    "o3_scan_output_quick": f"with {CORPUS}, {_rules(OUT)}, hits as (select doc_id, arg_min(description, ord) as reason from corpus join rules on regexp_matches(text, regex) group by doc_id) select doc_id, reason is null as safe, coalesce(reason, '') as reason from corpus left join hits using (doc_id) where strlen(text) >= 10",
    "o4_finding_excerpt": f"""with {CORPUS}, {_rules(OUT)}, found as (select doc_id, name, category, severity, description, regexp_extract(text, regex, 0) as m from corpus join rules on regexp_matches(text, regex)),
shown as (select *, case when category = 'credential' and strlen(m) <= 10 then '[REDACTED]' when category = 'credential' then left(m, 4) || '...' || right(m, 4) || '[REDACTED]' when strlen(m) > 50 then left(m, 47) || '...' else m end as excerpt from found)
select doc_id, name, category, severity, excerpt, description || ': ' || case when strlen(excerpt) > 30 then left(excerpt, 27) || '...' else excerpt end as finding from shown""",
    "o5_redact_secrets": f"""with {CORPUS}, once as (select doc_id, text, {_nested_replace('text')} as r from corpus),
last as (select doc_id, text, case when regexp_matches(r, {_quoted(_VERSION)}) then r else regexp_replace(r, {_quoted(_ADDRESS)}, '[IP_ADDRESS_REDACTED]', 'g') end as redacted from once)
select doc_id, sha256(redacted) as redacted_sha256, redacted <> text as was_redacted from last""",
    "o6_redaction_counts": f"""with {CORPUS}, kinds(kind, regex) as (values {sql_values([*_ORDERED, ('IP_ADDRESS', _ADDRESS)])})
select kind, cast(count(*) filter (n > 0) as bigint) as texts, cast(sum(n) as bigint) as places from (select kind, len(regexp_extract_all(text, regex)) as n from corpus, kinds) group by kind""",
    "o7_crypto_score": f"""with {CORPUS}, literals(k, v) as (values {sql_values([(k, float(v)) for k, v in rows('crypto')])})
select doc_id, least(50.0::double, sum(case when contains(text, k) then v else 0 end)::double) as crypto_score from corpus, literals group by doc_id""",
    "f8_risk_level": f"with {CORPUS}, s as ({_scan_sql(OUT)}) select risk_level, count(*) as texts, max(risk_score) as highest from s group by risk_level",
}
