"""Queries over sources and sinks, and the smaller dimensions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.paths import shared_path
from textward.functions.tables import sql_values
from textward.operators import context as ctx
from textward.operators import lexical as lex
from textward.operators import scan
from textward.plans.planted import CORPUS, corpus, turns, TURN_ROWS
from textward.plans.scans import OUT, _rules
from textward.plans.scores import ORACLE as SCORES
from textward.sources import corpus as src
from textward.sources import seeds


def _written(s, d):
    path = shared_path(s)
    src.write_findings(scan.match_all(corpus(s, d), scan.rules(OUT)).drop("text"), path)
    return s.read.parquet(path).groupBy("category").agg(F.count("*").alias("findings"), F.sum("severity").alias("severity"))


def _requests(s, d):
    line = "to_json(named_struct('jsonrpc', '2.0', 'method', event_type, 'params', props, 'id', event_id)) as line"
    return src.read_jsonrpc_log(s.read.parquet(f"{d}/events.parquet").selectExpr(line), "line").groupBy("method").agg(F.count("*").alias("requests"), F.count_if(F.col("params").isNotNull()).alias("with_params"))


def _tool_texts(s, d):
    rows = turns(s, d).selectExpr("conv_id", "turn", "to_json(array(named_struct('type', 'text', 'text', text), named_struct('type', 'text', 'text', role))) as content")
    return src.tool_result_text(rows, "content").select("conv_id", "turn", F.sha2("result_text", 256).alias("sha"))


def _upserted(s, d):
    seeds = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id as id", "label", "0 as updated_at")
    newer = seeds.filter("id % 10 = 0").selectExpr("id", "label + 100 as label", "1 as updated_at")
    return src.delete_seeds(src.upsert_seeds(seeds, newer), seeds.filter("id % 7 = 0").select("id"))


def _judged(s, d):
    rows = corpus(s, d).selectExpr("doc_id", "case when pmod(doc_id, 4) = 0 then concat('reply {\"classification\":\"safe\",\"confidence\":0.', pmod(doc_id, 9) + 1, '} end') when pmod(doc_id, 4) = 1 then concat('0.', pmod(doc_id, 10)) when pmod(doc_id, 4) = 2 then 'unsafe: seen' else 'no idea' end as reply")
    return src.read_judge_log(rows, "reply").select("doc_id", "judge_class", "judge_confidence")


def _drifts(s, d):
    rows = turns(s, d).selectExpr("conv_id", "turn", "case when turn % 3 = 0 then concat('VERDICT: UNSAFE\\nDRIFT: 0.', turn % 10, '\\nREASON: r') when turn % 3 = 1 then 'drift detected here' else 'nothing' end as reply")
    return src.read_drift_log(rows, "reply").select("conv_id", "turn", "verdict", "drift")


def _signals(s, d):
    rows = corpus(s, d)
    parts = [lex.char_profile(rows).selectExpr("doc_id", "anomaly_score as score", "0.8D as confidence"), lex.entropy_anomaly(rows).selectExpr("doc_id", "coalesce(anomaly_score, 0) as score", "0.7D as confidence"), lex.structure_flags(rows).selectExpr("doc_id", "structure_score as score", "0.7D as confidence")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _seed_files(s, d):
    """Benchmark items as seed files of each layout, a JSON document a line, read back."""
    rows = s.read.parquet(f"{d}/benchmark.parquet").selectExpr("cast(item_id as string) as k", "text as t").filter("t is not null")
    level = "length(t) / 1000"
    documents = {
        "multiturn": f"named_struct('patterns', map('p' || k, named_struct('severity', {level}, 'phases', map('setup', named_struct('threshold', 0.5d, 'examples', array(t)), 'exploit', named_struct('threshold', 0.8d, 'examples', array(t, k))))), 'benign_patterns', map('b' || k, array(t)))",
        "agentic": f"named_struct('seed_data', array(named_struct('text', t, 'category', 'c' || k, 'severity', {level})))",
        "injection": "named_struct('seed_data', array(named_struct('text', t, 'category', if(length(t) > 200, 'benign', 'c' || k), 'lang', 'xx')))",
        "semantic": "named_struct('risk_vectors', map('c' || k, array(t), 'benign_' || k, array(k)), 'benign_vectors', map('creative_writing', array(t)))",
        "generic": f"named_struct('seeds', array(named_struct('text', t, 'category', 'c' || k, 'severity', {level}, 'tags', array('a', k)), named_struct('text', k, 'category', cast(null as string), 'severity', cast(null as double), 'tags', cast(null as array<string>))))",
    }
    path = shared_path(s)
    for layout, document in documents.items():
        rows.selectExpr(f"to_json({document}) as value").write.text(f"{path}/{layout}")
    found = [seeds.load_seeds(s, f"{path}/{layout}", layout, lines=True).withColumn("layout", F.lit(layout)) for layout in documents]
    return functools.reduce(DataFrame.unionByName, found).select("layout", "category", "phase", F.round("severity", 6).alias("severity"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.array_join("tags", ",").alias("tags"))


_SEEDS = """with r as (select item_id::varchar as k, text as t, length(text) / 1000 as l from benchmark where text is not null),
x as (select 'multiturn' as layout, 'multiturn_p' || k as category, 'setup' as phase, l * 0.5 as severity, t as text, 'multiturn,p' || k || ',setup' as tags from r
union all select 'multiturn', 'multiturn_p' || k, 'exploit', l * 0.8, unnest([t, k]), 'multiturn,p' || k || ',exploit' from r
union all select 'multiturn', 'benign_b' || k, null, 0, t, 'benign,b' || k from r
union all select 'agentic', 'c' || k, null, l, t, 'agentic,c' || k from r
union all select 'injection', case when length(t) > 200 then 'benign' else 'c' || k end, null, case when length(t) > 200 then 0 else 0.85 end, t, 'injection,' || case when length(t) > 200 then 'benign' else 'c' || k end || ',xx' from r
union all select 'semantic', 'c' || k, null, 0.85, t, 'semantic,c' || k from r
union all select 'semantic', 'benign_' || k, null, 0, k, 'semantic,benign_' || k from r
union all select 'semantic', 'benign_creative_writing', null, 0, t, 'semantic,benign,creative_writing' from r
union all select 'generic', 'c' || k, null, l, t, 'a,' || k from r
union all select 'generic', null, null, 0, k, '' from r)
select layout, category, phase, round(severity, 6)::double as severity, sha256(text) as sha, tags from x"""


def _categorised(s, d):
    """Documents as seeds: a category by their length, a severity by their source where they have a language."""
    names = F.array(*(F.lit(c) for c, _ in seeds.LEVELS), F.lit("other"), F.lit("benign_creative_writing"), F.lit("benign_technical_troubleshooting"), F.lit("benign_else"))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.get(names, F.coalesce(F.length("text"), F.lit(0)) % 15).alias("category"))
    return rows.withColumn("severity", F.when(F.length("text") % 2 == 0, 0.6).when(F.length("text") % 5 == 0, 0.0))


_CATEGORIES = f"cs as (select doc_id, text, [{', '.join(repr(c) for c, _ in seeds.LEVELS)}, 'other', 'benign_creative_writing', 'benign_technical_troubleshooting', 'benign_else'][coalesce(length(text), 0) % 15 + 1] as category, case when length(text) % 2 = 0 then 0.6 when length(text) % 5 = 0 then 0.0 end as severity from documents)"


QUERIES = {
    "s1_read_corpus": lambda s, d: src.read_corpus(s, f"{d}/pages.parquet", "page_id", "html").select("doc_id", F.octet_length("text").cast("long").alias("bytes")),
    "s2_rules_frame": lambda s, d: scan.match_all(corpus(s, d), scan.rules()).groupBy("name").agg(F.count("*").alias("hits")).join(src.rules_frame(s), "name").select("name", "category", "severity", "hits"),
    "s5_upsert_seeds": _upserted,
    "s6_write_findings": _written,
    "s7_read_jsonrpc_log": _requests,
    "s3_load_seeds": _seed_files,
    "s4_severity_default": lambda s, d: seeds.severity_by_category(_categorised(s, d)).select("doc_id", "severity"),
    "s11_intent_seeds": lambda s, d: seeds.intent_seeds(s, _categorised(s, d)).groupBy("intent").agg(F.count("*").alias("seeds"), F.sum(F.size("keywords").cast("long")).alias("keywords")),
    "s8_tool_result_text": _tool_texts,
    "s9_read_judge_log": _judged,
    "s10_read_drift_log": _drifts,
    "c14_intent_discount": lambda s, d: ctx.intent_discount(ctx.intents(corpus(s, d))).select("doc_id", "profile", F.round("discount", 6).alias("discount")),
    "f9_seed_language": lambda s, d: corpus(s, d).select("doc_id", lex.seed_language(F.col("text")).alias("language")),
    "l6_code_switching": lambda s, d: lex.code_switching(corpus(s, d)),
    "l8_combine_lexical": lambda s, d: lex.combine_lexical(_signals(s, d)).select("doc_id", F.round("score", 6).alias("score"), "is_threat"),
}
_SCRIPT = "regexp_extract(text, '[" + "".join(r for r, _ in lex.SEED_SCRIPTS) + "]', 0)"
ORACLE = {
    "s1_read_corpus": "select page_id as doc_id, cast(strlen(html) as bigint) as bytes from pages",
    "s2_rules_frame": f"with {CORPUS}, {_rules(None)} select name, category, severity, count(*) as hits from corpus join rules on regexp_matches(text, regex) group by all",
    "s5_upsert_seeds": "select vec_id as id, case when vec_id % 10 = 0 then label + 100 else label end as label, case when vec_id % 10 = 0 then 1 else 0 end as updated_at from embeddings where vec_id % 7 <> 0",
    "s6_write_findings": f"with {CORPUS}, {_rules(OUT)} select category, count(*) as findings, cast(sum(severity) as bigint) as severity from corpus join rules on regexp_matches(text, regex) group by category",
    "s7_read_jsonrpc_log": "select event_type as method, count(*) as requests, count(props) as with_params from events group by event_type",
    "s3_load_seeds": _SEEDS,
    "s4_severity_default": f"with {_CATEGORIES}, lv(category, level) as (values {sql_values(seeds.LEVELS)}) select doc_id, coalesce(case when severity > 0 then severity end, level, {seeds.OTHER_LEVEL})::double as severity from cs left join lv using (category)",
    "s11_intent_seeds": f"with {_CATEGORIES} select case category when 'benign_creative_writing' then 'CREATIVE' when 'benign_technical_troubleshooting' then 'TECHNICAL' when 'benign_else' then 'CONVERSATIONAL' else 'ATTACK' end as intent, count(*) as seeds, cast(sum(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: strlen(w) > 4))) as bigint) as keywords from cs where text is not null group by 1",
    "s8_tool_result_text": f"with {TURN_ROWS} select conv_id, turn, sha256(text || ' ' || role || ' ') as sha from turns",
    "s9_read_judge_log": f"with {CORPUS}, m as (select doc_id, ((doc_id % 4) + 4) % 4 as m, ((doc_id % 9) + 9) % 9 as k, ((doc_id % 10) + 10) % 10 as t from corpus) select doc_id, case m when 0 then 'SAFE' when 1 then case when t > 5 then 'MALICIOUS' else 'SAFE' end when 2 then 'MALICIOUS' end as judge_class, (case m when 0 then (k + 1) / 10 when 1 then t / 10 end)::double as judge_confidence from m",
    "s10_read_drift_log": f"with {TURN_ROWS} select conv_id, turn, case when turn % 3 = 0 then 'UNSAFE' end as verdict, (case turn % 3 when 0 then (turn % 10) / 10 when 1 then 0.8 else 0.5 end)::double as drift from turns",
    "c14_intent_discount": f"with i as ({SCORES['c11_intent_keywords']}), p(intent, profile, base) as (values {sql_values(ctx.INTENT_PROFILES)}) select doc_id, profile, round(base * intent_confidence, 6)::double as discount from i join p using (intent)",
    "f9_seed_language": f"with {CORPUS}, x as (select doc_id, text, lower(text) as low, {_SCRIPT} as c from corpus) select doc_id, coalesce(case {' '.join(f'''when regexp_matches(c, '[{r}]') then '{k}' ''' for r, k in lex.SEED_SCRIPTS)} end, case when regexp_matches(text, '[\\x{{C0}}-\\x{{17F}}]') then case {' '.join(f'''when regexp_matches(low, '{w}') then '{k}' ''' for w, k in lex.SEED_WORDS)} end end, 'en') as language from x",
}
