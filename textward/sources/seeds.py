"""Seed files of five layouts as one table, default severities, and seeds of intents.

Seed files are JSON documents whose maps have keys of their own (patterns, phases, categories), so they are read as VARIANT values and exploded
as such; no schema names the keys. Whatever a layout does not have gives no rows, and text that is no JSON gives none either.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions import tables
from textward.operators.lexical import seed_language

#: Severity of seeds whose layout has none, and what marks harmless ones.
DEFAULT_SEVERITY, BENIGN = 0.85, "benign"
#: Category and severity where a seed states none; other categories have the last.
LEVELS = (
    ("instruction_override", 0.9), ("data_exfil", 0.9), ("system_access", 0.9), ("mcp_injection", 0.9), ("goal_hijacking", 0.9), ("code_execution", 0.9),
    ("roleplay_attack", 0.7), ("obfuscation", 0.7), ("encoding_attack", 0.7), ("trust_exploitation", 0.7), ("rag_poisoning", 0.7),
)
OTHER_LEVEL = 0.5
#: Harmless category and its intent; other harmless ones are conversational, all risks are attacks.
INTENTS = (("technical_troubleshooting", "TECHNICAL"), ("creative_writing", "CREATIVE"), ("typo_correction", "CONVERSATIONAL"), ("conversational", "CONVERSATIONAL"))

_COLUMNS = "category string, phase string, severity double, text string, language string, tags array<string>"


def _map(of: str, key: str, name: str) -> str:
    return f"lateral variant_explode(variant_get({of}, '$.{key}', 'variant')) {name}"


def _parts(layout: str) -> list[str]:
    """The SELECT statements of a layout over files (v variant): category, phase, severity, text, language, tags."""
    get = lambda of, key, kind="string": f"variant_get({of}, '$.{key}', '{kind}')"
    benign = lambda key, *tags: f"select 'benign_' || b.key, cast(null as string), 0.0d, cast(e.value as string), cast(null as string), array({', '.join(map(repr, tags))}, b.key) from {{files}}, {_map('v', key, 'b')}, lateral variant_explode(b.value) e"
    if layout == "multiturn":
        severity = f"coalesce({get('p.value', 'severity', 'double')}, 0.0d) * coalesce({get('q.value', 'threshold', 'double')}, 0.0d)"
        return [
            f"select 'multiturn_' || p.key, q.key, {severity}, cast(e.value as string), cast(null as string), array('multiturn', p.key, q.key) from {{files}}, {_map('v', 'patterns', 'p')}, {_map('p.value', 'phases', 'q')}, {_map('q.value', 'examples', 'e')}",
            benign("benign_patterns", "benign"),
        ]
    if layout == "semantic":
        severity = f"case when contains(b.key, '{BENIGN}') then 0.0d else {DEFAULT_SEVERITY}d end"
        return [f"select b.key, cast(null as string), {severity}, cast(e.value as string), cast(null as string), array('semantic', b.key) from {{files}}, {_map('v', 'risk_vectors', 'b')}, lateral variant_explode(b.value) e", benign("benign_vectors", "semantic", "benign")]
    category, text = get("e.value", "category"), get("e.value", "text")
    severity = f"coalesce({get('e.value', 'severity', 'double')}, 0.0d)"
    if layout == "agentic":
        return [f"select {category}, cast(null as string), {severity}, {text}, cast(null as string), array_compact(array('agentic', {category})) from {{files}}, {_map('v', 'seed_data', 'e')}"]
    if layout == "injection":
        severity = f"case when {category} = '{BENIGN}' then 0.0d else {DEFAULT_SEVERITY}d end"
        return [f"select {category}, cast(null as string), {severity}, {text}, {get('e.value', 'lang')}, array_compact(array('injection', {category}, {get('e.value', 'lang')})) from {{files}}, {_map('v', 'seed_data', 'e')}"]
    if layout == "generic":
        return [f"select {category}, cast(null as string), {severity}, {text}, cast(null as string), coalesce({get('e.value', 'tags', 'array<string>')}, array()) from {{files}}, {_map('v', 'seeds', 'e')}"]
    raise ValueError(f"no such layout: {layout}")


LAYOUTS = ("multiturn", "agentic", "injection", "semantic", "generic")


def load_seeds(spark: SparkSession, path: str, layout: str, lines: bool = False) -> DataFrame:
    """(category, phase, severity, text, language, tags) of the seed files under path, each a JSON document, or one a line.

    Severity: of multi-turn examples the pattern's times the phase's threshold; 0 for harmless seeds; where a layout has none 0.85; what a seed leaves out is 0.
    Language is the stated one, else told from the text.
    """
    files = spark.read.text(path, wholetext=not lines).select(F.try_parse_json("value").alias("v"))
    rows = functools.reduce(DataFrame.union, (spark.sql(part, files=files) for part in _parts(layout))).toDF(*(c.split()[0] for c in _COLUMNS.split(", ")))
    return rows.withColumn("language", F.coalesce("language", seed_language(F.coalesce("text", F.lit("")))))


def severity_by_category(seeds: DataFrame, levels: DataFrame | None = None, default: float = OTHER_LEVEL) -> DataFrame:
    """seeds with severities that are missing or 0 taken from a category dimension (category, level; LEVELS by default), else the default."""
    levels = levels if levels is not None else seeds.sparkSession.createDataFrame(list(LEVELS), "category string, level double")
    stated = F.when(F.col("severity") > 0, F.col("severity"))
    return seeds.join(levels, "category", "left").withColumn("severity", F.coalesce(stated, "level", F.lit(default))).drop("level").select(*seeds.columns)


def intent_of(category: Column) -> Column:
    """The intent of a seed category."""
    harmless = F.create_map(*(F.lit(x) for pair in INTENTS for x in pair))
    own = F.coalesce(F.try_element_at(harmless, F.regexp_replace(category, "^benign_", "")), F.lit("CONVERSATIONAL"))
    return F.when(category.startswith("benign_"), own).otherwise("ATTACK")


def intent_seeds(spark: SparkSession, seeds: DataFrame | None = None) -> DataFrame:
    """(text, intent, keywords) of seeds (category, text), or the built-in examples where there are none. keywords: words of over four bytes, in lower case."""
    built_in = spark.createDataFrame([(t, i, True) for i, t in tables.rows("intent_seeds")], "text string, intent string, built_in boolean")
    rows = built_in
    if seeds is not None:
        own = seeds.filter("text is not null").select("text", intent_of(F.coalesce("category", F.lit(""))).alias("intent"), F.lit(False).alias("built_in"))
        # The built-in ones count only if there is no other: asked of one row, in the plan.
        rows = own.unionByName(built_in.filter(own.agg(F.count("*").alias("n")).scalar() == 0))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.octet_length(w) > 4)
    return rows.select("text", "intent", words.alias("keywords"))
