"""Secret scans with multipart credential linking, in DataFrame functions alone.

Three base kinds are always reported: assignments, access keys and long hex runs. Three weak kinds (account names, long
mixed blobs, addresses of services) are candidates: an interval join over places in a text reports one only if complementary
parts lie within `scope` characters of it: an account name needs a secret, a blob an identifier, an address both. A candidate that
overlaps a base span is left out.

A text's matches become rows before anything is summed or compared, so a text with many matches costs no more a match than one with few.
The join is linear too: parts are reduced to the first and last place of each role in every stretch of `scope` characters, and a
candidate looks at its own stretch and the two beside it. Neither a text with many parts nor a hot source makes pairs.

Defined results: null counts as empty text (no spans); rows that repeat are scanned each, under a row number of their own; places
are in code points, ends exclusive; other columns are not read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Characters within which parts of one credential lie.
SCOPE = 300

#: Fixed values of the base kinds: kind, pattern, group whose length counts, least length. Java and RE2 read them alike.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: The weak kinds.
WEAK = (
    ("account", r"""(?i:\b(user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+))""", 2, 4),
    ("blob", r"(\b[A-Za-z0-9+/]{12,}[0-9+/][A-Za-z0-9+/]{12,}={0,2})", 1, 32),
    ("endpoint", r"""((?i:https?|ftp|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[A-Za-z0-9_.@:/-]+)""", 1, 10),
)
KINDS = [x[0] for x in (*BASE, *WEAK)]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "blob": "secret", "endpoint": "endpoint"}
#: Roles that a weak part needs beside it.
NEEDS = {"account": ("secret",), "blob": ("identifier",), "endpoint": ("identifier", "secret")}


def steps(text: Column, pattern: str, group: int) -> Column:
    """array<struct<gap, size, value>> of the leftmost matches that don't overlap: characters before each since the last one, its length, its value's."""
    kind = "array<struct<gap:int,size:int,value:int>>"
    # Zipped, so that both lists are made once: there is one gap more than matches, after the last.
    pairs = F.arrays_zip(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"))
    each = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(F.regexp_extract(x["m"], pattern, group)).alias("value")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast(kind)).cast(kind)


def places(found: DataFrame) -> DataFrame:
    """(row, kind, ord, start, end) of the matches that are long enough. found: row, and steps in a column for each kind."""
    specs = [*BASE, *WEAK]
    each = F.array(*(F.struct(F.lit(spec[0]).alias("kind"), F.lit(i).alias("ord"), F.lit(spec[3]).alias("least"), F.col(spec[0]).alias("steps")) for i, spec in enumerate(specs)))
    rows = found.select("row", F.inline(F.filter(each, lambda x: F.size(x["steps"]) > 0)))
    rows = rows.select("row", "kind", "ord", "least", F.posexplode("steps").alias("i", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(W.partitionBy("row", "ord").orderBy("i")).cast("int")
    rows = rows.withColumn("end", end).filter(F.col("x.value") >= F.col("least"))
    return rows.select("row", "kind", "ord", (F.col("end") - F.col("x.size")).alias("start"), "end")


def apart(parts: DataFrame) -> DataFrame:
    """parts without the weak ones that overlap a base one of their row."""
    # Both frames grow from their first row on, so each is one pass over the text's matches.
    base, w = F.col("ord") < len(BASE), W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(base, F.col("end"))).over(w)
    following = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0))
    met = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (following < F.col("end"))
    rows = parts.withColumn("base", base).withColumn("met", F.coalesce(met, F.lit(False)))
    return rows.filter("base or not met").drop("base", "met")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that are reported. parts: row, kind, start, end (any number a row)."""
    role = F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.col("kind"))
    parts = parts.withColumn("role", role).withColumn("stretch", F.floor(F.col("start") / scope).cast("long"))
    beside = parts.groupBy("row", "role", "stretch").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = parts.filter(F.col("kind").isin([x[0] for x in WEAK]))
    need = F.element_at(F.create_map(*(y for k, v in NEEDS.items() for y in (F.lit(k), F.array(*map(F.lit, v))))), F.col("kind"))
    asked = weak.select("row", "kind", "start", "end", F.explode(need).alias("role"), "stretch")
    asked = asked.select("row", "kind", "start", "end", "role", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    met = asked.join(beside, ["row", "role", "stretch"]).filter(near)
    met = met.groupBy("row", "kind", "start", "end").agg(F.count_distinct("role").alias("roles"))
    return met.filter(F.col("roles") == F.element_at(F.create_map(*(F.lit(y) for k, v in NEEDS.items() for y in (k, len(v)))), F.col("kind"))).drop("roles")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, base (array of base spans) and spans (base and linked ones), each start, ord, end, kind, in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = rows.select("id", *(steps(F.col("text"), *spec[1:3]).alias(spec[0]) for spec in (*BASE, *WEAK)))
    found = C.written(found.select(F.monotonically_increasing_id().alias("row"), "*"))
    parts = C.written(apart(places(found)))
    span = F.struct("start", "ord", "end", "kind")
    more = linked(parts.drop("ord"), scope).withColumn("ord", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
    base = parts.filter(F.col("ord") < len(BASE)).select("row", span.alias("x"))
    every = base.select("row", "x", F.lit(True).alias("b")).unionByName(more.select("row", span.alias("x"), F.lit(False).alias("b")))
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("b"), F.col("x")))).alias("base"), F.array_sort(F.collect_list("x")).alias("spans"))  # bounded by the text
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return found.select("row", "id").join(lists, "row", "left").select(F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def without_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the scan replaced by [kind]; columns stay as they are, whatever their names; null text stays null.

    Overlapping spans are one, named by its first. Rows without spans are untouched: those in which no pattern is found are neither written nor joined.
    """
    columns = docs.columns
    row, cuts = C.unused("_row", columns), C.unused("_cuts", columns)
    maybe = functools.reduce(operator.or_, (F.coalesce(F.col(f"`{text_col}`").rlike(spec[1]), F.lit(False)) for spec in (*BASE, *WEAK)))
    rows = C.written(docs.filter(maybe).select(F.monotonically_increasing_id().alias(row), *(F.col(f"`{c}`") for c in columns)))
    found = scan(rows.select(F.col(row).alias("of"), F.col(f"`{text_col}`").alias("text")), scope, "of", "text").select("of", F.explode("spans").alias("x"))
    # A span starts a new hole unless it overlaps an earlier one of its text; a hole ends where the last of its spans does.
    w = W.partitionBy("of").orderBy("x.start", "x.ord")
    reach = F.coalesce(F.max("x.end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    holes = found.withColumn("reach", reach).withColumn("hole", F.sum((F.col("x.start") >= F.col("reach")).cast("int")).over(w))
    holes = holes.groupBy("of", "hole").agg(F.min(F.struct("x.start", "x.ord", "x.kind")).alias("first"), F.max("x.end").alias("end"))
    before = F.coalesce(F.lag("end").over(W.partitionBy("of").orderBy("hole")), F.lit(0))
    holes = holes.select("of", "end", F.struct("hole", before.alias("from"), F.col("first.start").alias("to"), F.concat(F.lit("["), F.col("first.kind"), F.lit("]")).alias("mark")).alias("x"))
    lists = holes.groupBy(F.col("of").alias(row)).agg(F.array_sort(F.collect_list("x")).alias("cut"), F.max("end").alias("last"))
    lists = lists.select(row, F.struct("cut", "last").alias(cuts))
    text, own = F.col(f"`{text_col}`"), F.col(cuts)
    # Cut in a form of four bytes a character, made once a text, where a place is found without counting through what is before it.
    part = lambda b, lo, n: F.decode(F.substring(b, 4 * lo + 1, 4 * n), "UTF-32")
    piece = lambda b: F.transform(own["cut"], lambda x: F.concat(part(b, x["from"], x["to"] - x["from"]), x["mark"]))
    done = F.transform(F.array(F.encode(text, "UTF-32")), lambda b: F.concat(F.array_join(piece(b), ""), part(b, own["last"], F.length(text))))
    clean = F.when(own.isNull(), text).otherwise(F.get(done, 0))
    masked = rows.join(lists, row, "left").select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns))
    return docs.filter(~maybe).select(*(F.col(f"`{c}`") for c in columns)).union(masked)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["ord"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{x[0]}") for i, x in enumerate(BASE)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_places(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = r"(?s:(.*?))(" + pattern.replace("'", "''") + ")"
    return f"""
select rid, '{kind}' as kind, {order} as ord, start, start + size as stop from (
  select rid, size, value, sum(gap + size) over (partition by rid order by i) - size as start from (
    select rid, unnest(range(1, len(g) + 1)) as i, unnest(list_transform(g, lambda x: length(x))) as gap, unnest(list_transform(m, lambda x: length(x))) as size, unnest(list_transform(v, lambda x: length(x))) as value
    from (select rid, regexp_extract_all(text, '{quoted}', 1) as g, regexp_extract_all(text, '{quoted}', 2) as m, regexp_extract_all(text, '{quoted}', {group + 2}) as v from docs)))
where value >= {least}"""


ORACLE_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as ({' union all '.join(_sql_places(i, *x) for i, x in enumerate(BASE))}),
weak_all as ({' union all '.join(_sql_places(i + len(BASE), *x) for i, x in enumerate(WEAK))}),
weak as (select * from weak_all w where not exists (select 1 from base b where b.rid = w.rid and b.start < w.stop and w.start < b.stop)),
parts as (select *, case kind {' '.join(f"when '{k}' then '{v}'" for k, v in ROLES.items())} end as part from (select * from base union all select * from weak)),
met as (select w.rid, w.kind, w.ord, w.start, w.stop from weak w join parts p on p.rid = w.rid and abs(p.start - w.start) <= {SCOPE}
        and ((w.kind = 'account' and p.part = 'secret') or (w.kind = 'blob' and p.part = 'identifier') or (w.kind = 'endpoint' and p.part in ('identifier', 'secret')))
        group by all having count(distinct p.part) = case w.kind when 'endpoint' then 2 else 1 end),
every as (select *, true as is_base from base union all select *, false from met)
select doc_id, cast(count(*) filter (kind = 'assign') as bigint) as n_assign, cast(count(*) filter (kind = 'access') as bigint) as n_access, cast(count(*) filter (kind = 'hex') as bigint) as n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (is_base), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord), '') as spans
from docs left join every using (rid) group by rid, doc_id
"""

QUERIES = {"op8_secrets": op8_secrets}
ORACLE = {"op8_secrets": ORACLE_SQL}
