"""Queries over decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from textward.functions.tables import rows, sql_values
from textward.operators import decode as dec
from textward.plans.planted import CORPUS, corpus
from textward.plans.scores import _A, _any


def _one(name):
    def query(s, d):
        found = dec.decoded_once(corpus(s, d), {name: dec.DECODERS[name]})
        return found.select("doc_id", F.sha2("decoded_text", 256).alias("sha"))

    return query


def _attack(c: str) -> str:
    low = f"lower({c})"
    return f"(({_any(low, _A['override'])} and {_any(low, _A['instruction'])}) or {_any(low, _A['extraction'])} or {_any(low, _A['jailbreak'])} or {_any(low, _A['exfil'])})"


def _sql(expression: str) -> str:
    return f"with {CORPUS}, x as (select doc_id, text, {expression} as d from corpus) select doc_id, sha256(d) as sha from x where d is not null and d <> '' and d <> text"


_ROT = f"translate(text, '{dec._UPPER + dec._LOWER}', '{dec._UPPER[13:] + dec._UPPER[:13] + dec._LOWER[13:] + dec._LOWER[:13]}')"
_LEET = f"translate(text, '{dec.LEET_FROM}', '{dec.LEET_TO}')"


QUERIES = {
    **{f"d{i}_{n}": _one(n) for i, n in ((1, "base64"), (2, "hex"), (3, "url"), (4, "html_entity"), (5, "rot13"), (6, "homoglyph"), (7, "ascii_art"), (8, "reverse"), (9, "unicode_tags"), (10, "invisible"), (12, "unicode_escape"), (15, "leetspeak"))},
    "d11_d13_in_python": lambda s, d: dec.decoded_in_python(corpus(s, d)),
    "d14_typoglycemia": lambda s, d: dec.unscrambled(corpus(s, d)).select("doc_id", F.sha2("decoded_text", 256).alias("sha")),
    "d16_block_art": lambda s, d: dec.block_art(corpus(s, d)),
    "d17_deobfuscate_2pass": lambda s, d: dec.decoded_rollup(corpus(s, d), 2).select("doc_id", "layers", "types", F.sha2("decoded_text", 256).alias("sha")),
    "d18_deobfuscate_3pass": lambda s, d: dec.decoded_rollup(corpus(s, d), 3).select("doc_id", "layers", "types", "layer_sequence", F.array_join(F.map_values("segments"), " ").alias("segments"), F.sha2("decoded_text", 256).alias("sha")),
    "d19_layer_multiplier": lambda s, d: dec.decoded_rollup(corpus(s, d), 2).select("doc_id", "multiplier"),
    "d20_custom_decoder": lambda s, d: dec.deobfuscate(corpus(s, d), 1, {"upper": F.upper}).select("doc_id", "decoder", F.sha2("decoded_text", 256).alias("sha")),
    "f1_normalize_nfkc": lambda s, d: dec.normalize_nfkc(corpus(s, d)).select("doc_id", "was_normalized"),
    "f2_normalize_text_chain": lambda s, d: dec.normalize_chain(corpus(s, d)).select("doc_id", F.sha2("normalized", 256).alias("sha"), "steps"),
}
_VISIBLE = r"regexp_replace(text, '[\p{Cf}\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{20E3}]', '', 'g')"
_FIRSTS = "array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: left(trim(x), 1)), '')"
_BLANKS = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
_DRAWN = r"[|/_\-\\\[\](){}]"
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_ART = f"art as (select doc_id, string_agg(case when n > 5 and {_N('line', _DRAWN)} / n > 0.3 then '1' else '0' end, '' order by i) as marks from (select *, strlen(regexp_replace(line, '^{_BLANKS}|{_BLANKS}$', '', 'g')) as n from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from corpus)) where n > 0 group by doc_id)"
_SHAPE = "left({0}, 1) || '|' || right({0}, 1) || '|' || array_to_string(list_sort(string_split(substr({0}, 2, length({0}) - 2), '')), '')"
ORACLE = {
    "d5_rot13": _sql(f"case when regexp_matches(lower(text), '{'|'.join(dec.ROT_STEMS)}') then {_ROT} end"),
    "d6_homoglyph": _sql(f"translate(text, '{dec.LOOKALIKES}', '{dec.PLAIN}')"),
    "d8_reverse": _sql(f"case when {_attack('reverse(text)')} or regexp_matches(reverse(text), '^[A-Za-z0-9+/=]{{17,}}$') then reverse(text) end"),
    "d10_invisible": _sql(_VISIBLE),
    "d15_leetspeak": _sql(f"case when {_attack(_LEET)} then {_LEET} end"),
    "d7_ascii_art": _sql(f"case when len(string_split(text, chr(10))) >= 5 and length({_FIRSTS}) >= 5 and regexp_matches(lower({_FIRSTS}), '{'|'.join(dec.THREAT_WORDS)}') then {_FIRSTS} end"),
    "d16_block_art": f"with {CORPUS}, {_ART} select doc_id, strlen(text) >= 20 and (contains(coalesce(marks, ''), '111') or {_N('text', _DRAWN)} / strlen(text) > 0.4 or (strlen(text) > 20 and {_N('text', '[01 ' + chr(10) + ']')} / strlen(text) > 0.5 and {_N('text', '[01]')} / strlen(text) > 0.3)) as is_art from corpus left join art using (doc_id)",
    "f2_normalize_text_chain": f"""with {CORPUS}, a as (select doc_id, text as t0, regexp_replace(text, '\\p{{Cf}}', '', 'g') as t1 from corpus), b as (select *, translate(t1, '{dec._STYLED_FROM}', '{dec._STYLED_TO}') as t2 from a), c as (select *, translate(t2, '{dec.WRITTEN_FROM}', '{dec.WRITTEN_TO}') as t3 from b), e as (select *, trim(regexp_replace(t3, '{_BLANKS}', ' ', 'g')) as t4 from c)
select doc_id, sha256(t4) as sha, list_filter([case when t0 <> t1 then 'remove_invisible' end, case when t1 <> t2 then 'normalize_unicode' end, case when t2 <> t3 then 'char_substitution' end, case when t3 <> t4 then 'normalize_spacing' end], lambda x: x is not null) as steps from e""",
    "d14_typoglycemia": f"""with recursive {CORPUS}, tg(target, ord) as (values {sql_values([(w, i) for i, (w,) in enumerate(rows('scrambled'))])}),
sh as (select arg_min(target, ord) as target, {_SHAPE.format('target')} as shape from tg group by {_SHAPE.format('target')}),
w as (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) as word, generate_subscripts(regexp_extract_all(text, '[a-zA-Z]+'), 1) as pos from corpus),
fx as (select doc_id, word, target, row_number() over (partition by doc_id order by pos) as i from w join sh on length(word) >= 4 and {_SHAPE.format('lower(word)')} = shape where lower(word) <> target),
f as (select doc_id, 0::bigint as i, text from corpus where doc_id in (select doc_id from fx) union all select f.doc_id, fx.i, case when instr(text, word) > 0 then left(text, instr(text, word) - 1) || target || substr(text, instr(text, word) + length(word)) else text end from f join fx on fx.doc_id = f.doc_id and fx.i = f.i + 1)
select doc_id, sha256(arg_max(text, i)) as sha from f group by doc_id""",
    "d20_custom_decoder": f"with {CORPUS} select doc_id, 'upper' as decoder, sha256(upper(text)) as sha from corpus where upper(text) <> text and text <> '' and not contains(text, 'ß') union all select doc_id, 'upper', sha256(replace(upper(replace(text, 'ß', chr(1))), chr(1), 'SS')) from corpus where contains(text, 'ß')",
}
