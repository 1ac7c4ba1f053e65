"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contamination
from .licences import licences
from .line_dedup import LONG_LINE, line_dedup
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .quality_rules import RULES, quality_rules
from .substring_dedup import substring_dedup
from .token_files import token_digest
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(operator, *tables: str, **options) -> Query:
    return lambda spark, sf_dir: operator(*(_table(spark, sf_dir, t) for t in tables), **options)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": _over(substring_dedup, "documents", with_text=False),
    "op2_licences": _over(licences, "documents"),
    "op3_toxicity": _over(toxicity, "documents", "labels"),
    "op4_near_duplicates": _over(near_duplicates, "documents"),
    "op5_quality": _over(quality, "documents", "labels"),
    "op6_contamination": _over(contamination, "documents", "benchmark"),
    "op7_line_dedup": _over(line_dedup, "documents"),
    "op7_line_dedup_long_lines": _over(line_dedup, "documents", min_words=LONG_LINE),
    "op8_quality_rules": _over(quality_rules, "documents"),
    "op9_token_files": _over(token_digest, "documents"),
    "op10_packing": _over(pack, "documents"),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FAILS = " + ".join(f"(case when {r.fails} then {1 << r.bit} else 0 end)" for r in RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
with w as (select doc_id, {_WORDS} as ws from documents),
win as (select doc_id, i, min(doc_id) over (partition by k) as first
        from (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k
              from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w))),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win where first < doc_id)),
word as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by p) filter (where g.p is null) as kept
         from word left join gone g using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)""",
    "op7_line_dedup": r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents where text is not null),
k as (select *, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') as key from l),
n as (select *, row_number() over (partition by doc_id order by p) - 1 as pos, lead(key) over (partition by doc_id order by p) as after_it from k where key <> ''),
r as (select doc_id, pos, first_value(doc_id) over f as d0, first_value(pos) over f as a0 from n where after_it is not null
      window f as (partition by key, after_it order by doc_id, pos)),
later as (select doc_id, pos from r where (doc_id > d0 or (doc_id = d0 and pos >= a0 + 2))),
gone as (select distinct doc_id, pos from (select doc_id, pos from later union all select doc_id, pos + 1 from later)),
j as (select k.doc_id, k.p, k.line, n.pos, gone.pos is not null as g from k left join n on k.doc_id = n.doc_id and k.p = n.p left join gone on n.doc_id = gone.doc_id and n.pos = gone.pos)
select d.doc_id, coalesce(count(j.pos), 0)::bigint as n_lines, coalesce(count_if(j.g), 0)::bigint as n_removed,
       case when d.text is null then null else coalesce(string_agg(j.line, chr(10) order by j.p) filter (where not j.g), '') end as kept_text
from documents d left join j on d.doc_id = j.doc_id group by d.doc_id, d.text""",
    "op8_quality_rules": f"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, k) as n
        from (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w))),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from win where n > 1) group by doc_id),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
             (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals,
             (length(text) - length(replace(text, '!', '')))::bigint as n_exclamations
      from w left join rep using (doc_id)),
b as (select *, ({_FAILS})::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       fail_bits = 0 as kept, fail_bits, n_lines, n_capitals, n_exclamations
from b""",
}
