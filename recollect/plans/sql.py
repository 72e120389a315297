"""Fragments of oracle SQL: the same text rules as the column functions, in RE2's syntax."""

from __future__ import annotations

from recollect.plans.fixtures import MODEL
from recollect.schemas import METADATA_MARKER

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NON_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def model(query: str) -> str:
    return MODEL + query


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def token_estimate(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NON_WS}+'))"


def excerpt(x: str, n: int) -> str:
    flat = f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"
    cut = rstrip(f"substr({flat}, 1, {n - 3})")
    return f"case when length({flat}) <= {n} then {flat} else {cut} || '...' end"


def term_list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def overlap(text: str, terms: list[str], scale: str = "1.0") -> str:
    return f"round(len(list_intersect(list_distinct({tokens(text)}), {term_list(terms)})) / {len(terms)}::double * {scale}, 4)"


def bm25(rows: str, terms: list[str], text: str = "body") -> str:
    """CTEs that end in `scored` (row_id, raw) over a relation `rows` with row_id and the text."""
    return f"""
, tok as (select row_id, {tokens(text)} as toks from {rows}), st as (select count(*) as n, avg(len(toks)) as avgdl from tok)
, ex as (select row_id, len(toks) as dl, unnest(toks) as term from tok)
, tf as (select row_id, term, count(*) as tf, any_value(dl) as dl from ex where term in (select unnest({term_list(terms)})) group by 1, 2)
, df as (select term, count(*) as df from tf group by 1)
, scored as (select row_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw from tf join df using (term) cross join st group by 1)
"""


BOOST = "case source_type when 'project_docs' then 1.0 when 'agent_session' then 0.75 else 0.85 end"
VISIBLE = "(l.source_path_or_alias is null or l.status not in ('missing', 'skipped'))"


def strip_search(x: str) -> str:
    t = rf"regexp_replace({x}, '\A{WS}+', '')"
    return rf"case when not starts_with({t}, '{METADATA_MARKER}') or not regexp_matches({t}, '\r?\n\s*\r?\n') then {x} else regexp_replace(regexp_replace({t}, '(?s)\A.*?\r?\n\s*\r?\n', ''), '\A{WS}+', '') end"


def strip_candidate(x: str) -> str:
    t = strip(x)
    return rf"case when not starts_with({t}, '{METADATA_MARKER} ') then {t} when regexp_matches({t}, '\n\s*\n') then {strip(rf"regexp_replace({t}, '(?s)\A.*?\n\s*\n', '')")} else '' end"


NORM_PATH = lambda x: f"lower(rtrim(replace(trim({x}), chr(92), '/'), '/'))"
