"""A guarded read-only SQL surface over views, query templates, and functions that SQL can call."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import params as P

FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|replace|truncate|attach|detach|pragma|merge|grant|revoke|call|set|reset|cache|uncache|refresh|load|use|analyze|msck|add)\b", re.I)


def check_sql(sql: str) -> str | None:
    """Why a query is refused; None if it is fine. One SELECT or WITH, no words that change anything."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if len(text) < 7:
        return "too short"
    if not re.match(r"(?i)(select|with)\b", text):
        return "only SELECT or WITH"
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare:
        return "one statement only"
    if m := FORBIDDEN.search(bare):
        return f"forbidden word {m[1].lower()}"
    return None


def run_sql(spark: SparkSession, sql: str, most: int = 500, args: dict | None = None) -> tuple[DataFrame, bool]:
    """Up to `most` rows and whether there were more. The cap is the feature: an interactive answer."""
    if why := check_sql(sql):
        raise ValueError(why)
    out = spark.sql(sql.strip().rstrip(";"), args=args or {})
    return out.limit(most), out.limit(most + 1).count() > most


TEMPLATES = {
    "rank_history": "select date, rank from rankings where bundle_id = :bundle_id and chart_type = :chart_type order by date",
    "chart_of_day": "select rank, game_name, bundle_id from rankings where date = :date and platform = :platform and chart_type = :chart_type order by rank",
    "dates": "select distinct date from rankings order by date desc",
    "significant_changes": "select * from changes where date = :date and is_significant order by attention_score desc",
    "change_history": "select date, change_type, rank_change from changes where bundle_id = :bundle_id order by date desc",
    "recent_searches": "select query, engine, result_count, searched_at from search_cache order by searched_at desc, query, engine, result_count limit 10",
}


def template(spark: SparkSession, name: str, **args) -> DataFrame:
    return spark.sql(TEMPLATES[name], args=args)


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions that Catalyst sees through."""
    for sql in (
        # letters alone need word bounds, all else is a part of the text
        "create or replace temporary function keyword_match(t string, w string) returns boolean return coalesce(trim(w) <> '' and case when lower(trim(w)) rlike '^[a-z]+$' then lower(t) rlike concat('(^|[^a-z0-9_])', lower(trim(w)), '([^a-z0-9_]|$)') else contains(lower(t), lower(trim(w))) end, false)",
        "create or replace temporary function url_canonical(u string) returns string return lower(regexp_replace(u, '[?#].*$', ''))",
        "create or replace temporary function topic_key(h string) returns string return coalesce(nullif(regexp_extract(h, '《([^》]+)》', 1), ''), substr(trim(h), 1, 20))",
        "create or replace temporary function attention_band(r int) returns int return case when r <= 3 then 50 when r <= 5 then 35 when r <= 10 then 20 when r <= 30 then 10 when r <= 50 then 5 else 2 end",
        _dedup_tokens(), _body_signals(), _source_canonical(), _attention(),
    ):
        spark.sql(sql)


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _dedup_tokens() -> str:
    clean = "t"
    for prefix in P.TITLE_PREFIXES:
        clean = f"replace({clean}, '{prefix}', '')"
    words = f"array_union(regexp_extract_all({clean}, r'([\\x{{4e00}}-\\x{{9fff}}]{{4,}})', 1), transform(filter(regexp_extract_all({clean}, '([A-Za-z]+)', 1), x -> length(x) >= 4), x -> lower(x)))"
    tokens = f"array_union(array_distinct(regexp_extract_all({clean}, '《([^》]+)》', 1)), array_except({words}, array({_list(P.NOISE_WORDS)})))"
    return f"create or replace temporary function dedup_tokens(t string) returns array<string> return array_distinct(transform({tokens}, x -> lower(x)))"


def _body_signals() -> str:
    facts = f"least(20, regexp_count(b, r'[0-9]+\\.?[0-9]*') + regexp_count(b, '《[^》]+》') + size(filter(array({_list(P.COMPANIES)}), c -> contains(b, c))))"
    marks = " ".join(f"when contains(b, '{m}') then '{v}'" for m, v in P.FRESH_MARKS)
    month, old = "regexp_extract(b, '([0-9]+)月', 1)", "try_cast(nullif(regexp_extract(b, r'(?:^|[^0-9])([0-9]{4})\\s*年', 1), '') as int)"
    fresh = f"case {marks} when {month} <> '' then concat({month}, '月') when contains(b, '去年') or {old} < y then '去年或更早' else '未标注' end"
    digest = " or ".join(f"contains(b, '{w}')" for w in P.DIGEST_WORDS)
    return f"create or replace temporary function body_signals(b string, y int) returns struct<facts: int, fresh: string, digest: boolean> return named_struct('facts', {facts}, 'fresh', {fresh}, 'digest', {digest})"


def _source_canonical() -> str:
    names = " ".join(f"when '{k}' then '{v}'" for k, v in (P.SOURCE_ALIASES | {n.lower(): n for n in P.SOURCE_ORDER}).items())
    return f"create or replace temporary function source_canonical(s string) returns string return case when lower(trim(s)) in ({_list(P.REMOVED_SOURCES)}) then null else case lower(trim(s)) {names} else trim(s) end end"


def _attention() -> str:
    """The points of operators.charts.attention_tenths, without a topic's."""
    rank, before, delta = "coalesce(today, yesterday, 99)", "coalesce(nullif(yesterday, 0), 99)", "abs(coalesce(change, 0))"
    band = f"case when {rank} <= 3 then 50 when {rank} <= 5 then 35 when {rank} <= 10 then 20 when {rank} <= 30 then 10 when {rank} <= 50 then 5 else 2 end"
    entry, drop = f"case when {rank} <= 10 then 50 when {rank} <= 50 then 35 else 20 end", f"case when {before} <= 10 then 40 when {before} <= 30 then 20 else 5 end"
    near = f"case when {rank} <= 5 and {delta} >= 1 then 15 when {rank} <= 10 and {delta} >= 3 then 10 else 0 end"
    far = f"case when {delta} >= 20 then 35 when {delta} >= 10 then 20 when {delta} >= 5 then 10 else 3 end"
    climb = f"case when kind = 'up' then case when {before} > 30 and {delta} >= 10 then 20 else 0 end + case when {before} > 50 and {delta} >= 5 then 10 else 0 end else 0 end"
    points = f"{band} + case when kind = 'new_entry' then {entry} when kind = 'dropped_out' then {drop} when kind in ('up', 'down') then {near} + {far} + {climb} else 0 end"
    return f"create or replace temporary function attention_tenths(kind string, today int, yesterday int, change int) returns int return least({points}, 100)"
