"""Scalar expressions, over the articles and over literal rows that both engines share."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import params as P
from ..functions import scalars as S
from ..operators import keywords
from . import query

CJK = "[\\x{4e00}-\\x{9fff}]"
#: Literal rows: headlines and texts on which the CJK rules fire. They are joined to a few articles so that both kinds are covered.
LINES = (
    "游戏资讯《原神》联动 Steam 版本上线 Tencent", "[B站·热点] 腾讯 米哈游 周报：今日融资 12亿", "肉鸽TD新游 roguelike 塔防 6月29日", "「明日方舟」去年 2023年 公测",
    "女性向 恋与深空 2024-01-25 更新", "ATD gear std", "昨天 3天前 (4小时前) offer 版号审核", "热 版号 审批，长长长长长长长长长长长长长长长长长长。尾",
    "https://www.so.com/s?q=1", "", "Kingdom Rush 特惠 The Krafton Nexon", "2024年1月28日 AI 引擎 unity",
)
VALUES = "lines as (select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LINES)) + ") t(id, t) union all select doc_id + 1000, text from documents)"
AS_OF = "date '2024-01-30'"


def lines(spark, sf):
    told = spark.createDataFrame(list(enumerate(LINES)), "id long, t string")
    return told.unionByName(X.table(spark, sf, "documents").selectExpr("doc_id + 1000 as id", "text as t"))


def _s(body: str) -> str:
    return f"with {VALUES} {body}"


def over_lines(body: str):
    """Register f(rows) over the literal lines and the whole text of every article, with its SQL."""

    def add(f):
        def run(spark, sf):
            return f(lines(spark, sf))

        run.__name__ = f.__name__
        query(_s(body))(run)
        return f

    return add


def _in(words, fold=False) -> str:
    return "(" + " or ".join(f"contains({'lower(t)' if fold else 't'}, '{w.lower() if fold else w}')" for w in words) + ")"


def _joined(col):
    return F.array_join(F.array_sort(col), "|")


_RAW = "case user_id % 5 when 0 then concat(' ios', event_type, ' ') when 1 then concat('Android', event_type) when 2 then 'pc' when 3 then concat('x IOS ', event_type) else event_type end"


@query(f"with x as (select event_id, {_RAW} as raw from events) select event_id, raw, case when contains(upper(trim(raw)), 'IOS') then 'iOS' when contains(upper(trim(raw)), 'ANDROID') then 'Android' else upper(trim(raw)) end as platform from x")
def s1_platform(spark, sf):
    rows = X.table(spark, sf, "events").select("event_id", F.expr(_RAW).alias("raw"))
    return rows.withColumn("platform", S.normalize_platform(F.col("raw")))


@over_lines("select id, case when len(n) > 0 then array_to_string(list_sort(n), '|') else regexp_extract(t, '「([^」]+)」', 1) end as names from (select id, t, list_distinct(regexp_extract_all(t, '《([^》]+)》', 1)) n from lines)")
def s2_game_names(told):
    return told.select("id", _joined(S.game_names(F.col("t"))).alias("names"))


NOISE = "['" + "','".join(P.NOISE_WORDS) + "']"
STORY_NOISE = "['" + "','".join(P.STORY_NOISE) + "']"


def _words(col, cjk, ascii_):
    return f"list_filter(list_distinct(list_concat(regexp_extract_all({col}, '{CJK}{{{cjk},}}'), list_transform(list_filter(regexp_extract_all({col}, '[A-Za-z]+'), lambda x: length(x) >= {ascii_}), lambda x: lower(x)))), lambda x: not list_contains({NOISE}, x))"


@over_lines(f"select id, array_to_string(list_sort({_words('t', 2, 3)}), '|') as words from lines")
def s3_topic_words(told):
    return told.select("id", _joined(S.topic_words(F.col("t"))).alias("words"))


def _stripped(col="t"):
    for p in P.TITLE_PREFIXES:
        col = f"replace({col}, '{p}', '')"
    return col


TOKENS = f"list_distinct(list_transform(list_concat(regexp_extract_all(c, '《([^》]+)》', 1), {_words('c', 4, 4)}), lambda x: lower(x)))"


@over_lines(f"select id, array_to_string(list_sort({TOKENS}), '|') as tokens from (select id, {_stripped()} c from lines)")
def s4_dedup_tokens(told):
    return told.select("id", _joined(S.dedup_tokens(F.col("t"))).alias("tokens"))


@over_lines(f"select id, array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(lower(t), '[a-z]{{2,}}'), case when length(k) > 1 then list_transform(range(1, length(k)), lambda i: substr(k, i, 2)) else [] end)), lambda x: not list_contains({STORY_NOISE}, x))), '|') as tokens from (select id, t, regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') k from lines)")
def s5_similarity_tokens(told):
    return told.select("id", _joined(S.similarity_tokens(F.col("t"))).alias("tokens"))


@over_lines(f"select id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(t, '[A-Z][a-z]{{2,}}(?:[A-Z][a-z]+)*'), lambda x: not list_contains(['{chr(39) + chr(44) + chr(39)}'], x)), list_filter({list(P.ENTITY_COMPANIES)}, lambda c: contains(t, c))))), '|') as entities from lines".replace("['" + "','" + "']", str(list(P.ENTITY_STOP))))
def s6_entities(told):
    return told.select("id", _joined(S.named_entities(F.col("t"))).alias("entities"))


FACTS = f"least(20, len(regexp_extract_all(b, '[0-9]+\\.?[0-9]*')) + len(regexp_extract_all(b, '《[^》]+》')) + len(list_filter({list(P.COMPANIES)}, lambda c: contains(b, c))))"
FRESH = "case " + " ".join(f"when contains(b, '{m}') then '{v}'" for m, v in P.FRESH_MARKS) + " when regexp_extract(b, '([0-9]+)月', 1) <> '' then regexp_extract(b, '([0-9]+)月', 1) || '月' when contains(b, '去年') then '去年或更早' when try_cast(regexp_extract(b, '(?:^|[^0-9])([0-9]{4})\\s*年', 1) as int) < 2024 then '去年或更早' else '未标注' end"
DIGEST = "(" + " or ".join(f"contains(b, '{w}')" for w in P.DIGEST_WORDS) + ")"
SIGNAL = f"greatest(0, least(100, 40 + case when n <= 100 then -15 when n > 500 then 5 else 0 end + case when n = 0 then -10 when facts >= 5 then 10 when facts >= 2 then 5 when facts = 0 then -10 else 0 end + case when digest then -10 else 0 end + case when fresh in ('今日','昨日') then 10 when fresh in ('上周','上月','去年或更早') then -10 else 0 end))"
BODY = f"sig0 as (select *, length(b) n, {FACTS} facts, {FRESH} fresh, {DIGEST} digest from body)"


@over_lines(f", body as (select id, t as b from lines), {BODY} select id, cast(facts as int) as facts, fresh, digest from sig0")
def s7_body_signals(told):
    b = F.col("t")
    return told.select("id", S.fact_count(b).cast("int").alias("facts"), S.freshness(b, 2024).alias("fresh"), S.is_digest(b).alias("digest"))


@over_lines(f", body as (select id, t as b from lines), {BODY} select id, cast({SIGNAL} as int) as signal from sig0")
def s8_signal_score(told):
    return told.select("id", S.signal_score(F.col("t"), 2024).cast("int").alias("signal"))


FUSE = lambda score: f"case when s < 20 and {score} > 60 then least(f, 59) else f end"
EVEN = "cast(case when abs(x10 % 10) = 5 then 2 * round(x10 / 20.0) else round(x10 / 10.0) end as int)"


@query(X.sql(f"p as (select url, score, cast(score % 20 * 5 as int) s from scores), q as (select *, 3 * s + 7 * score x10 from p), r as (select *, {EVEN} f from q) select url, {FUSE('score')} as fused from r", "scores"))
def s9_fusion(spark, sf):
    s = (F.col("score") % 20 * 5).cast("int")
    return X.scores(spark, sf).select("url", S.fuse(s, F.col("score")).alias("fused"))


@query(X.sql("select url, case when pos_label in ('track_direct','playable_reference','ai_related','exclusive_scoop','overseas_insight') then pos_label else '' end as pos_label from scores", "scores"))
def s10_label_validation(spark, sf):
    allowed = tuple(x for x in P.POS_LABELS if x != "high_info_density")
    return X.scores(spark, sf).select("url", S.valid_label(F.col("pos_label"), allowed).alias("pos_label"))


KEYQ = "case when regexp_extract(t, '《([^》]+)》', 1) <> '' then trim(regexp_extract(t, '《([^》]+)》', 1)) else substr(trim(regexp_replace(t, '\\[B站[^\\]]+\\]', '', 'g')), 1, 20) end"


@over_lines(f"select id, {KEYQ} as topic from lines")
def s14_topic_key(told):
    return told.select("id", S.topic_key(F.col("t")).alias("topic"))


@query("select page_id, lower(regexp_replace(url, '[?#].*$', '')) as canonical, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www[.]', '') as domain from pages")
def s15_url_parts(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.url_canonical(F.col("url")).alias("canonical"), S.url_domain(F.col("url")).alias("domain"))


_U = "'https://x.org/' || case doc_id % 5 when 0 then 'news/202401/' || doc_id when 1 then '2024/0115/' || doc_id when 2 then '2024/02/' || (10000 + doc_id) || '.html' when 3 then '20240116x/' || doc_id else doc_id::varchar end"


@query(f"with u as (select doc_id, {_U} as url from documents) select doc_id, case when regexp_matches(url, '/(20[2-9][0-9])([0-9]{{2}})/') then regexp_replace(regexp_extract(url, '/(20[2-9][0-9][0-9]{{2}})/', 1), '(....)(..)', '\\1-\\2') when regexp_matches(url, '/(20[2-9][0-9])/([0-9]{{2}})([0-9]{{2}})/') then regexp_replace(regexp_extract(url, '/(20[2-9][0-9]/[0-9]{{4}})/', 1), '(....)/(..)(..)', '\\1-\\2-\\3') when regexp_matches(url, '/(20[2-9][0-9])/([0-9]{{2}})/[0-9]{{4,}}') then replace(regexp_extract(url, '/(20[2-9][0-9]/[0-9]{{2}})/[0-9]{{4,}}', 1), '/', '-') when regexp_matches(url, '/(20[2-9][0-9])([0-9]{{2}})([0-9]{{2}})[^0-9]') then regexp_replace(regexp_extract(url, '/(20[2-9][0-9][0-9]{{4}})[^0-9]', 1), '(....)(..)(..)', '\\1-\\2-\\3') else '' end as url_date from u")
def s16_url_date(spark, sf):
    url = F.expr("concat('https://x.org/', case doc_id % 5 when 0 then concat('news/202401/', doc_id) when 1 then concat('2024/0115/', doc_id) when 2 then concat('2024/02/', 10000 + doc_id, '.html') when 3 then concat('20240116x/', doc_id) else cast(doc_id as string) end)")
    return X.table(spark, sf, "documents").select("doc_id", S.url_date(url).alias("url_date"))


_D = "case when doc_id % 11 = 0 then '2024-01' when doc_id % 13 = 0 then 'bad' else strftime(date '2024-01-01' + cast(doc_id % 40 as int), '%Y-%m-%d') end"


@query(f"with u as (select doc_id, {_D} d from documents) select doc_id, coalesce(case when length(d) = 7 then d = '2024-01' or date '2024-01-30' - cast(d || '-01' as date) between 0 and 7 else date '2024-01-30' - try_cast(d as date) between 0 and 7 end, false) as fresh from u")
def s17_within_days(spark, sf):
    d = F.expr("case when doc_id % 11 = 0 then '2024-01' when doc_id % 13 = 0 then 'bad' else cast(date_add(date '2024-01-01', cast(doc_id % 40 as int)) as string) end")
    return X.table(spark, sf, "documents").select("doc_id", S.within_days(d, F.expr(AS_OF)).alias("fresh"))


_FULL = "([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})"
_SHORT = "([0-9]{1,2})[-/月]([0-9]{1,2})"
_G = lambda p, i: f"regexp_extract(t, '{p}', {i})"
_FULLQ = f"try_cast(lpad({_G(_FULL, 1)}, 4, '0') || '-' || lpad({_G(_FULL, 2)}, 2, '0') || '-' || lpad({_G(_FULL, 3)}, 2, '0') as date)"
_SHORTQ = lambda y: f"try_cast('{y}-' || lpad({_G(_SHORT, 1)}, 2, '0') || '-' || lpad({_G(_SHORT, 2)}, 2, '0') as date)"
_AGE_SHORT = f"{AS_OF} - case when {_SHORTQ(2024)} > {AS_OF} then {_SHORTQ(2023)} else {_SHORTQ(2024)} end"
_AGED = "select doc_id, case doc_id % 8 when 0 then (doc_id % 30)::varchar || '天前' when 1 then '4小时前' when 2 then '昨天' when 3 then '前天' when 4 then '2023-12-' || (doc_id % 28 + 1)::varchar when 5 then '6月29日' when 6 then '01-' || (doc_id % 28 + 1)::varchar else 'x' end as t from documents"


@query(f"with u as ({_AGED}) select doc_id, cast(case when regexp_matches(t, '^[0-9]+\\s*小时前') then 0 when regexp_matches(t, '^[0-9]+\\s*天前') then try_cast(regexp_extract(t, '^([0-9]+)\\s*天前', 1) as int) when contains(t, '昨天') then 1 when contains(t, '前天') then 2 when regexp_matches(t, '{_FULL}') then {AS_OF} - {_FULLQ} when regexp_matches(t, '{_SHORT}') and {_AGE_SHORT} > 90 then {_AGE_SHORT} end as int) as age from u")
def s18_age_days(spark, sf):
    t = F.expr(_AGED.split("select doc_id, ")[1].split(" as t from")[0].replace("(doc_id % 30)::varchar || '天前'", "concat(doc_id % 30, '天前')").replace("'2023-12-' || (doc_id % 28 + 1)::varchar", "concat('2023-12-', doc_id % 28 + 1)").replace("'01-' || (doc_id % 28 + 1)::varchar", "concat('01-', doc_id % 28 + 1)"))
    return X.table(spark, sf, "documents").select("doc_id", S.age_days(t, F.expr(AS_OF)).cast("int").alias("age"))


@over_lines(f"select id, case when regexp_matches(t, '{_FULL}') then {_FULLQ} when regexp_matches(t, '{_SHORT}') then {_SHORTQ(2024)} end as day from lines")
def s19_text_date(told):
    return told.select("id", S.text_date(F.col("t"), F.expr(AS_OF)).alias("day"))


_NK = "regexp_replace(t, '^(热|爆|沸|新)\\s*', '')"
_CUT = f"substr({_NK}, 1, 20)"
for _m in ("，", "。", " "):
    _CUT = f"regexp_replace({_CUT}, '{_m}[^{_m}]*$', '')"


@over_lines(f"select id, trim(case when length({_NK}) > 20 then {_CUT} else {_NK} end) as keyword from lines")
def s20_keyword_normalise(told):
    return told.select("id", S.normalize_keyword(F.col("t")).alias("keyword"))


REL = f"(not {_in(P.IRRELEVANT_WORDS)} and {_in(P.RELEVANT_WORDS, True)})"
_HOT = f"case when t = '' or not {REL} or {_in(P.RECRUITING_WORDS, True)} or {_in(P.LOW_VALUE_WORDS, True)} or pts = 0 then -999 else pts end"
_PTS = f"2 * len(list_filter({list(P.PLATFORM_WORDS)}, lambda w: contains(lower(t), w))) + 3 * len(list_filter({list(P.BUSINESS_WORDS)}, lambda w: contains(lower(t), w))) + case when {_in(P.HOT_TRACK_WORDS)} then 2 else 0 end"


@over_lines(f"select id, cast({_HOT} as int) as score from (select id, t, {_PTS} pts from (select id, trim(t) t from lines))")
def s21_hot_score(told):
    return told.select("id", S.hot_score(F.col("t"), F.lit(""), F.lit("https://a.org/b")).cast("int").alias("score"))


@query("select event_id, cast(greatest(10, 100 - event_id % 120) + 20 * (event_id % 7) as double) / 100 as weight from events", "weight")
def s22_keyword_weight(spark, sf):
    return X.table(spark, sf, "events").select("event_id", S.keyword_weight(F.col("event_id") % 120, F.col("event_id") % 7).cast("decimal(10,2)").alias("weight"))


#: Keywords out of tables: all words of names and of benchmark texts, and some that aren't letters alone.
TABLE_WORDS = """kw as (select distinct lower(trim(w)) w from (select unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) w from part union all select unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) from benchmark union all select '#' || p_size from part) where trim(w) <> '')"""


def table_words(spark, sf):
    part, bench = X.table(spark, sf, "part"), X.table(spark, sf, "benchmark")
    words = part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("word"))
    words = words.union(bench.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")))).union(part.select(F.concat(F.lit("#"), F.col("p_size").cast("string"))))
    return words


@query(f"with {TABLE_WORDS}, d as (select doc_id, lower(text) t from documents where text <> ''), hit as (select distinct doc_id, w as word from (select doc_id, unnest(regexp_split_to_array(t, '[^a-z0-9_]+')) w from d) join kw using (w) where regexp_full_match(w, '[a-z]+') union select doc_id, w from d join kw on contains(t, w) where not regexp_full_match(w, '[a-z]+')) select doc_id, count(*) as n, string_agg(word, ' ' order by word) as words from hit group by 1")
def b2_keyword_table(spark, sf):
    """The words of a table that each article holds."""
    hits = keywords.keyword_hits(X.table(spark, sf, "documents"), table_words(spark, sf), F.col("text"), "doc_id")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))


@query(X.sql("select game_name, coalesce(cast(try_cast(nullif(regexp_extract(downloads, '^([0-9.]+)\\s*万', 1), '') as decimal(18,4)) * 10000 as bigint), try_cast(regexp_extract(downloads, '^([0-9]+)', 1) as bigint), 0) as downloads, replace(tags, '|', '、') || '游戏' as summary from games", "games"))
def s23_downloads(spark, sf):
    return X.games(spark, sf).select("game_name", S.downloads_number(F.col("downloads")).alias("downloads"), S.tag_summary(F.col("tags")).alias("summary"))


_SRC = "case doc_id % 7 when 0 then '3dmgame' when 1 then 'PG.biz' when 2 then '游侠' when 3 then 'B站' when 4 then 'yxrb' when 5 then '17173' else source end"


@query(f"with u as (select doc_id, {_SRC} s from documents), v as (select doc_id, case s when '3dmgame' then '3DM' when 'PG.biz' then 'pocketgamer.biz' when '游侠' then null when 'B站' then 'Bilibili' when 'yxrb' then '游戏日报' else s end c from u) select doc_id, c as source, case c when '游戏日报' then 2 when '17173' then 3 when '3DM' then 4 when 'pocketgamer.biz' then 5 when 'Bilibili' then 6 else 99 end as place, case c when '17173' then 45 when '3DM' then 30 when '游戏日报' then 35 when 'pocketgamer.biz' then 35 when 'Bilibili' then 25 else 0 end as weight, case c when 'pocketgamer.biz' then 'PG.biz' when 'Bilibili' then 'B站' else c end as label from v")
def s24_sources(spark, sf):
    c = S.source_canonical(F.expr(_SRC))
    return X.table(spark, sf, "documents").select("doc_id", c.alias("source")).select("doc_id", "source", S.source_order(F.col("source")).alias("place"), S.source_weight(F.col("source")).alias("weight"), S.source_label(F.col("source")).alias("label"))


@over_lines("select id, case when regexp_matches(t, '首发|上线') then '首发' when regexp_matches(t, '预|测试') then '预约/测试' when regexp_matches(t, '更新|版本') then '版本更新' when regexp_matches(lower(t), 'demo|试玩') then 'Demo' else '新游' end as event_type from lines")
def s25_event_type(told):
    return told.select("id", S.event_type(F.col("t")).alias("event_type"))


@query("select page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200) as excerpt, date '2024-01-01' + cast(page_id % 28 as int) as day from pages")
def s26_excerpt(spark, sf):
    stamp = F.date_format(F.expr("date_add(date '2024-01-01', cast(page_id % 28 as int))"), "'Mon, 'dd MMM yyyy' 10:00:00 GMT'")
    return X.table(spark, sf, "pages").select("page_id", S.excerpt(F.col("html")).alias("excerpt"), S.rfc2822_date(stamp).alias("day"))


@query(_s("select id, case when trim(t) = '' or contains(t, '？') or contains(t, '?') or length(trim(t)) > 12 then trim(t) when length(trim(t)) <= 4 then '游戏行业 \"' || trim(t) || '\" 2024年最新动态与发展趋势' else '游戏行业 \"' || trim(t) || '\" — 最新动态与行业影响' end as question from lines"))
def s27_question(spark, sf):
    return lines(spark, sf).select("id", S.expand_question(F.col("t"), 2024).alias("question"))


@query("select lang, k as n, case k when 1 then lang || ' 今天' when 2 then lang || ' 最新' when 3 then lang || ' 游戏 今日' when 4 then lang || ' 游戏 行业 今天' else lang || ' 游戏 行业 2024-01-30' end as query from (select distinct lang from documents where lang is not null), unnest([1, 2, 3, 4, 5]) x(k)")
def s28_query_variants(spark, sf):
    langs = X.table(spark, sf, "documents").where("lang is not null").select("lang").distinct()
    return langs.select("lang", F.posexplode(S.query_variants(F.col("lang"), F.expr(AS_OF))).alias("n", "query")).withColumn("n", F.col("n") + 1)


@query(X.sql("select date, url, '> **' || headline || '** ' || source || ' [link](' || url || ')' as line, url as found from news", "news"))
def s30_links_back(spark, sf):
    line = F.concat(F.lit("> **"), "headline", F.lit("** "), "source", F.lit(" [link]("), "url", F.lit(")"))
    return X.news(spark, sf).select("date", "url", line.alias("line")).withColumn("found", F.get(S.headline_links(F.col("line")), 0))


@query("select page_id, regexp_matches(url, '^https?://') and not regexp_matches(lower(url), 'pixel|logo[.]png|/ad[.]') as valid, cast(page_id % 500 as int) as width from pages")
def s31_images(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.valid_image(F.col("url")).alias("valid"), S.dimension(F.concat((F.col("page_id") % 500).cast("string"), F.lit("px"))).alias("width"))


@over_lines("select id, regexp_replace(t, '^(游戏资讯|行业活动|行业分析)\\s*', '') as headline from lines")
def s32_clean_headline(told):
    return told.select("id", S.clean_headline(F.col("t")).alias("headline"))


_KW = "(regexp_matches(lower(t), '(^|[^a-z0-9_])(td|roguelike|roguelite)([^a-z0-9_]|$)') or " + " or ".join(f"contains(lower(t), '{w.lower()}')" for w in P.TRACK_WORDS if w.lower() not in ("td", "roguelike", "roguelite")) + ")"


@over_lines(f"select id, {_KW} as hit from lines")
def b2_keyword_match(told):
    return told.select("id", S.keyword_match(F.col("t"), P.TRACK_WORDS).alias("hit"))


@over_lines(f"select id, {_in(P.GAMING_SIGNALS, True)} or (contains(t, '《') and contains(t, '》') and not {_in(P.FOREIGN_CONTEXT)}) as passes from lines")
def b8_domain_headline(told):
    return told.select("id", S.is_domain_headline(F.col("t")).alias("passes"))


@over_lines(f"select id, {REL} as relevant from lines")
def b9_relevance(told):
    return told.select("id", S.is_relevant(F.col("t")).alias("relevant"))


@query(_s("select id, id % 5 = 0 or (trim(t) <> '' and length(trim(t)) <= 14 and len(regexp_extract_all(trim(t), '[0-9]')) < 4 and not regexp_matches(t, '[，。！？；：()（）\\[\\]【】/\\\\]') and len(regexp_extract_all(trim(t), ' ')) < 3) as compact from lines"))
def b10_compact_keyword(spark, sf):
    source = F.when(F.col("id") % 5 == 0, "curated").otherwise("hot")
    return lines(spark, sf).select("id", S.is_compact(F.col("t"), source).alias("compact"))


@query("with u as (select page_id, case page_id % 4 when 0 then 'https://www.so.com/s?q=a' when 1 then 'https://so.com' when 2 then '' else url end u from pages) select page_id, u = '' or regexp_matches(u, '^https://(www[.])?so[.]com($|/s)') as search_page from u")
def b11_search_page(spark, sf):
    u = F.expr("case page_id % 4 when 0 then 'https://www.so.com/s?q=a' when 1 then 'https://so.com' when 2 then '' else url end")
    return X.table(spark, sf, "pages").select("page_id", S.is_search_page(u).alias("search_page"))
