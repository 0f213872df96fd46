"""Hot topics, reports, audit, ingest and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import scalars as S
from ..operators import charts, hot, news, report, scoring, search, tables, tracks
from ..sources import ingest, pages
from . import query
from .chart_queries import CHANGES, WORDS
from .news_queries import COMMON, SC, _b, as_of, news_, scored
from .scalar_queries import AS_OF, TOKENS, _stripped

FIRST = "lower(regexp_extract(headline, '^[^ ]+'))"
HW = "hw as (select date, source, keyword, cast(row_number() over (partition by date, source order by url) as int) rank, url from (select date, source, url, " + FIRST + " keyword from news))"
MERGED = f"{HW}, mk as (select * from (select *, row_number() over (partition by date, keyword order by rank, source) k from hw where source = 'src1' or (trim(keyword) <> '' and length(keyword) <= 14 and len(regexp_extract_all(keyword, '[0-9]')) < 4 and not regexp_matches(keyword, '[，。！？；：()（）\\[\\]【】/\\\\]'))) where k = 1)"
CL = "cl as (select keyword, count(*) clicks from (select lower(regexp_extract(n.headline, '^[^ ]+')) keyword from feedback f join news n on n.url = f.news_url where feedback_type = 'hot_click') group by 1)"
WT = f"{MERGED}, {CL}, wt as (select mk.*, clicks, cast((greatest(10, 100 - rank) + 20 * coalesce(clicks, 0)) / 100.0 as decimal(10,2)) weight from mk left join cl using (keyword))"


def keywords_raw(spark, sf):
    n = news_(spark, sf).select("date", "source", "url", F.lower(F.regexp_extract("headline", "^[^ ]+", 0)).alias("keyword"))
    from pyspark.sql import Window

    return n.withColumn("rank", F.row_number().over(Window.partitionBy("date", "source").orderBy("url")).cast("int"))


def merged(spark, sf):
    rows = keywords_raw(spark, sf).withColumn("source", F.when(F.col("source") == "src1", "curated").otherwise(F.col("source")))
    return hot.merge_keywords(rows)


def clicks(spark, sf):
    f = X.feedback(spark, sf).where("feedback_type = 'hot_click'").select(F.col("news_url").alias("url"))
    return f.join(news_(spark, sf).select("url", F.lower(F.regexp_extract("headline", "^[^ ]+", 0)).alias("keyword")), "url").groupBy("keyword").agg(F.count(F.lit(1)).alias("clicks"))


HL = "hr as (select date, source, headline, url, row_number() over (partition by date, source order by url) place from news), hf as (select * from hr where place <= 30 and length(trim(headline)) >= 2 and (contains(lower(headline), 'tion') or contains(lower(headline), 'que')))"


def hot_raw(spark, sf):
    return keywords_raw(spark, sf).withColumnRenamed("rank", "place").drop("keyword").join(news_(spark, sf).select("url", F.col("headline").alias("title")), "url")


@query(X.sql(f"{HL} select date, source, url, cast(place as int) as rank from hf", "news"))
def a24_hot_list(spark, sf):
    return hot.hot_list_rows(hot_raw(spark, sf), relevant=("tion", "que")).select("date", "source", "url", "rank")


_TALK = "case place % 4 when 0 then 'https://www.zhihu.com/question/' when 1 then 'https://zhuanlan.zhihu.com/p/' when 2 then 'https://www.zhihu.com/zvideo/' else 'https://www.zhihu.com/x/' end"
_TITLE = "case place % 5 when 0 then concat('为什么', word) when 1 then concat(word, '？ - 知乎') when 2 then concat('文章 ', word, ' | 知乎日报') else concat(word, ' 回答') end"


@query(X.sql(f"{HL.replace('*', 'date, place, ' + FIRST + ' word')}, t as (select date, place, {_TALK} || place u, word, {_TITLE} title, case place % 5 when 0 then '为什么' || word when 1 then word || '？' else word end k from hf where place <= 30), kept as (select *, place % 4 = 0 or place % 5 in (0, 1) asked from t), c as (select *, row_number() over (partition by date, k order by place, u) n from kept where (asked or place % 4 not in (1, 2)) and length(k) <= 14 and len(regexp_extract_all(k, '[0-9]')) < 4 and trim(k) <> '' and not regexp_matches(k, '[，。！？；：()（）\\[\\]【】/\\\\]')) select date, k as keyword, u as url, cast(row_number() over (partition by date order by place, u) as int) as rank from c where n = 1", "news").replace("partition by date, source order by url) place from news", "partition by date order by url) place from news"))
def a24_discussions(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("date").orderBy("url"))
    rows = news_(spark, sf).withColumn("place", place).withColumn("word", F.lower(F.regexp_extract("headline", "^[^ ]+", 0))).where("contains(lower(headline), 'tion') or contains(lower(headline), 'que')")
    raw = rows.select("date", F.lit("zhihu").alias("source"), F.concat(F.expr(_TALK), F.col("place").cast("string")).alias("url"), F.expr(_TITLE).alias("title"), "place")
    return hot.hot_list_rows(raw, relevant=("",)).select("date", "keyword", "url", "rank")


@query(X.sql(f"{MERGED.replace('order by rank, source', 'order by rank, case when source=' + chr(39) + 'src1' + chr(39) + ' then ' + chr(39) + 'curated' + chr(39) + ' else source end')} select date, keyword, rank, case when source = 'src1' then 'curated' else source end as source from mk", "news"))
def f3_merge_keywords(spark, sf):
    return merged(spark, sf).select("date", "keyword", "rank", "source")


WTC = WT.replace("order by rank, source", "order by rank, case when source='src1' then 'curated' else source end")


@query(X.sql(f"{WTC}, p as (select *, source = 'src1' cur, row_number() over (partition by date, source = 'src1' order by weight desc, keyword) pl from wt), q as (select *, row_number() over (partition by date order by case when cur then 1 when pl <= 7 then 0 else 2 end, weight desc, keyword) slot from p) select date, keyword, weight, cast(slot as int) as slot from q where slot <= 10", "news", "feedback"), "weight")
def e12_pick_keywords(spark, sf):
    return hot.pick_keywords(hot.weigh_keywords(merged(spark, sf), clicks(spark, sf))).select("date", "keyword", "weight", "slot")


ENG = "en as (select lang keyword, source query, case doc_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end engine, doc_id from documents where not (doc_id % 3 = 0 and lang = 'en'))"


@query(f"with {ENG}, pl as (select *, case engine when 'alpha' then 1 when 'gamma' then 2 when 'beta' then 3 end p from en) select keyword, query, engine, doc_id from (select *, min(p) over (partition by keyword, query) m from pl) where p = m")
def a25_first_engine(spark, sf):
    d = X.table(spark, sf, "documents").where("not (doc_id % 3 = 0 and lang = 'en')")
    rows = d.selectExpr("lang as keyword", "source as query", "case doc_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as engine", "doc_id")
    return hot.first_engine(rows, ("alpha", "gamma", "beta"))


@query("with r as (select doc_id, date '2024-01-01' + cast(doc_id % 30 as int) as date, lang keyword, cast(doc_id % 7 as int) variant from documents where lang is not null and doc_id % 7 >= doc_id % 4) select doc_id from (select *, min(variant) over (partition by date, keyword) m from r) where variant = m")
def a25_first_variant(spark, sf):
    d = X.table(spark, sf, "documents").where("lang is not null and doc_id % 7 >= doc_id % 4")
    return hot.first_variant(d.selectExpr("doc_id", "date_add(date '2024-01-01', cast(doc_id % 30 as int)) as date", "lang as keyword", "cast(doc_id % 7 as int) as variant")).select("doc_id")


RES = "rs as (select n.date, n.url, n.headline title, substr(n.body,1,200) snippet, (d.doc_id % 12)::varchar||'天前' time_str from news n join documents d on n.url = 'https://'||d.source||'.example.org/'||d.doc_id::varchar), ra as (select * from rs where cast(regexp_extract(time_str, '^[0-9]+') as int) <= 7)"


def results(spark, sf):
    return news_(spark, sf).select("date", "url", F.col("headline").alias("title"), F.expr("substr(body, 1, 200)").alias("snippet"), F.expr("concat(cast(regexp_extract(url, '([0-9]+)$', 1) as long) % 12, '天前')").alias("time_str"))


@query(X.sql(f"{RES} select url from ra", "news"))
def b12_age_filter(spark, sf):
    return hot.filter_by_age(results(spark, sf), as_of()).select("url")


HS = "cast(2 * len(list_filter(['tion', 'heing'], lambda w: contains(lower(title || ' ' || snippet), w))) + 3 * len(list_filter(['que', 'und', 'los'], lambda w: contains(lower(title || ' ' || snippet), w))) as int)"
HSF = f"hs as (select *, case when not (contains(lower(title || ' ' || snippet), 'e')) or regexp_matches(lower(title || ' ' || snippet), 'offer|hiring|job|recruit|campus|intern|geo|seo|etf') or {HS} = 0 then -999 else {HS} end score from ra)"


def hot_scored(spark, sf):
    rows = hot.filter_by_age(results(spark, sf), as_of())
    return rows, S.hot_score(F.col("title"), F.col("snippet"), F.col("url"), ("e",), ("tion", "heing"), ("que", "und", "los"), ())


@query(X.sql(f"{RES}, {HSF} select date, url, score, cast(k as int) as slot from (select *, row_number() over (partition by date order by score desc, url) k from hs where score >= 4) where k <= 7", "news"))
def e14_rule_hot_topics(spark, sf):
    rows, score = hot_scored(spark, sf)
    return hot.rule_hot_topics(rows, score.cast("int")).select("date", "url", "score", "slot")


@query(X.sql(f"{SC}, r as (select sc.*, {_b('headline', ('que',))} rel from sc join news using (url) where score > 0), a as (select *, bool_or(rel) over (partition by date) has from r), b as (select *, row_number() over (partition by date order by score desc, url) k from a where rel or not has) select date, url, score, cast(k as int) as slot from b where k <= case when has then 20 else 7 end", "news", "scores").replace("using (url) where", "using (date, url) where"))
def e15_local_candidates(spark, sf):
    return hot.local_candidates(news_(spark, sf).join(X.scores(spark, sf), "url"), F.col("score"), S.keyword_match(F.col("headline"), ("que",))).select("date", "url", "score", "slot")


#: What searches give: for each article two variants of its keyword's query, results of every third article for the first one, all for the second.
SEARCHES = """sr as (select date, url, headline title, category keyword, v, body, cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) n from news, range(2) t(v) where category is not null),
an as (select *, cast(n % 12 as int) age from sr where v = 1 or n % 3 = 0)"""
#: Two runs: a week's results first, an hour later those of three days; a variant counts if any result is left.
FOUND = lambda most, name: f"{name} as (select * from (select *, min(v) over (partition by date, keyword) first from an where age <= {most}) where v = first)"


def _searches(spark, sf):
    n = news_(spark, sf).where("category is not null").select("date", F.col("category").alias("keyword"), "url", F.col("headline").alias("title"), F.expr("cast(regexp_extract(url, '([0-9]+)$', 1) as long)").alias("n"))
    requests = n.select("keyword", "date").distinct().withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("query", F.concat_ws(" ", "keyword", F.col("variant").cast("string")))
    answers = n.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1)))).where("variant = 1 or n % 3 = 0")
    key = tables.query_hash(F.concat_ws(" ", "keyword", F.col("variant").cast("string")), F.col("date"))
    answers = answers.select(key.alias("query_hash"), F.lit("alpha").alias("engine"), "title", "url", F.lit("").alias("snippet"), F.concat(F.col("n") % 12, F.lit("天前")).alias("time_str"))
    return requests, lambda missed: answers.join(missed.select("query_hash"), "query_hash", "left_semi")


@query(X.sql(f"{SEARCHES}, {FOUND(7, 'one')}, {FOUND(3, 'two')} select 1 as run, date, keyword, cast(v as int) as variant, url, false as cached from one union all select 2, t.date, t.keyword, cast(t.v as int), t.url, exists (select 1 from one o where o.date = t.date and o.keyword = t.keyword and o.v = t.v) from two t", "news"))
def a22_cached_search(spark, sf):
    """Results of two runs over one cache and whether they came from it; what the cache has of a query but the second run finds too old is asked anew."""
    path, (requests, answer) = tables.work_dir(spark, "search-cache"), _searches(spark, sf)
    at, runs = F.expr("timestamp '2024-01-30 12:00:00'"), []
    for run, (now, most) in enumerate(((at, 7), (at + F.expr("interval 1 hour"), 3)), 1):
        keep = lambda rows, most=most: hot.filter_by_age(rows, F.col("date"), most)
        results, rows, _ = search.cached_search(requests, search.read_cache(spark, path), answer, keep, now)
        search.take_up(rows, path)
        runs.append(results.select(F.lit(run).alias("run"), "date", "keyword", "variant", "url", "cached"))
    return runs[0].unionByName(runs[1])


C7 = f"""{RES}, {HSF}, se as (select date, url, title, k slot from (select *, row_number() over (partition by date order by score desc, url) k from hs where score >= 4) where k <= 7), po as (select date, url, title, row_number() over (partition by date order by score desc, url) place from hs where score > 0),
nw as (select date, url, headline from news where source = 'src4'), nt as (select distinct date, unnest({TOKENS}) token from (select date, {_stripped('headline')} c from nw)),
hit as (select distinct date, url from (select date, url, unnest({TOKENS}) token from (select date, url, {_stripped('title')} c from hs)) join nt using (date, token)),
al as (select date, url, title, 0 late, slot place from se union all select date, url, title, 1, place from po where (date, url) not in (select date, url from se)),
fr as (select * from al where (date, url) not in (select date, url from hit) and (date, url) not in (select date, url from nw)), nn as (select date, count(*) n from se group by 1)"""


@query(X.sql(f"{C7} select date, url, title, cast(k as int) as slot from (select *, row_number() over (partition by date order by late, place, url) k from fr) join nn using (date) where k <= n", "news"))
def c7_dedup_against(spark, sf):
    rows, score = hot_scored(spark, sf)
    # texts are read and scored once, for the choice and for the pool
    rows = tables.stored(tables.once(rows, "score", score.cast("int")).where("score > 0").select("date", "url", "title", "score"), "hot-scored")
    chosen, pool = hot.rule_hot_topics(rows, F.col("score")), tables.numbered(rows, ["date"], [F.desc("score"), "url"])
    return hot.dedup_against(chosen, pool, news_(spark, sf).where("source = 'src4'").select("date", "url", "headline"))


#: Search results of each keyword: articles of its day in three variants of the query and two engines; the last days have none.
G5RES = "case doc % 3 when 0 then 'alpha' else 'beta' end"
G5 = f"""{WTC}, wr as (select * from wt where source = 'src1' or contains(lower(keyword), 'e')), p0 as (select *, source = 'src1' cur, row_number() over (partition by date, source = 'src1' order by weight desc, keyword) pl from wr), p1 as (select *, row_number() over (partition by date order by case when cur then 1 when pl <= 7 then 0 else 2 end, weight desc, keyword) slot from p0), pk as (select date, keyword from p1 where slot <= 10),
g0 as (select date, url, headline title, substr(body, 1, 200) snippet, cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) doc, {FIRST} keyword from news where date <= date '2024-01-26'),
g1 as (select *, cast(doc % 3 + 1 as int) variant, {G5RES} engine, doc % 12 age from g0 join pk using (date, keyword)), g2 as (select *, min(engine) over (partition by date, keyword, variant) me from g1),
ra as (select * from g2 where engine = me and age <= 7), {{HSF}}, g3 as (select * from hs where score >= 0), g4v as (select *, min(variant) over (partition by date, keyword) mv from g3),
po0 as (select date, url, title, keyword, score from (select *, row_number() over (partition by date, url order by score desc, keyword, title) k from g4v where variant = mv) where k = 1),
lo0 as (select n.date, n.url, n.headline title, '' keyword, s.score, {{REL}} rel from news n join scores s using (url) where n.date not in (select date from po0) and s.score > 0), lo1 as (select *, bool_or(rel) over (partition by date) has from lo0), lo2 as (select *, row_number() over (partition by date order by score desc, url) k from lo1 where rel or not has),
po as (select * from po0 union all select date, url, title, keyword, score from lo2 where k <= case when has then 20 else 7 end),
se as (select date, url, title, k slot from (select *, row_number() over (partition by date order by score desc, url) k from po where score >= 4) where k <= 7), pp as (select date, url, title, row_number() over (partition by date order by score desc, url) place from po),
nw as (select date, url, headline from news where source = 'src4'), nt as (select distinct date, unnest({TOKENS}) token from (select date, {_stripped('headline')} c from nw)),
hit as (select distinct date, url from (select date, url, unnest({TOKENS}) token from (select date, url, {_stripped('title')} c from po)) join nt using (date, token)),
al as (select date, url, title, 0 late, slot place from se union all select date, url, title, 1, place from pp where (date, url) not in (select date, url from se)),
fr as (select * from al where (date, url) not in (select date, url from hit) and (date, url) not in (select date, url from nw)), nn as (select date, count(*) n from se group by 1)"""


@query(X.sql(G5.replace("{HSF}", HSF).replace("{REL}", _b("headline", ("que",))) + " select f.date, f.url, f.title, po.keyword, cast(f.k as int) as slot from (select *, row_number() over (partition by date order by late, place, url) k from fr) f join nn using (date) join po on po.date = f.date and po.url = f.url where f.k <= n", "news", "feedback", "scores"))
def g5_hot_topics(spark, sf):
    keywords = keywords_raw(spark, sf).withColumn("source", F.when(F.col("source") == "src1", "curated").otherwise(F.col("source")))
    doc = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    found = news_(spark, sf).where("date <= date '2024-01-26'").select("date", "url", F.col("headline").alias("title"), F.expr("substr(body, 1, 200)").alias("snippet"), F.lower(F.regexp_extract("headline", "^[^ ]+", 0)).alias("keyword"), doc.alias("doc"))
    found = found.withColumns({"variant": (F.col("doc") % 3 + 1).cast("int"), "engine": F.expr(G5RES), "time_str": F.concat((F.col("doc") % 12).cast("string"), F.lit("天前"))})
    score = S.hot_score(F.col("title"), F.col("snippet"), F.col("url"), ("e",), ("tion", "heing"), ("que", "und", "los"), ())
    told = news_(spark, sf).join(X.scores(spark, sf).select("url", "score"), "url", "left")
    blocked = told.where("source = 'src4'")
    out = hot.hot_topics(keywords, clicks(spark, sf), found, told.withColumn("headline", F.col("headline")), as_of(), score, ("alpha", "beta"), relevant=("e",), local_score=F.coalesce("score", F.lit(0)), local_relevant=S.keyword_match(F.col("headline"), ("que",)), known=blocked)
    return out.select("date", "url", "title", "keyword", "slot")


@query(X.sql("c as (select date, url, headline as title, cast(row_number() over (partition by date order by url) - 1 as int) number from news), p as (select date, cast(doc_id % 50 as int) number, max(cast(doc_id % 120 as int)) as value from (select doc_id, date '2024-01-01' + cast(doc_id % 30 as int) date from documents) group by 1, 2) select date, url, value, cast(k as int) as slot from (select *, row_number() over (partition by date order by value desc, number) k from c join p using (date, number) where value between 0 and 100) where k <= 7", "news"))
def c17_apply_selection(spark, sf):
    from pyspark.sql import Window

    c = news_(spark, sf).select("date", "url", F.col("headline").alias("title"), (F.row_number().over(Window.partitionBy("date").orderBy("url")) - 1).cast("int").alias("number"))
    d = X.table(spark, sf, "documents").selectExpr("date_add(date '2024-01-01', cast(doc_id % 30 as int)) as date", "cast(doc_id % 50 as int) as number", "cast(doc_id % 120 as int) as v")
    return hot.apply_selection(c, d.groupBy("date", "number").agg(F.max("v").alias("value")), as_of()).select("date", "url", "value", "slot")


# --- reports


@query(X.sql("p as (select distinct date, game_name from games where is_port), g as (select distinct date, game_name from games where genre <> 'PROMO') select date, game_name, case when p.date is not null and g.date is not null then 'both' when p.date is not null then 'port' else 'calendar' end as badge from p full join g using (date, game_name)", "games").replace("p.date is not null and g.date is not null", "pp and gg").replace("when p.date is not null", "when pp").replace("select distinct date, game_name from games where is_port", "select distinct date, game_name, true pp from games where is_port").replace("select distinct date, game_name from games where genre", "select distinct date, game_name, true gg from games where genre"))
def c8_merge_games(spark, sf):
    g = X.games(spark, sf)
    return report.merge_new_games(g.where("is_port"), g.where("genre <> 'PROMO'"))


GA = "ga as (select date, split_part(game_name, ' ', 1) || ' ' || split_part(game_name, ' ', 2) game_name, is_port from games)"


@query(X.sql(f"{GA}, ea as (select game_name, date as other, false told from ga union all select split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2), date '2024-01-10', true from part where p_size = 7) select distinct date, game_name from ga a where not exists (select 1 from ga x join ea e using (game_name) where x.date = a.date and x.game_name = a.game_name and e.other < x.date and (told or x.is_port or x.date - e.other <= 7))", "games"))
def c9_fresh_games(spark, sf):
    g = X.games(spark, sf).withColumn("game_name", F.substring_index("game_name", " ", 2))
    told = X.table(spark, sf, "part").where("p_size = 7").select(F.substring_index("p_name", " ", 2).alias("game_name"), F.expr("date '2024-01-10'").alias("date"))
    return report.fresh_games(g, told).select("date", "game_name").distinct()


FORCE = "sh as (select distinct date + 1 date, game_name from (select *, row_number() over (partition by date order by attention_score desc, platform, chart_type, bundle_id) k from changes) where k <= 3), fo as (select c.*, sh.date is not null forced from changes c left join sh on sh.date = c.date and sh.game_name = c.game_name), fp as (select *, row_number() over (partition by date order by forced desc, attention_score desc, platform, chart_type, bundle_id) place from fo)"


def forced(spark, sf, changes=None):
    c = charts.diff(X.rankings(spark, sf), WORDS) if changes is None else changes
    shown = scoring.top_n(c, ["date"], [F.desc("attention_score"), "platform", "chart_type", "bundle_id"], 3)
    return report.force_include(c, shown)


@query(X.sql(CHANGES + f", {FORCE} select date, platform, chart_type, bundle_id, forced, cast(place as int) as place from fp where place <= 12", "rankings"))
def c10_force_include(spark, sf):
    return forced(spark, sf).select("date", *charts.KEY, "forced", "place")


GT = "concat_ws(' ', game_name, tags, genre)"
DL = "coalesce(cast(try_cast(nullif(regexp_extract(downloads, '^([0-9.]+)\\s*万', 1), '') as decimal(18,4)) * 10000 as bigint), try_cast(regexp_extract(downloads, '^([0-9]+)', 1) as bigint), 0)"
CHOOSE = f"gc as (select date, game_name, {DL} downloads, {_b(GT, ('gear',))} and date < date '2024-01-15' tr from games), gd as (select *, bool_or(tr) over (partition by date) has, row_number() over (partition by date, tr order by downloads desc, game_name) k from gc), ge as (select date, game_name, downloads, cast(k as int) place, case when has then '' else 'no followed topic' end note from gd where (has and tr) or (not has and not tr and k <= 5))"


def chosen_games(spark, sf):
    g = tracks.classify_track(X.games(spark, sf), ("game_name", "tags", "genre"), None, ("gear",), ("PROMO",)).withColumn("downloads", S.downloads_number(F.col("downloads")))
    return report.choose_new_games(g.withColumn("track_class", F.when(F.col("date") < F.expr("date '2024-01-15'"), F.col("track_class")).otherwise("neutral")))


@query(X.sql(f"{CHOOSE} select * from ge", "games"))
def e13_choose_games(spark, sf):
    return chosen_games(spark, sf)


@query(X.sql("im as (select date, url image, case when source = 'src1' then 0 when source = 'src2' then 1 else 2 end tier from news) select date, image, tier, cast(k as int) as slot from (select *, row_number() over (partition by date order by tier, image) k from im) where k <= 3", "news"))
def e16_card_images(spark, sf):
    rows = news_(spark, sf).selectExpr("date", "url as image", "case when source = 'src1' then 0 when source = 'src2' then 1 else 2 end as tier")
    return report.card_images(rows)


LEAD = f"{SC}, ld as (select date, url, headline, source, cast(k as int) place from (select n.*, row_number() over (partition by n.date order by score desc, n.url) k from sc join news n using (url)) where k <= 7)"


def lead(spark, sf):
    return scoring.top_n(scored(spark, sf), ["date"], [F.desc("score"), "url"], 7)


RANKLINE = "'#' || coalesce(today_rank, yesterday_rank) || ' ' || game_name || ' ' || case when change_type = 'new_entry' then 'NEW' when change_type = 'dropped_out' then 'OUT' when rank_change > 0 then '▲' || rank_change when rank_change < 0 then '▼' || (-rank_change) else '=' end"
REPORT = f"""mk1 as (select date, string_agg('> **' || headline || '** — ' || source || ' [link](' || url || ')', chr(10) order by place) market from ld group by 1), rk1 as (select date, string_agg({RANKLINE}, chr(10) order by place) ranking from fp where place <= 12 group by 1),
ng1 as (select date, string_agg(game_name || ' · ' || downloads, chr(10) order by place, game_name || ' · ' || downloads) new_games from ge group by 1),
rep as (select date, coalesce(market,'') market, coalesce(ranking,'') ranking, coalesce(new_games,'') new_games from mk1 full join rk1 using (date) full join ng1 using (date))"""
REP = CHANGES + f", {FORCE}, {LEAD}, {CHOOSE}, {REPORT}"


def report_(spark, sf, changes=None):
    return report.daily_report(lead(spark, sf), forced(spark, sf, changes), chosen_games(spark, sf))


@query(X.sql(f"{REP} select * from rep", "rankings", "news", "scores", "games"))
def g7_daily_report(spark, sf):
    return report_(spark, sf)


@query(X.sql(f"{LEAD} select date, url, '> **' || headline || '** — ' || source || ' [link](' || url || ')' as line from ld", "news", "scores"))
def s29_news_lines(spark, sf):
    return lead(spark, sf).select("date", "url", report.news_line().alias("line"))


@query(X.sql(f"{REP} select * from rep where date = date '2024-01-09'", "rankings", "news", "scores", "games"))
def e21_reports(spark, sf):
    return report.reports(report_(spark, sf), F.expr("date '2024-01-09'"))


@query(X.sql(f"{LEAD} select ld.date, '> **' || headline || '** — ' || source || ' [link](' || url || ')' as line, url, score from ld left join scores using (url)", "news", "scores"))
def c16_attach_by_url(spark, sf):
    lines = lead(spark, sf).select("date", report.news_line().alias("line"))
    return report.attach_by_url(lines, X.scores(spark, sf), "score")


QC = f"""ln as (select date, l, regexp_extract(l, '\\]\\((https?://[^)]+)\\)', 1) u from (select date, unnest(string_split(market, chr(10))) l from rep) where l <> ''),
qc as (select date, 'no_market' as "check", 20 points from rep where market='' union all select date, 'no_ranking', 20 from rep where ranking='' union all select date, 'no_new_games', 20 from rep where new_games=''
 union all select date, 'block_word', 10 from ln where contains(lower(l), 'ouwhea') or contains(lower(l), 'erble') union all select date, 'deprecated_word', 5 from ln where contains(l, 'Thonst') union all select date, 'too_many', 10 from ln group by date having count(*) > 6
 union all select date, 'unknown_url', 15 from ln where u <> '' and u not in (select url from news where source <> 'src3') union all select date, 'no_link', 5 from ln where u = '' union all select date, 'over_long', 5 from ln where length(l) > 150
 union all select date, 'no_links', 5 from ln group by date having count(nullif(u, '')) = 0 union all select date, 'unknown_game', 3 from gs where port is null
 union all select distinct date, 'port_order', 1 from gs join gn using (date) where place < ports and not coalesce(port, false))"""
GK = """gk as (select date, game_name, bool_or(is_port) port from games where game_name not like '%7' group by all), gn as (select date, count(distinct game_name) ports from games where is_port and game_name not like '%7' group by 1),
g00 as (select date, string_split(new_games, chr(10)) ls from rep), g01 as (select date, unnest(ls) l, generate_subscripts(ls, 1) - 1 place from g00), gs as (select g01.date, place, port from (select *, trim(split_part(l, ' · ', 1)) game_name from g01 where l <> '') g01 left join gk on gk.date = g01.date and gk.game_name = g01.game_name)"""
QC = f"{GK}, {QC}"


def checks(spark, sf):
    known = news_(spark, sf).where("source <> 'src3'")
    games = X.games(spark, sf).where("game_name not like '%7'")
    return report.quality_checks(report_(spark, sf), known, ("ouwhea", "erble"), ("Thonst",), 6, 150, games)


@query(X.sql(f"{REP}, {QC} select * from qc", "rankings", "news", "scores", "games"))
def g9_quality_checks(spark, sf):
    return checks(spark, sf)


@query(X.sql(f"{REP}, {QC}, qs as (select date, sum(points) p, count(*) n from qc group by 1) select date, cast(greatest(0, 100 - coalesce(p, 0)) as int) as score, coalesce(n, 0) as n_failed, n is null as passed from rep left join qs using (date)", "rankings", "news", "scores", "games"))
def g9_quality_score(spark, sf):
    return report.quality_score(report_(spark, sf), checks(spark, sf))


@query(X.sql(f"pr as (select date, source, count(*) n from news group by all), tp as (select date, source top_source, n top_rows from (select *, row_number() over (partition by date order by n desc, source) k from pr) where k = 1) select date, count(*) as n_rows, count(distinct source) as n_sources, count(*) filter ({_b('headline', COMMON)}) as n_track, count(*) filter (category = 'en') as n_en, count(*) filter (contains(lower(headline), 'erble')) as n_blocked, any_value(top_source) as top_source, any_value(top_rows) as top_rows, cast(floor(count(*) filter ({_b('headline', COMMON)}) * 100 / count(*)) as int) as track_percent from news join tp using (date) group by date", "news"))
def d16_audit_metrics(spark, sf):
    return report.audit_metrics(news_(spark, sf), ("erble",), S.keyword_match(F.col("headline"), COMMON))


AUDIT = """tb as (select 'news' nm, date, count(*) n from news group by 2 union all select 'rankings', date, count(*) from rankings group by 2 union all select 'games', date, count(*) from games group by 2),
al0 as (select date, unnest(string_split(market, chr(10))) l from rep), al1 as (select date, l, regexp_extract(l, '— (\\S+) \\[', 1) src from al0 where l <> ''), sr as (select date, src, count(*) n from al1 where src <> '' group by all),
au as (select date, 'rows' as counter, nm as name, n from tb union all select date, 'source', src, n from sr union all select date, 'top_source', src, n from (select *, row_number() over (partition by date order by n desc, src) k from sr) where k = 1
 union all select date, 'published', '', count(*) from al1 where regexp_matches(l, '\\]\\((https?://[^)]+)\\)') group by 1 union all select date, 'section', 'new_games', cast(new_games <> '' as int) from rep union all select date, 'section', 'market', cast(market <> '' as int) from rep union all select date, 'section', 'ranking', cast(ranking <> '' as int) from rep
 union all select date, 'changes', '', count(*) from changes group by 1 union all select date, 'track_news', '', count(*) filter ({0}) from news group by 1 union all select date, 'language', 'home', count(*) filter (source <> 'src3') from news group by 1 union all select date, 'language', 'abroad', count(*) filter (source = 'src3') from news group by 1
 union all select date, 'blocked', 'erble', 1 from rep where contains(lower(market), 'erble') union all select date, 'blocked', 'ouwhea', 1 from rep where contains(lower(market), 'ouwhea'))"""


@query(X.sql(f"{REP}, {AUDIT.replace('{0}', _b('headline', COMMON))} select date, counter, name, cast(n as bigint) as n from au", "rankings", "news", "scores", "games"))
def d16_audit_report(spark, sf):
    n = news_(spark, sf).withColumn("track_relevant", S.keyword_match(F.col("headline"), COMMON))
    n = tables.stored(n.select("date", "source", "track_relevant"), "audit-news")  # texts are read once for all counters, and charts made once
    ranks = X.rankings(spark, sf)
    changes = tables.stored(charts.diff(ranks, WORDS), "audit-changes")
    tables_ = {"news": n, "rankings": ranks, "games": X.games(spark, sf)}
    return report.audit_report(tables_, report_(spark, sf, changes), n, changes, ("erble", "ouwhea"), ("src3",))


@query(X.sql("select run_id, tool_name, count(*) as calls, cast(sum(latency_ms) as bigint) as total_ms, cast(floor(avg(latency_ms)) as bigint) as avg_ms, count(*) filter (cache_hit) as cache_hits from audit_log group by grouping sets ((run_id, tool_name), (run_id))", "audit_log"))
def d17_tool_timing(spark, sf):
    return report.tool_timing(X.audit_log(spark, sf))


@query(X.sql("select run_id, count(*) filter (not cache_hit) as ok, count(*) filter (cache_hit) as failed, cast(sum(latency_ms) as bigint) as total_ms, bool_or(cache_hit and tool_name = 'user') as fatal from audit_log group by 1", "audit_log"))
def d18_run_summary(spark, sf):
    steps = X.audit_log(spark, sf).select("run_id", F.col("tool_name").alias("step"), F.when(F.col("cache_hit"), "failed").otherwise("ok").alias("status"), F.col("latency_ms").alias("ms"))
    return report.run_summary(steps, ("user",))


@query(X.sql("v as (select source creator, case when cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) % 5 = 0 then 'b' || date else url end bvid, date as day from news where date <= date '2024-01-29' or source in ('src1', 'src2')), k as (select *, date '2024-01-30' - day between 0 and 1 inr from v), h as (select *, bool_or(inr) over (partition by creator) has from k), l as (select *, row_number() over (partition by creator order by day desc, bvid) r from h where not has), u as (select creator, bvid, day, true i from h where inr union all select creator, bvid, day, false from l where r <= 2), o as (select * from (select *, row_number() over (partition by bvid order by i desc, day desc, creator) z from u) where z = 1 and bvid not in (select url from news where source = 'src2')) select creator, bvid, cast(row_number() over (order by day desc, bvid) as int) as rank from o", "news"))
def b13_recent_or_latest(spark, sf):
    n = news_(spark, sf)
    doc = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    videos = n.where("date <= date '2024-01-29' or source in ('src1', 'src2')").select(F.col("source").alias("creator"), F.when(doc % 5 == 0, F.concat(F.lit("b"), F.col("date").cast("string"))).otherwise(F.col("url")).alias("bvid"), F.col("date").cast("timestamp").alias("created_at"))
    told = n.where("source = 'src2'").select(F.col("url").alias("bvid"))
    return news.recent_or_latest(videos, told, as_of()).select("creator", "bvid", "rank")


# --- ingest and pages

_FN = "case event_id % 6 when 0 then 'ios_热门榜_20240117.csv' when 1 then '2024-01-16_rankings.csv' when 2 then 'android_免费_20240118.csv' when 3 then '资讯_20240118.csv' when 4 then 'x_畅销榜_20240119.csv' else 'none.csv' end"


@query(f"select event_id, case event_id % 6 when 0 then date '2024-01-17' when 1 then date '2024-01-16' when 2 then date '2024-01-18' when 3 then date '2024-01-18' when 4 then date '2024-01-19' end as day, case event_id % 6 when 2 then '免费榜' when 3 then null when 4 then '畅销榜' else '热门榜' end as chart_type from events")
def a2_file_names(spark, sf):
    return X.table(spark, sf, "events").select("event_id", ingest.file_date(F.expr(_FN)).alias("day"), ingest.file_chart_type(F.expr(_FN)).alias("chart_type"))


@query("select event_id, case event_id % 6 when 2 then '免费榜' when 3 then null when 4 then '畅销榜' else '热门榜' end as chart_type from events")
def a3_chart_types(spark, sf):
    return X.table(spark, sf, "events").select("event_id", ingest.file_chart_type(F.expr(_FN)).alias("chart_type"))


@query("select case when p_size % 5 = 0 then date '2024-02-01' else date '2024-01-01' end as date, case when p_partkey % 2 = 0 then 'iOS' else 'Android' end as platform, '热门榜' as chart_type, p_type as category, case when p_size % 7 = 0 then 0 else p_size end as rank, case when p_partkey % 3 = 0 then 'fallback:' || p_name else p_partkey::varchar end as bundle_id, p_name as game_name, case when p_size % 4 = 0 then null else p_brand end as developer from part")
def a4_normalise(spark, sf):
    raw = X.table(spark, sf, "part").selectExpr("case when p_size % 7 = 0 then 'n/a' else cast(p_size as string) end as rank", "case when p_partkey % 3 = 0 then '0' else cast(p_partkey as string) end as bundle_id", "p_name as game_name", "case when p_partkey % 2 = 0 then 'IOS游戏榜' else ' android ' end as platform_raw", "p_type as category", "case when p_size % 4 = 0 then '0' else p_brand end as developer", "case when p_size % 5 = 0 then '2024-02-01' else '' end as date_override", "date '2024-01-01' as date", "'热门榜' as chart_type")
    return ingest.normalize_rankings(raw)


@query("with r as (select p_partkey % 4 g, p_partkey r, case when p_size % 10 = 0 then [p_size::varchar, p_name] when p_size % 10 = 1 then [p_size::varchar, p_name, p_brand, 'x'] else [p_size::varchar, p_name, p_brand] end c from part), f as (select g, r, try_cast(c[1] as int) rank, c[2] name, coalesce(c[3], '') brand from r) select g::int as \"group\", rank, name, brand from (select *, row_number() over (partition by g, rank order by r) k from f where rank between 1 and 500) where k = 1")
def a11_positional(spark, sf):
    rows = X.table(spark, sf, "part").selectExpr("cast(p_partkey % 4 as int) as group", "p_partkey as row", "case when p_size % 10 = 0 then array(cast(p_size as string), p_name) when p_size % 10 = 1 then array(cast(p_size as string), p_name, p_brand, 'x') else array(cast(p_size as string), p_name, p_brand) end as cells")
    return ingest.positional_rows(rows, ["rank", "name", "brand"]).drop("row")


@query("select p_partkey as id, p_name as game_name, p_type as category from part")
def a12_standardize(spark, sf):
    raw = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("应用"), F.col("p_type").alias("品类"), F.lit("").alias("nothing"))
    return ingest.drop_empty_columns(ingest.standardize(raw, {"应用": "game_name", "品类": "category"}))


def _chart_files(spark, sf) -> str:
    """Chart files of the rankings under names of days, as two scrapers write them: other columns in another order from the 11th on; besides them files without
    a date, of another kind, and without any row that has a name."""
    path = tables.work_dir(spark, "chart-files")
    rank = F.when(F.col("rank") % 7 == 0, "n/a").otherwise(F.col("rank").cast("string"))
    bundle = F.when(F.col("rank") % 5 == 0, "0").otherwise(F.col("bundle_id"))
    name = F.when(F.col("rank") % 11 == 0, " ").otherwise(F.col("game_name"))
    by = F.when(F.col("rank") % 3 == 0, "0").otherwise(F.col("developer"))
    rows = X.rankings(spark, sf)
    first = rows.where("date <= date '2024-01-10'").select(
        F.concat(F.date_format("date", "yyyyMMdd"), F.lit("_免费榜")).alias("name"), rank.alias("排名"), bundle.alias("Bundle ID"), name.alias("应用"),
        F.when(F.col("platform") == "iOS", "IOS游戏榜").otherwise(" android ").alias("iOS/Android"), F.col("category").alias("类别"), by.alias("开发者"),
    )
    later = rows.where("date > date '2024-01-10'").select(
        F.concat_ws("_", F.lit("rank"), "date").alias("name"), F.upper("platform").alias("platform"), F.lit("old").alias("类别"), by.alias("publisher"), name.alias("game_name"),
        F.concat(F.lit('"'), "category", F.lit('", x')).alias("genre"), bundle.alias("bundle_id"), rank.alias("rank"), F.date_add("date", 100).cast("string").alias("scrape_date"),
    )
    others = first.where(F.col("排名") == "1")
    for part in (first, later, others.withColumn("name", F.lit("undated")), others.withColumn("name", F.lit("资讯_2024-01-09")), others.withColumns({"应用": F.lit(" "), "name": F.lit("2024-02-01")})):
        # one file a name
        part.repartition("name").write.mode("append").option("header", True).option("escape", '"').partitionBy("name").csv(path)
    return path


def _folder_name(path):
    """The folder stands for the file here, as Spark names files itself."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -2)), "^name=", "")


A1 = """f as (select *, date <= date '2024-01-10' early from rankings where rank % 11 <> 0)
select case when early then date else date + 100 end as date, platform, case when early then '免费榜' else '热门榜' end as chart_type, case when early then category else '"' || category || '", x' end as category,
case when rank % 7 = 0 then 0 else rank end as rank, case when rank % 5 = 0 or bundle_id = '0' then 'fallback:' || trim(game_name) else bundle_id end as bundle_id,
trim(game_name) as game_name, case when rank % 3 <> 0 then coalesce(developer, '') end as developer from f"""


@query(X.sql(A1, "rankings"))
def a1_read_rankings(spark, sf):
    return ingest.read_rankings(spark, _chart_files(spark, sf), _folder_name)[0]


@query("select * from (values ('undated', 'no date in the name'), ('资讯_2024-01-09', 'not a chart'), ('2024-02-01', 'no rows')) t(name, reason) where (select count(*) from events) > 0")
def a1_rejected_files(spark, sf):
    rejects = ingest.read_rankings(spark, _chart_files(spark, sf), _folder_name)[1]
    return rejects.select(_folder_name(F.col("path")).alias("name"), "reason").distinct()


@query(X.sql("select platform, chart_type, count(*) as n from rankings group by all", "rankings"))
def a13_write_rankings(spark, sf):
    path = tables.work_dir(spark, "rankings-sink")
    ingest.write_rankings(X.rankings(spark, sf).drop("category"), path, "parquet")
    return spark.read.parquet(path).groupBy("platform", "chart_type").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, 'T' || doc_id as headline, 'https://a.org/' || doc_id as url, date '2024-01-01' + cast(doc_id % 28 as int) as publish_date from documents where doc_id % 9 <> 0")
def a14_rss(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<rss><item><title>"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("<![CDATA[T"), "doc_id", F.lit("]]>"))), F.lit("</title><link>https://a.org/"), "doc_id", F.lit("</link><description>&lt;p&gt;x</description><pubDate>Mon, "), F.date_format(F.expr("date_add(date '2024-01-01', cast(doc_id % 28 as int))"), "dd MMM yyyy"), F.lit(" 08:00:00 GMT</pubDate></item></rss>")).alias("xml"))
    items = ingest.rss_items(d)
    return items.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("doc_id"), "headline", "url", "publish_date")


def _api(spark, sf):
    """Answers of a video service: some aren't JSON, some rows lack an id, some counts are words."""
    d = X.table(spark, sf, "documents").where("lang is not null")
    one = F.concat(F.lit('{"bvid":"'), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("BV"), "doc_id")), F.lit('","title":"v'), "doc_id", F.lit('","play":'), F.when(F.col("doc_id") % 4 == 0, '"--"').otherwise((F.col("doc_id") * 3).cast("string")), F.lit(',"comment":'), "doc_id", F.lit(',"pic":"c.jpg","length":"'), F.when(F.col("doc_id") % 2 == 0, "").otherwise("01:02"), F.lit('","created":'), F.lit(1704067200) + F.col("doc_id"), F.lit("}"))
    answer = F.when(F.col("doc_id") % 11 == 0, F.lit("oops {")).otherwise(F.concat(F.lit('{"data":{"list":{"vlist":['), one, F.lit("]}}}")))
    return d.select(F.col("lang").alias("creator_uid"), F.upper("lang").alias("creator_label"), answer.alias("json"))


VID = "vd as (select doc_id, lang creator_uid, upper(lang) creator_label, 'BV' || doc_id as bvid, 'v' || doc_id as title, '' as description, 'https://www.bilibili.com/video/BV' || doc_id as url, 'c.jpg' as cover, case when doc_id % 4 = 0 then 0 else doc_id * 3 end as play_count, doc_id as comment_count, cast(0 as bigint) as video_review, case when doc_id % 2 = 0 then '' else '01:02' end as duration, make_timestamp((1704067200 + doc_id)::bigint * 1000000) as created_at from documents where lang is not null and doc_id % 5 <> 0 and doc_id % 11 <> 0)"


@query(f"with {VID} select * exclude (doc_id), cast(row_number() over (partition by creator_uid order by created_at desc, bvid) as int) as place from vd")
def a15_videos(spark, sf):
    return ingest.video_rows(_api(spark, sf)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(f"with {VID} select bvid, case when doc_id % 3 = 0 then 'd' || doc_id else '' end as description, case when doc_id % 3 = 0 then 'cat' else '' end as category, case when doc_id % 3 = 0 and duration = '' then '01:' || lpad(cast(doc_id % 60 as varchar), 2, '0') else duration end as duration, case when doc_id % 3 = 0 then doc_id else 0 end as like_count, cast(0 as bigint) as coin_count from vd")
def a15_details(spark, sf):
    d = X.table(spark, sf, "documents").where("doc_id % 3 < 2")
    data = F.concat(F.lit('{"code":'), F.when(F.col("doc_id") % 3 == 0, "0").otherwise("-404"), F.lit(',"data":{"desc":"d'), "doc_id", F.lit('","tname":"cat","duration":'), 60 + F.col("doc_id") % 60, F.lit(',"stat":{"like":'), "doc_id", F.lit("}}}"))
    told = d.select(F.concat(F.lit("BV"), "doc_id").alias("bvid"), data.alias("json"))
    return ingest.with_details(ingest.video_rows(_api(spark, sf)), told).select("bvid", "description", "category", "duration", "like_count", "coin_count")


@query(f"with {VID}, s as (select * from vd where creator_uid <> 'en'), p as (select page_id, 'p' || page_id % 5 creator_uid from pages) select creator_uid, bvid, cast(row_number() over (partition by creator_uid order by created_at desc, bvid) as int) as place from s union all select 'en' || page_id, 'BVx' || page_id || k, cast(k as int) from pages, unnest([1, 2]) t(k) where page_id % 2 = 0")
def a15_page_fallback(spark, sf):
    api = ingest.video_rows(_api(spark, sf).where("creator_uid <> 'en'"))
    link = lambda k: F.concat(F.lit('<a class="c" href="//www.bilibili.com/video/BVx'), F.col("page_id").cast("string"), F.lit(f'{k}?x=1" title="t{k}">go</a>'))
    page = X.table(spark, sf, "pages").select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("en"), F.col("page_id").cast("string"))).otherwise("de").alias("creator_uid"), F.lit("L").alias("creator_label"), F.concat(F.col("html"), link(1), link(2), link(1)).alias("html"))
    return ingest.or_page_videos(api, page).select("creator_uid", "bvid", "place")


@query("select page_id, page_id as app_id, case when page_id % 3 = 1 then 'E' || page_id else 'Card' end as game_name, case when page_id % 3 <> 2 then date '2024-01-05' end as start_date, case when page_id % 3 <> 2 then 'https://t.org/app/' || page_id end as url from pages")
def a16_jsonld(spark, sf):
    """Some pages lack the cards, some hold event data that isn't JSON."""
    event = F.concat(F.when(F.col("page_id") % 3 == 2, F.lit("[{")).otherwise(F.lit("[")), F.lit('{"@type":"Event","name":"E'), "page_id", F.lit('","startDate":"2024-01-05T10:00:00Z","url":"https://t.org/app/'), "page_id", F.lit('"}]'))
    cards = F.when(F.col("page_id") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit('<script id="__data__">[{"app_id":1,"title":2},'), "page_id", F.lit(',"Card"]</script>')))
    p = X.table(spark, sf, "pages").select("page_id", "url", F.concat("html", F.lit('<script type="application/ld+json">'), event, F.lit("</script>"), cards).alias("html"))
    return pages.merge_events_cards(pages.html_jsonld(p), pages.html_app_cards(p))


LINK = "lk as (select page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1)) tag, generate_subscripts(regexp_extract_all(html, '(?is)(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1), 1) pos from pages), l2 as (select page_id, pos, regexp_extract(tag, '(?is)href=\"([^\"]*)\"', 1) h, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) title, regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) root from lk), l3 as (select page_id, pos, case when h like '/%' then root || h else h end href, title from l2 where length(title) >= 4 and lower(title) not in ('首页','登录','注册','更多','home','login','more')), l4 as (select page_id, href, min_by(title, pos) title, min(pos) pos from l3 where href <> '' group by 1, 2)"


@query(f"with {LINK} select page_id, cast(k as int) as place, href, title from (select *, row_number() over (partition by page_id order by pos) k from l4) where k <= 20")
def a17_links(spark, sf):
    return pages.html_links(X.table(spark, sf, "pages"), least=4)


_NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript")
_PAGE = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in _NOISE_TAGS:
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', '', 'g')"
_PLAIN = "regexp_replace(regexp_replace(h, '(?i)</?(p|div|br|li|h1|h2|h3|article|section|tr)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _a, _b_ in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b_}')"


@query(f"with a as (select page_id, {_PAGE} h from pages), b as (select page_id, coalesce(nullif(regexp_extract(h, '(?is)(<article\\b.*</article>)', 1), ''), h) h from a), c as (select page_id, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 20) l from b) select page_id, substr(array_to_string(list_slice(l, 1, 12), chr(10)), 1, 800) as body from c")
def a18_bodies(spark, sf):
    return pages.html_body(X.table(spark, sf, "pages"))


_ROOT = "regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1)"


@query(f"select page_id, cast(1 as int) as slot, 'https://i.org/' || page_id || '.jpg' as image from pages where page_id % 2 = 0 union all select page_id, cast(k as int), case k when 1 then 'https://i.org/in' || page_id || '.jpg' when 2 then {_ROOT} || '/plain.jpg' else 'https://i.org/ad' || page_id || '.jpg' end from pages, unnest([1, 2, 3]) t(k) where page_id % 2 = 1")
def a19_images(spark, sf):
    """Even pages have a meta image; odd ones have images of which the one amid content comes first, the one in a side bar last."""
    n = F.col("page_id").cast("string")
    meta = F.concat(F.lit('<meta property="og:image" content="https://i.org/'), n, F.lit('.jpg">'))
    bare = F.concat(F.lit('<div class="sidebar"><img src="https://i.org/ad'), n, F.lit('.jpg"></div><img src="/plain.jpg"><div class="main-content"><img width="640px" src="https://i.org/in'), n, F.lit('.jpg"></div><div class="widget"><div id="ad-1"><img src="https://i.org/x.jpg"></div></div>'))
    small = F.lit('<img src="https://i.org/logo.png"><img width="100" src="https://i.org/s.jpg"><img height="90" src="https://i.org/h.jpg">')
    html = F.concat(F.lit("<html><body>"), F.when(F.col("page_id") % 2 == 0, F.concat(meta, small, bare)).otherwise(F.concat(small, bare)), F.lit("</body></html>"))
    return pages.html_images(X.table(spark, sf, "pages").select("page_id", "url", html.alias("html")))


@query("with t as (select page_id, lower(html) l from pages), c as (select page_id, l, len(string_split(l, 'port')) - 1 + len(string_split(l, '移植')) - 1 n, len(string_split(l, 'und')) - 1 m from t) select page_id, case when contains(l, 'steam_integration') then 'port' when n > 0 and (contains(l, 'ios') or contains(l, 'que')) then case when m >= n then 'weak' else 'port' end else 'none' end as signal from c")
def a20_port_signal(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", ingest.port_signal(F.col("html"), platforms=("ios", "que"), many=("und",)).alias("signal"))


@query(X.sql("ca as (select distinct game_name, 0 kind from games), ar as (select distinct source || ' ' || category game_name from news) select * from ca union all select game_name, 1 from ar where game_name not in (select game_name from ca)", "games", "news"))
def a21_port_candidates(spark, sf):
    articles = news_(spark, sf).select(F.concat(F.lit("《"), "source", F.lit(" "), "category", F.lit("》"), "headline").alias("headline"))
    return ingest.port_candidates(X.games(spark, sf).select("game_name"), articles)


@query("select doc_id, case doc_id % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 0 end as layer, case when doc_id % 4 = 3 then null else '{\"a\":' || doc_id || '}' end as json from documents")
def a23_extract_json(spark, sf):
    j = F.concat(F.lit('{"a":'), "doc_id", F.lit("}"))
    said = F.when(F.col("doc_id") % 4 == 0, j).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("So: "), j, F.lit(" done"))).otherwise("no json")
    return ingest.extract_json(X.table(spark, sf, "documents").select("doc_id", said.alias("said")), "said").select("doc_id", "layer", "json")


@query(f"with d as (select *, split_part(text, chr(10), 1) h from documents) select trim(h) as headline, source, 'https://x.org/' || doc_id as url, '' as publish_date, doc_id % 2 = 0 or {_b('h', COMMON)} as track_relevant from d where doc_id % 10 <> 0 and trim(h) <> ''")
def a26_to_news(spark, sf):
    d = X.table(spark, sf, "documents").selectExpr("split_part(text, '\n', 1) as title", "source", "case when doc_id % 10 = 0 then ' ' else concat('https://x.org/', doc_id) end as link", "case when doc_id % 2 = 0 then '1' else 'no' end as track_relevant")
    return ingest.to_market_news(d, COMMON)


@query("select p_name as game_name, p_partkey::varchar as bundle_id, case when p_size % 3 <> 0 then p_size / 10.0 end as rating, p_type || ',' || case when p_size % 4 = 0 then 'Steam' else p_brand end as tags, p_type as genre, case when p_size % 5 = 0 then '首发' else '新游' end as event_type, p_size % 4 = 0 or regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), '(^|[^a-z0-9_])gear([^a-z0-9_]|$)') as track_relevant from part where p_size % 6 <> 0")
def a26_to_games(spark, sf):
    raw = X.table(spark, sf, "part").selectExpr("case when p_size % 6 = 0 then ' ' else p_name end as `应用`", "concat('fallback:', p_partkey) as `Bundle ID`", "case when p_size % 3 = 0 then 'n/a' else cast(p_size / 10 as string) end as rating", "concat(p_type, ',', case when p_size % 4 = 0 then 'Steam' else p_brand end) as tags", "p_type as `品类`", "case when p_size % 5 = 0 then '首发' else '' end as event_type")
    return ingest.to_new_games(raw, ("gear",)).select("game_name", "bundle_id", "rating", "tags", "genre", "event_type", "track_relevant")


@query("select p_name as game_name, p_partkey::varchar as bundle_id, p_type as genre, true as has_mobile_version, true as track_relevant from part where p_size % 6 <> 0")
def a26_to_ports(spark, sf):
    raw = X.table(spark, sf, "part").selectExpr("case when p_size % 6 = 0 then '' else p_name end as game_name", "concat('fallback:', p_partkey) as bundle_id", "p_type as genre")
    return ingest.to_ports(raw).drop("source")


@query("select 'BV' || doc_id as bvid, lang as creator_uid, case when doc_id % 4 = 0 then 0 else doc_id end as play_count, doc_id * 2 as like_count, cast(0 as bigint) as share_count from documents where doc_id % 5 <> 0 and lang is not null")
def a26_to_videos(spark, sf):
    raw = X.table(spark, sf, "documents").where("lang is not null").selectExpr("case when doc_id % 5 = 0 then '' else concat('BV', doc_id) end as bvid", "lang as creator_uid", "case when doc_id % 4 = 0 then 'many' else concat(doc_id, '.0') end as views", "cast(doc_id * 2 as string) as like_count")
    return ingest.to_videos(raw).select("bvid", "creator_uid", "play_count", "like_count", "share_count")
