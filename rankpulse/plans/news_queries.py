"""Topics, tables, news, scoring and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import params as P
from ..functions import scalars as S
from ..operators import charts, feedback, news, scoring, tables, tracks
from . import ORACLES, query
from .chart_queries import CHANGES, WORDS
from .scalar_queries import AS_OF, BODY, EVEN, FUSE, KEYQ, SIGNAL, STORY_NOISE, TOKENS, _joined, _stripped, _words

#: Words that the invented articles hold, for rules whose own words don't occur in them.
COMMON = ("tion", "heing", "que", "und")
TOPICS = {"german": ("und", "der"), "french": ("que", "les"), "spanish": ("los", "que"), "english": ("the", "tion")}


def as_of():
    return F.expr(AS_OF)


def jan5():
    return F.expr("date '2024-01-05'")


def _b(col: str, words) -> str:
    return f"regexp_matches(lower({col}), '(^|[^a-z0-9_])({'|'.join(words)})([^a-z0-9_]|$)')"


def news_(spark, sf):
    return X.news(spark, sf)


def reported(spark, sf):
    return X.news(spark, sf).where("date = date '2024-01-01' and source in ('src1', 'src3')")


REPORTED = "reported as (select * from news where date = date '2024-01-01' and source in ('src1', 'src3'))"
GT = "concat_ws(' ', game_name, tags, genre)"


@query(X.sql(f"select game_name, case when is_port or {_b(GT, ('gear',))} then 'track' when {_b(GT, ('promo',))} then 'ignored' else 'neutral' end as track_class from games", "games"))
def b3_classify_track(spark, sf):
    return tracks.classify_track(X.games(spark, sf), ("game_name", "tags", "genre"), "is_port", ("gear",), ("PROMO",)).select("game_name", "track_class")


@query(X.sql(f"select case when is_port or {_b(GT, ('gear',))} then 'track' when {_b(GT, ('promo',))} then 'ignored' else 'neutral' end as track_class, count(*) as n from games group by 1", "games"))
def b4_bucket_counts(spark, sf):
    return tracks.bucket_counts(tracks.classify_track(X.games(spark, sf), ("game_name", "tags", "genre"), "is_port", ("gear",), ("PROMO",)))


@query(X.sql(CHANGES + " select date, platform, chart_type, bundle_id, game_name from changes where trim(game_name) <> '' and (" + _b("concat_ws(' ', game_name, category, developer)", ("gear",)) + " or lower(game_name) in (select lower(game_name) from games where is_port))", "rankings", "games"))
def b5_track_changes(spark, sf):
    monitored = X.games(spark, sf).where("is_port").select("game_name")
    return tracks.filter_track_changes(charts.diff(X.rankings(spark, sf), WORDS), monitored, ("gear",)).select("date", *charts.KEY, "game_name")


#: Words of the invented headlines for each rule of the filter.
RULES = {"track": ("tion", "heing"), "block": ("ouwhea",), "ignored": ("und", "los"), "video_block": ("esque",), "trend_words": ("ing", "que"), "product": ("ent", "ci"), "known": ("Le",)}


def any_in(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


JUDGE = f"""{REPORTED}, seen as (select distinct unnest({TOKENS}) token from (select {_stripped('headline')} c from reported)),
tok as (select distinct url from (select url, unnest({TOKENS}) token from (select url, {_stripped('headline')} c from news)) where token in (select token from seen)),
vn0 as (select *, source = 'src2' video, {_b('headline', RULES['track'])} tr from news),
judged as (select *, tr track_relevant, case when lower(regexp_replace(url,'[?#].*$','')) in (select lower(regexp_replace(url,'[?#].*$','')) from reported) then 'reported_url'
 when url in (select url from tok) then 'reported_token' when case when video then {any_in('headline', RULES['video_block'])} else contains(lower(headline), 'ouwhea') end then 'blocked'
 when not tr and {_b('headline', RULES['ignored'])} then 'ignored'
 when {any_in('headline', RULES['trend_words'])} and not regexp_matches(headline, '《[^》]+》') and not {any_in('headline', RULES['product'])} and not {any_in('headline', RULES['known'])} then 'generic_trend'
 when not video and not (date '2024-01-30' - publish_date between 0 and 7) then 'stale' end reject_reason from vn0)"""


def with_videos(spark, sf):
    """The articles, those of one source as videos."""
    return news_(spark, sf).withColumn("source", F.when(F.col("source") == "src2", "Bilibili").otherwise(F.col("source")))


@query(X.sql(f"{JUDGE} select url, reject_reason, track_relevant from judged", "news"))
def b6_judge_news(spark, sf):
    return news.judge_news(with_videos(spark, sf), reported(spark, sf), as_of(), **RULES).select("url", "reject_reason", "track_relevant")


@query(X.sql(f"{JUDGE} select coalesce(reject_reason, 'kept') as reason, count(*) as n from judged group by 1", "news"))
def b7_filter_breakdown(spark, sf):
    return news.filter_breakdown(news.judge_news(with_videos(spark, sf), reported(spark, sf), as_of(), **RULES))


@query(X.sql("select date, url, headline from news where source = 'src1' and category = 'en'", "news"))
def b1_scan(spark, sf):
    return tables.scan(news_(spark, sf), date=None, source="src1", category="en").select("date", "url", "headline")


@query(X.sql("select date, url, headline from news where date = date '2024-01-07' and (source = 'src1' or url in (select max(url) from news where date = date '2024-01-07'))", "news"))
def b1_pruned_scan(spark, sf):
    """Scans of a laid-out table by date and key."""
    path, n = tables.work_dir(spark, "scannable"), news_(spark, sf)
    tables.write_scannable(n, path, "date", ("source", "url"), ("url",))
    laid, day = spark.read.parquet(path), F.expr("date '2024-01-07'")
    last = laid.where(F.col("date") == day).agg(F.max("url")).first()[0]
    return tables.scan(laid, date=day, source="src1").unionByName(tables.scan(laid, date=day, url=last)).select("date", "url", "headline").distinct()


@query(X.sql(CHANGES + " select date, platform, chart_type, bundle_id, attention_score from changes where is_significant and platform = 'iOS' order by attention_score desc, date, chart_type, bundle_id limit 50", "rankings"), "attention_score")
def b1_scan_ordered(spark, sf):
    changes = charts.diff(X.rankings(spark, sf), WORDS)
    return tables.scan(changes, [F.desc("attention_score"), "date", "chart_type", "bundle_id"], 50, is_significant=True, platform="iOS", chart_type=None).select("date", *charts.KEY, "attention_score")


@query(X.sql("select url from news where lower(url) not in (select lower(url) from news where date = date '2024-01-01' and source in ('src1', 'src3'))", "news"))
def c3_not_reported(spark, sf):
    return news.not_reported(news_(spark, sf), reported(spark, sf)).select("url")


@query(X.sql(f"{JUDGE} select url from news where url not in (select url from tok)", "news"))
def c4_not_reported_tokens(spark, sf):
    return news.not_reported_tokens(news_(spark, sf), reported(spark, sf)).select("url")


VOTES = "votes as (select *, up - down net, case when up > down then 'positive' when up < down then 'negative' else 'neutral' end sentiment from (select news_url, count(*) filter (feedback_type='thumbs_up') up, count(*) filter (feedback_type='thumbs_down') down from fb where date between date '2024-01-01' and date '2024-01-30' group by 1) where up + down > 0)"
ONE = "fb as (select * from (select *, row_number() over (partition by news_url, open_id, feedback_type order by event_id) k from feedback) where k = 1)"


def votes_(spark, sf):
    return feedback.feedback_votes(feedback.one_vote(X.feedback(spark, sf)), F.expr("date '2024-01-01'"), as_of())


@query(X.sql(f"{ONE} select event_id from fb", "feedback"))
def a6_one_vote(spark, sf):
    return feedback.one_vote(X.feedback(spark, sf)).select("event_id")


@query(X.sql(f"{ONE}, {VOTES} select votes.*, n.date, n.headline, n.source from votes left join (select * from (select *, row_number() over (partition by url order by date desc, headline) k from news) where k = 1) n on n.url = news_url", "feedback", "news"))
def c5_feedback_with_news(spark, sf):
    return feedback.feedback_with_news(votes_(spark, sf), news_(spark, sf))


@query(X.sql(f"{ONE}, {VOTES} select * from votes", "feedback"))
def d4_feedback_votes(spark, sf):
    return votes_(spark, sf)


def daily(spark, sf) -> str:
    """Daily partials of the feedback, of which the last days come again."""
    root, rows = tables.work_dir(spark, "daily"), X.feedback(spark, sf)
    feedback.write_daily(rows, root)
    feedback.write_daily(rows.where("date >= date '2024-01-20'"), root)
    return root


@query(X.sql("select date, feedback_type, count(*) as n from feedback where date '2024-01-30' - date < 14 group by all", "feedback"))
def d5_window_stats(spark, sf):
    return feedback.window_stats(spark, daily(spark, sf), as_of(), 14)


@query(X.sql("select keyword, count(*) as clicks from feedback where date '2024-01-30' - date < 14 and feedback_type = 'hot_click' group by all", "feedback"))
def d6_window_clicks(spark, sf):
    return feedback.window_clicks(spark, daily(spark, sf), as_of())


@query(X.sql("select keyword, count(distinct open_id) as users from feedback where date >= date '2024-01-05' and feedback_type = 'hot_click' group by all", "feedback"))
def d7_window_users(spark, sf):
    return feedback.window_users(spark, daily(spark, sf), jan5())


@query(X.sql("select keyword, count(distinct open_id) as users from feedback where date >= date '2024-01-05' and feedback_type = 'hot_click' and keyword not in ('es') group by 1 having count(distinct open_id) >= 3", "feedback"))
def c15_window_queue(spark, sf):
    reports = X.table(spark, sf, "documents").where("lang = 'es'").select(F.col("lang").alias("topic"))
    return feedback.window_queue(spark, daily(spark, sf), reports, jan5())


@query(X.sql("select date, feedback_type, count(*) as n from feedback where date '2024-01-30' - date < 14 group by all", "feedback"))
def d5_feedback_stats(spark, sf):
    return feedback.feedback_stats(X.feedback(spark, sf), as_of(), 14)


@query(X.sql("select keyword, count(*) as clicks from feedback where date '2024-01-30' - date < 14 and feedback_type = 'hot_click' group by all", "feedback"))
def d6_click_stats(spark, sf):
    return feedback.click_stats(X.feedback(spark, sf), as_of())


@query(X.sql("select keyword, count(distinct open_id) as users from feedback where date >= date '2024-01-05' and feedback_type = 'hot_click' group by all", "feedback"))
def d7_topic_clicks(spark, sf):
    return feedback.topic_clicks(X.feedback(spark, sf), jan5())


@query(X.sql("select distinct keyword, open_id from feedback where date >= date '2024-01-05' and feedback_type = 'hot_click'", "feedback"))
def d7_topic_clickers(spark, sf):
    return feedback.topic_clickers(X.feedback(spark, sf), jan5())


VN = ONE + ", " + VOTES + ", vn as (select votes.*, n.headline, coalesce(pos_label,'') pos_label, coalesce(neg_label,'') neg_label, " + _b('n.headline', COMMON) + " track_relevant from votes join news n on n.url = news_url left join scores s on s.url = news_url)"
EV = "ev as (" + " union all ".join(f"select '{t}' topic, cast(sum(up) as bigint) up, cast(sum(down) as bigint) down, count(*) n from vn where {_b('headline', w)} having count(*) > 0" for t, w in TOPICS.items()) + ")"
BOOST = "bo as (select topic, cast(case when down>=3 and up-down<0 then greatest(-20, -10-2*(down-3)) when up>=5 and up-down>0 then least(20, 5+2*(up-5)) end as int) boost from ev), bo2 as (select * from bo where boost is not null)"


def voted(spark, sf):
    labels = X.scores(spark, sf).select(F.col("url").alias("news_url"), "pos_label", "neg_label")
    told = news_(spark, sf).select(F.col("url").alias("news_url"), "headline", S.keyword_match(F.col("headline"), COMMON).alias("track_relevant"))
    return votes_(spark, sf).join(told, "news_url").join(labels, "news_url", "left").fillna("", ["pos_label", "neg_label"])


@query(X.sql(f"{VN}, {EV} select * from ev", "feedback", "news", "scores"))
def d9_topic_evidence(spark, sf):
    return feedback.topic_evidence(voted(spark, sf), TOPICS)


@query(X.sql(f"{VN}, {EV}, {BOOST} select * from bo2", "feedback", "news", "scores"))
def d10_topic_boost(spark, sf):
    return feedback.topic_boost(feedback.topic_evidence(voted(spark, sf), TOPICS))


@query(X.sql("p as (select lang topic, cast(count(*) % 21 - 10 as int) boost from documents group by 1), c as (select lang topic, cast(count(*) % 5 as int) boost from documents where doc_id % 2 = 0 and lang in ('en', 'fr') group by 1) select topic, coalesce(c.boost, cast(trunc(p.boost / 2.0) as int)) as boost from p full join c using (topic) where coalesce(c.boost, cast(trunc(p.boost / 2.0) as int)) <> 0", "news"))
def d11_merge_boosts(spark, sf):
    docs = X.table(spark, sf, "documents")
    p = docs.groupBy(F.col("lang").alias("topic")).agg((F.count(F.lit(1)) % 21 - 10).cast("int").alias("boost"))
    c = docs.where("doc_id % 2 = 0 and lang in ('en', 'fr')").groupBy(F.col("lang").alias("topic")).agg((F.count(F.lit(1)) % 5).cast("int").alias("boost"))
    return feedback.merge_boosts(p, c)


NETS = """nets as (select coalesce(sum(net) filter (track_relevant),0)::bigint track_net, coalesce(sum(net) filter (pos_label = 'high_info_density' or neg_label = 'low_info'),0)::bigint density_net,
 coalesce(sum(net) filter (pos_label in ('overseas_insight','exclusive_scoop')),0)::bigint insight_net, count(*) filter (track_relevant) track_rows, count(*) filter (pos_label = 'high_info_density' or neg_label = 'low_info') density_rows,
 count(*) filter (pos_label in ('overseas_insight','exclusive_scoop')) insight_rows from vn)"""


@query(X.sql(f"{VN}, {NETS} select * from nets", "feedback", "news", "scores"))
def d12_dim_nets(spark, sf):
    return feedback.dim_nets(voted(spark, sf))


def _w(n, base):
    net = f"{n}_net"
    return f"greatest(10, least(70, {base} + case when {net}>=3 then least(15, 5+{net}-3) when {net}<=-3 then -least(15, 5-{net}-3) else 0 end)) {n}"


@query(X.sql(f"{VN}, {NETS}, w as (select {_w('track', 40)}, {_w('density', 35)}, {_w('insight', 25)} from nets), r as (select cast(round_even(track*100.0/(track+density+insight), 0) as int) t, cast(round_even(density*100.0/(track+density+insight), 0) as int) d, cast(round_even(insight*100.0/(track+density+insight), 0) as int) i from w) select t + case when t >= greatest(d, i) then 100-t-d-i else 0 end as track, d + case when t < greatest(d, i) and d >= i then 100-t-d-i else 0 end as density, i + case when t < greatest(d, i) and d < i then 100-t-d-i else 0 end as insight from r", "feedback", "news", "scores"))
def d13_dim_weights(spark, sf):
    return feedback.dim_weights(feedback.dim_nets(voted(spark, sf)), {"track": 40, "density": 35, "insight": 25})


@query(X.sql(f"{VN}, {EV}, {BOOST} select topic, case when boost > 0 then 'raise' else 'lower' end as action, boost, case when up+down>=10 then 'high' when up+down>=5 then 'medium' else 'low' end as confidence from bo2 join ev using (topic)", "feedback", "news", "scores"))
def d14_findings(spark, sf):
    e = feedback.topic_evidence(voted(spark, sf), TOPICS)
    return feedback.findings(e, feedback.topic_boost(e))


CAL = f"""{VN}, {EV}, {BOOST}, {NETS}, w as (select {_w('track', 40)}, {_w('density', 35)}, {_w('insight', 25)} from nets), r as (select cast(round_even(track*100.0/(track+density+insight), 0) as int) t, cast(round_even(density*100.0/(track+density+insight), 0) as int) d, cast(round_even(insight*100.0/(track+density+insight), 0) as int) i from w),
dw as (select t + case when t >= greatest(d, i) then 100-t-d-i else 0 end as track, d + case when t < greatest(d, i) and d >= i then 100-t-d-i else 0 end as density, i + case when t < greatest(d, i) and d < i then 100-t-d-i else 0 end as insight from r),
pb as (select * from (values ('german', -7), ('old', 9)) x(topic, old)), mb as (select topic, coalesce(boost, cast(trunc(old / 2.0) as int)) boost from pb full join bo2 using (topic)), tb as (select '{{' || string_agg('"' || topic || '":' || boost, ',' order by topic) || '}}' topic_boosts from mb where boost <> 0)"""


@query(X.sql(f"{CAL} select cast((select sum(up + down) from vn) as bigint) as n_votes, cast(coalesce((select max(event_id % 7) from events where event_type = 'signup'), 0) + 1 as bigint) as version, topic_boosts, track, density, insight from tb, dw where (select sum(up + down) from vn) >= 30", "feedback", "news", "scores"))
def d15_calibrate(spark, sf):
    previous = spark.createDataFrame([("german", -7), ("old", 9)], "topic string, boost int")
    versions = X.table(spark, sf, "events").where("event_type = 'signup'").select((F.col("event_id") % 7).alias("version"))
    out = feedback.calibrate(voted(spark, sf), TOPICS, previous, versions, {"track": 40, "density": 35, "insight": 25})
    return out.withColumn("topic_boosts", F.to_json("topic_boosts"))


def labelled(spark, sf):
    """Articles with their labels and whether they are on a followed topic."""
    told = news_(spark, sf).select("url", S.keyword_match(F.col("headline"), COMMON).alias("track_relevant"))
    return told.join(X.scores(spark, sf).select("url", "pos_label", "neg_label"), "url", "left")


FID = "fv as (select v.news_url, v.up, v.down, v.net, coalesce(pos_label,'') p, coalesce(neg_label,'') g, coalesce(" + _b("n.headline", COMMON) + """, false) tr from votes v left join scores s on s.url = v.news_url left join news n on n.url = v.news_url),
fx as (select *, p in ('track_direct', 'high_info_density', 'exclusive_scoop', 'overseas_insight') good, g in ('off_track', 'no_gameplay', 'low_info', 'stale') bad from fv),
f1 as (select *, up+down t, case when good and net>0 then 1.0 when bad and net<0 then 0.85 when (good and net<0) or (bad and net>0) then 0.40 when (good or bad) and net=0 then 0.25 else 0.15 end ag from fx),
f2 as (select *, cast(round(0.40*cast(ag as decimal(6,4)) + 0.30*(case when t>=5 then 1.0 when t>=3 then 0.75 when t=2 then 0.40 when t=1 then 0.15 else 0 end * (0.5+0.5*cast(abs(net)::double/t as decimal(12,8)))) + case when tr then 0.2 else 0 end + case when p<>'' or g<>'' then 0.1 else 0 end, 3) as decimal(4,3)) fidelity from f1)"""


@query(X.sql(f"{ONE}, {VOTES}, {FID} select news_url, fidelity, fidelity>=0.3 as kept, case when fidelity<0.3 then 'low' when fidelity<0.6 then 'medium' else 'high' end as level from f2", "feedback", "news", "scores"), "fidelity")
def g6_fidelity(spark, sf):
    return feedback.with_fidelity(votes_(spark, sf), labelled(spark, sf), F.col("track_relevant")).select("news_url", "fidelity", "kept", "level")


@query(X.sql(f"{ONE}, {VOTES}, {FID} select level, count(*) as n, sum(fidelity) as fidelity from (select *, case when fidelity<0.3 then 'low' when fidelity<0.6 then 'medium' else 'high' end level from f2) group by 1", "feedback", "news", "scores"), "fidelity")
def s13_fidelity_levels(spark, sf):
    return feedback.with_fidelity(votes_(spark, sf), labelled(spark, sf), F.col("track_relevant")).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("fidelity").alias("fidelity"))


@query(X.sql(f"{ONE}, {VOTES}, b as (select *, row_number() over (order by up+down desc, news_url) place from votes) select b.news_url, up, down, net, sentiment, cast(place as int) as place, n.date, n.headline, n.source from b left join news n on n.url = b.news_url where place <= 30", "feedback", "news"))
def g8_feedback_digest(spark, sf):
    return feedback.feedback_digest(votes_(spark, sf), news_(spark, sf))


@query(X.sql("select keyword, count(distinct open_id) as users from feedback where date >= date '2024-01-05' and feedback_type = 'hot_click' and keyword not in ('es') group by 1 having count(distinct open_id) >= 3", "feedback"))
def c15_research_queue(spark, sf):
    reports = X.table(spark, sf, "documents").where("lang = 'es'").select(F.col("lang").alias("topic"))
    return feedback.research_queue(X.feedback(spark, sf), reports, jan5())


@query(X.sql(f"select date, url, '[B站·'||category||'] '||headline as headline, 'Bilibili' as source, {_b('headline', COMMON)} as track_relevant from news where source = 'src2' union all select date, url, headline, source, {_b('headline', COMMON)} from news where source <> 'src2'", "news"))
def f1_union_videos(spark, sf):
    n = news_(spark, sf)
    videos = n.where("source = 'src2'").select("date", F.col("category").alias("label"), F.col("headline").alias("title"), F.lit("").alias("tags"), "url")
    rest = n.where("source <> 'src2'").select("date", "headline", "source", "url", S.keyword_match(F.col("headline"), COMMON).alias("track_relevant"))
    return news.videos_as_news(videos, COMMON).unionByName(rest)


@query(X.sql("select url, max(event_id) as event_id from (select news_url url, min(event_id) event_id from feedback group by 1) group by 1", "feedback"))
def f2_distinct_url(spark, sf):
    return news.distinct_url(X.feedback(spark, sf).select(F.col("news_url").alias("url"), "event_id"), ["event_id"])


@query(X.sql("select url from news where url not in (select news_url from feedback)", "news", "feedback"))
def f4_minus_reported(spark, sf):
    return news_(spark, sf).select("url").join(X.feedback(spark, sf).select(F.col("news_url").alias("url")).distinct(), "url", "left_anti")


@query(X.sql(f"w as (select url, {_words('headline', 2, 3)} h, {_words('body', 2, 3)} b from news) select url, len(list_intersect(h, b)) as common, len(list_distinct(list_concat(h, b))) as either from w", "news"))
def f5_set_sizes(spark, sf):
    h, b = S.topic_words(F.col("headline")), S.topic_words(F.col("body"))
    return news_(spark, sf).select("url", F.size(F.array_intersect(h, b)).alias("common"), F.size(F.array_union(h, b)).alias("either"))


_HWORDS = f"list_filter(list_distinct(regexp_extract_all(headline, '[\\p{{L}}\\p{{N}}_]{{2,}}')), lambda x: not list_contains({list(P.FATIGUE_NOISE)}, x))"
PUB = "pub as (select date, headline from (select n.date, n.headline, row_number() over (partition by n.date order by s.score desc, n.url) k from news n join scores s using (url)) where k <= 3)"
FAT = f"""{PUB}, tk as (select date, {KEYQ.replace('(t,', '(headline,').replace('(t)', '(headline)')} topic, count(distinct headline) n from pub group by 1, 2), td as (select date + cast(i as int) date, topic, n from tk, range(1, 4) r(i)), tt as (select date, topic, sum(n) n from td group by 1, 2),
nk as (select *, {KEYQ.replace('(t,', '(headline,').replace('(t)', '(headline)')} tkey from news), wd as (select distinct date + cast(i as int) date, {KEYQ.replace('(t,', '(headline,').replace('(t)', '(headline)')} topic, {_HWORDS} w from pub, range(1, 4) r(i)),
ma as (select nk.date, nk.url, tt.n from nk join tt on nk.date = tt.date and length(tkey)>=3 and length(topic)>=3 and (contains(tkey, topic) or contains(topic, tkey))
 union all select n.date, n.url, tt.n from (select date, url, {_HWORDS} w from news) n join wd on n.date = wd.date and len(list_intersect(n.w, wd.w)) >= 4 join tt on tt.date = wd.date and tt.topic = wd.topic),
fs as (select date, url, max(n) seen from ma group by 1, 2)"""


def published(spark, sf):
    scored = news_(spark, sf).join(X.scores(spark, sf), "url")
    return scoring.top_n(scored, ["date"], [F.desc("score"), "url"], 3).select("date", "headline")


@query(X.sql(f"{FAT} select date, url, cast(coalesce(seen, 0) as bigint) as seen from news left join fs using (date, url)", "news", "scores"))
def e17_fatigue(spark, sf):
    return news.fatigue(news_(spark, sf), published(spark, sf)).select("date", "url", "seen")


@query(X.sql(f"{FAT}, {JUDGE} select url, case when seen = 1 then 'downgraded' else '' end as fatigue from judged left join fs using (date, url) where reject_reason is null and coalesce(seen, 0) < 2", "news", "scores"))
def g3_news_candidates(spark, sf):
    kept = news.filter_news(with_videos(spark, sf), reported(spark, sf), as_of(), **RULES)
    return news.apply_fatigue(kept, published(spark, sf)).select("url", "fatigue")


SIM = f"list_filter(list_distinct(regexp_extract_all(lower(headline), '[a-z]{{2,}}')), lambda x: not list_contains({STORY_NOISE}, x))"


@query(X.sql(f"k as (select date, url, {SIM} t from news) select a.date, a.url as a, b.url as b, len(list_intersect(a.t, b.t)) as common, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) as either from k a join k b on a.date = b.date and a.url < b.url where len(a.t) > 0 and len(b.t) > 0 and len(list_intersect(a.t, b.t)) >= 0.15 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))", "news"))
def c11_same_story_pairs(spark, sf):
    items = news_(spark, sf).withColumnRenamed("url", "id")
    return news.same_story_pairs(items, S.similarity_tokens(F.col("headline")), ["date"])


STORY_SQL = """k as (select n.date, n.url, {0} t, {1} e, {2} h from news n join scores s using (url)) select a.date, a.url as a, b.url as b from k a join k b on a.date = b.date and a.url < b.url
where len(list_intersect(a.e, b.e)) >= 2 or len(list_intersect(a.h, b.h)) >= 2 or (len(a.t) > 0 and len(b.t) > 0 and 100 * len(list_intersect(a.t, b.t)) >= 15 * len(list_distinct(list_concat(a.t, b.t))))"""


@query()
def c11_story_pairs(spark, sf):
    items = scored(spark, sf).withColumnRenamed("url", "id")
    return news.story_pairs(items, F.col("summary"), F.col("headline"), ["date"])


@query(X.sql(f"k as (select date, url, list_filter(list_distinct(regexp_extract_all(headline, '[A-Z][a-z]{{2,}}(?:[A-Z][a-z]+)*')), lambda x: not list_contains({list(P.ENTITY_STOP)}, x)) t from news) select a.date, a.url as a, b.url as b from k a join k b on a.date = b.date and a.url < b.url where len(list_intersect(a.t, b.t)) >= 2", "news"))
def c11_shared_entities(spark, sf):
    return news.shared_entity_pairs(news_(spark, sf).withColumnRenamed("url", "id"), S.named_entities(F.col("headline")), ["date"])


def gamed(spark, sf):
    return news_(spark, sf).select("date", F.col("url").alias("id"), F.concat(F.lit("《"), "source", F.lit("》"), "headline").alias("headline"), F.expr("cast(substr(source, 4) as int)").alias("place"))


@query(X.sql(f"gm as (select date, url, source, {_words('headline', 2, 3)} w from news) select a.date, a.url as a, b.url as b from gm a join gm b on a.date = b.date and a.source = b.source and a.url < b.url where len(list_intersect(a.w, b.w)) >= 2", "news"))
def c12_same_day_pairs(spark, sf):
    return news.same_day_pairs(gamed(spark, sf))


#: Item by item in the order of place and id: one stays unless it is paired with one that stayed.
DROP = f"""gm as (select date, url, source, cast(substr(source, 4) as int) place, {_words('headline', 2, 3)} w from news), pr as (select a.date, a.url a, b.url b from gm a join gm b on a.date = b.date and a.source = b.source and a.url <> b.url where len(list_intersect(a.w, b.w)) >= 2),
od as (select date, url, place, row_number() over (partition by date order by place, url) k from gm), op as (select od.date, od.url, od.place, od.k, coalesce(list(pr.b) filter (pr.b is not null), []) bs from od left join pr on pr.date = od.date and pr.a = od.url group by all),
ks as (select date, 0::bigint k, []::varchar[] kept from (select distinct date from od) union all select ks.date, ks.k + 1, case when len(list_intersect(kept, bs)) = 0 then list_append(kept, op.url) else kept end from ks join op on op.date = ks.date and op.k = ks.k + 1),
kl as (select date, unnest(kept) url from (select *, row_number() over (partition by date order by k desc) z from ks) where z = 1)"""


@query(X.sql(f"{DROP} select date, url as id, place from kl join gm using (date, url)", "news"))
def c12_drop_same_day(spark, sf):
    return news.drop_same_day_items(gamed(spark, sf)).select("date", "id", "place")


#: Each benchmark text is a claim, made by one of the articles of its day, which are its results in the order of their bodies' lengths.
CLAIM = f"""cl as (select item_id claim_id, {_stripped('text')} c, date '2024-01-01' + cast(item_id % 30 as int) as date from benchmark), ct as (select claim_id, date, {TOKENS} w from cl), ow as (select date, min(url) own from news group by 1),
nt as (select *, {TOKENS} hw from (select *, {_stripped('headline')} c from news)), rs as (select claim_id, n.url, n.headline title, substr(n.body, 1, 200) snippet, row_number() over (partition by claim_id order by length(n.body), n.url) place, len(list_intersect(w, hw)) k from ct join nt n using (date) left join ow using (date) where n.url <> own),
rk as (select *, case when k >= 2 then 'c' when k = 1 then 'o' else 'u' end kind from rs), rn as (select *, row_number() over (partition by claim_id, kind order by place) z from rk),
g as (select claim_id, count(*) filter (kind = 'c') c, count(*) filter (kind = 'o') o, count(*) filter (kind = 'u') u, {', '.join(f"string_agg(url || ' ' || title || ' ' || snippet, '|' order by z) filter (kind = '{k}' and z <= 3) l{k}" for k in 'cou')} from rn group by 1)"""


@query(X.sql(f"{CLAIM} select claim_id, coalesce(g.c, 0) as n_corroborating, coalesce(o, 0) as n_other, coalesce(u, 0) as n_unrelated, coalesce(lc, '') as corroborating, coalesce(lo, '') as other, coalesce(lu, '') as unrelated, case when g.claim_id is null then 'isolated_claim' when g.c >= 2 then 'verified' when g.c = 1 then 'partial' else 'unverified' end as verdict from cl left join g using (claim_id)", "news"))
def c13_cross_validate(spark, sf):
    n = news_(spark, sf)
    day = F.expr("date_add(date '2024-01-01', cast(item_id % 30 as int))").alias("date")
    own = n.groupBy("date").agg(F.min("url").alias("url"))
    claims = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), day).join(own, "date", "left")
    short = n.select("date", F.struct(F.length("body"), "url").alias("place"), "url", F.col("headline").alias("title"), F.substring("body", 1, 200).alias("snippet"))
    results = short.join(claims.select("claim_id", "date"), "date").drop("date")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["url"], x["title"], x["snippet"])), "|").alias(c)
    return news.cross_validate(claims, results).select("claim_id", "n_corroborating", "n_other", "n_unrelated", line("corroborating"), line("other"), line("unrelated"), "verdict")


_KNOWN = """k as (select distinct game_name as known from games), b as (select name, trim(regexp_split_to_array(name, '\\s*[-—–（(]\\s*')[1]) base0 from l), c as (select name, case when base0 <> name then base0 else '' end base from b),
p as (select name, known, case when name = known then 1 when base = known then 2 when length(base) >= 3 and length(known) >= 3 and (contains(base, known) or contains(known, base)) then 3
 when length(known) >= 3 and (contains(name, known) or (length(name) >= 2 and contains(known, name))) then 4 end way from c, k)
select name, known, way from (select *, row_number() over (partition by name order by way, known) r from p where way is not null) where r = 1"""


@query(X.sql(f"l as (select distinct game_name||' - pre' as name from rankings), {_KNOWN}", "rankings", "games"))
def c6_fuzzy_names(spark, sf):
    left = X.rankings(spark, sf).select(F.concat("game_name", F.lit(" - pre")).alias("name")).distinct()
    return news.fuzzy_name_join(left, X.games(spark, sf).select(F.col("game_name").alias("name")))


@query(X.sql(f"l as (select 'pre – '||game_name as name from rankings union select substr(game_name, 1, 2) from rankings union select upper(game_name)||'（x）' from rankings union select game_name||'—— x' from rankings union select substr(game_name, 3, 5) || ' (x)' from rankings), {_KNOWN}", "rankings", "games"))
def c6_fuzzy_names_full(spark, sf):
    """Known names behind the dash, names of two characters, other dashes and brackets, other case, bases within known names."""
    g = F.col("game_name")
    said = F.array(F.concat(F.lit("pre – "), g), F.substring(g, 1, 2), F.concat(F.upper(g), F.lit("（x）")), F.concat(g, F.lit("—— x")), F.concat(F.substring(g, 3, 5), F.lit(" (x)")))
    left = X.rankings(spark, sf).select(F.explode(said).alias("name")).distinct()
    return news.fuzzy_name_join(left, X.games(spark, sf).select(F.col("game_name").alias("name")))


SC = "sc as (select n.date, n.url, s.score from news n join scores s using (url))"


def scored(spark, sf):
    return news_(spark, sf).join(X.scores(spark, sf), "url")


@query(X.sql(f"{SC}, g as (select date, count(*) n, count(*) filter (score<40) n_low, count(*) filter (score>60) n_high, cast(floor(count(*)/4) as bigint) need_low, cast(floor(count(*)*3/10) as bigint) most_high from sc group by 1) select *, n<4 or (n_low>=need_low and n_high<=most_high) as ok from g", "news", "scores"))
def d20_distribution(spark, sf):
    return scoring.check_distribution(scored(spark, sf), ["date"])


FB = f"{SC}, fb0 as (select *, count(*) over (partition by date) n, row_number() over (partition by date order by score, url) u, row_number() over (partition by date order by score desc, url) d from sc), capped as (select date, url, score raw_score, cast(case when u<=greatest(1, floor(n/4)) and score>=40 then 39 when d<=floor(n*3/10) and score>65 then 64 else score end as int) score from fb0)"


@query(X.sql(f"{FB} select * from capped", "news", "scores"))
def e10_score_fallback(spark, sf):
    return scoring.apply_score_fallback(scored(spark, sf), ["date"]).select("date", "url", "raw_score", "score")


@query(X.sql(f"{SC} select date, url, score, cast(k as int) as place from (select *, row_number() over (partition by date order by score desc, url) k from sc) where k <= 12", "news", "scores"))
def e9_top_n(spark, sf):
    return scoring.top_n(scored(spark, sf), ["date"], [F.desc("score"), "url"], 12).select("date", "url", "score", "place")


#: The greedy choice of each date: a row with what is chosen so far, grown by the best row that fits until none does.
GREEDY = """rd as (select date, any_value(af) af, chosen from (select date, bool_or(far) over (partition by date) af, [] :: struct(u varchar, s varchar, ol varchar, g varchar, sc int, f boolean, t varchar[], e varchar[], h varchar[])[] chosen from pool) group by date, chosen),
ch as (select date, af, chosen from rd union all
 select date, any_value(af), list_append(any_value(chosen), min(struct_pack(turn := turn, down := -score, u := url, s := source, ol := outlet, g := game, sc := score, f := far, t := t, e := e, h := h))::struct(turn int, down int, u varchar, s varchar, ol varchar, g varchar, sc int, f boolean, t varchar[], e varchar[], h varchar[])) from (
  select *,
   case when fit3 and not (not far and len(chosen) = 6 and not hasfar and af) then 1 when far and not hasfar and fit6 then 2 when fit3 then 3 end turn
  from (select ch.date, af, chosen, url, source, outlet, game, score, far, t, e, h, len(list_filter(chosen, lambda c: c.f)) > 0 hasfar,
   len(list_filter(chosen, lambda c: c.ol = p.outlet)) < case outlet when 'Bilibili' then 2 else 3 end and len(list_filter(chosen, lambda c: c.g = p.game)) < 2 fit3,
   len(list_filter(chosen, lambda c: c.ol = p.outlet)) < 6 and len(list_filter(chosen, lambda c: c.g = p.game)) < 2 fit6
   from ch join pool p on ch.date = p.date where len(chosen) < 7
    and len(list_filter(chosen, lambda c: c.u = p.url or len(list_intersect(c.e, p.e)) >= 2 or len(list_intersect(c.h, p.h)) >= 2
     or (len(c.t) > 0 and len(p.t) > 0 and 100 * len(list_intersect(c.t, p.t)) >= 15 * len(list_distinct(list_concat(c.t, p.t)))))) = 0))
 where turn is not null group by date),
best as (select date, unnest(chosen) c, generate_subscripts(chosen, 1) slot from (select *, row_number() over (partition by date order by len(chosen) desc) k from ch) where k = 1)"""
_ENT = lambda c: f"list_distinct(list_concat(list_filter(regexp_extract_all({c}, '[A-Z][a-z]{{2,}}(?:[A-Z][a-z]+)*'), lambda x: not list_contains({list(P.ENTITY_STOP)}, x)), list_filter({list(P.ENTITY_COMPANIES)}, lambda x: contains({c}, x))))"
_SIM = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{2,}}')), lambda x: not list_contains({STORY_NOISE}, x))"
#: Names under which two of the sources write, and what they stand for.
ALIASED = "case source when 'src1' then (case when url like '%1' then 'B站' when url like '%2' then ' bilibili.com' else 'Bilibili' end) when 'src3' then (case when url like '%5' then 'PG.biz' else 'pocketgamer' end) when 'src2' then (case when url like '%3' then '游侠' end) else source end"
OUTLET = "case lower(trim(source)) when 'b站' then 'Bilibili' when 'bilibili.com' then 'Bilibili' when 'bilibili' then 'Bilibili' when 'pg.biz' then 'pocketgamer.biz' when 'pocketgamer' then 'pocketgamer.biz' when '游侠' then '' else coalesce(trim(source), '') end"
POOL = lambda rows: f"pool as (select date, url, source, coalesce(nullif(regexp_extract(headline, '《([^》]+)》', 1), ''), substr(headline, 1, 8)) game, score, {OUTLET} outlet, {OUTLET} = 'pocketgamer.biz' far, {_SIM('summary')} t, {_ENT('summary')} e, {_ENT('headline')} h from {rows})"


ORACLES["c11_story_pairs"] = X.sql(STORY_SQL.format(_SIM("s.summary"), _ENT("s.summary"), _ENT("n.headline")), "news", "scores")


@query(X.sql(f"sr as (select n.date, n.url, n.headline, {ALIASED.replace('source', 'n.source').replace('url like', 'n.url like')} as source, s.score, s.summary from news n join scores s using (url)), {POOL('sr')}, {GREEDY} select date, c.u as url, c.s as source, c.sc as score, cast(slot as int) as slot from best", "news", "scores"))
def e11_diverse_top(spark, sf):
    return scoring.select_diverse(scored(spark, sf).withColumn("source", F.expr(ALIASED)), story=scoring.story_marks(F.col("summary"), F.col("headline")))


@query(X.sql(f"{SC}, r as (select s.*, {_b('n.headline', COMMON)} t from sc s join news n using (url)) select date, url, cast(row_number() over (partition by date order by t desc, score desc, url) as int) as place from r", "news", "scores"))
def e18_report_order(spark, sf):
    rows = scored(spark, sf).withColumn("track_relevant", S.keyword_match(F.col("headline"), COMMON))
    return scoring.report_order(rows).select("date", "url", "place")


@query(X.sql("select date, url, cast(floor((row_number() over (partition by date order by url) - 1) / 15) as int) as batch, cast((row_number() over (partition by date order by url) - 1) % 15 as int) as place from news", "news"))
def e19_batches(spark, sf):
    return scoring.batch_number(news_(spark, sf), ["date"], ["url"]).select("date", "url", "batch", "place")


@query(X.sql(f"{SC} select sc.url, greatest(0, least(100, score + case when {_b('headline', TOPICS['english'])} then -7 else 0 end + case when {_b('headline', TOPICS['german'])} then 12 else 0 end)) as score from sc join news using (url)", "news", "scores"))
def s11_topic_boost(spark, sf):
    return scored(spark, sf).select("url", scoring.topic_boost(F.col("headline"), {"german": 12, "english": -7}, TOPICS, F.col("score")).alias("score"))


G4_BOOSTS = {"german": 12, "english": -7}
G4 = f"""body as (select n.*, n.body as b, s.score told, s.pos_label, s.neg_label, s.summary from news n left join scores s using (url)), {BODY}, sg as (select *, cast({SIGNAL} as int) s from sig0), x0 as (select *, 3*s+7*coalesce(told, 0) x10 from sg where s >= 15), x1 as (select *, {EVEN} f from x0),
x2 as (select date, url, headline, source, coalesce(pos_label, '') pos_label, coalesce(neg_label, '') neg_label, coalesce(summary, '') summary, told, greatest(0, least(100, {FUSE('coalesce(told, 0)')} + case when {_b('headline', TOPICS['english'])} then -7 else 0 end + case when {_b('headline', TOPICS['german'])} then 12 else 0 end)) raw from x1),
x3 as (select *, count(*) over (partition by date) n, count(told) over (partition by date) > 0 given, row_number() over (partition by date order by raw, url) u, row_number() over (partition by date order by raw desc, url) d, count(*) filter (raw<40) over (partition by date) lo, count(*) filter (raw>60) over (partition by date) hi from x2),
g4 as (select date, url, headline, source, pos_label, neg_label, summary, given, cast(case when n<4 or (lo>=floor(n/4) and hi<=floor(n*3/10)) then raw when u<=greatest(1, floor(n/4)) and raw>=40 then 39 when d<=floor(n*3/10) and raw>65 then 64 else raw end as int) score from x3)"""


@query(X.sql(f"{G4} select date, url, headline, source, score, pos_label, neg_label from g4 where given and score >= 40", "news", "scores"))
def g4_gated_news(spark, sf):
    rows = scoring.judged_news(news_(spark, sf), X.scores(spark, sf), 2024, boosts=G4_BOOSTS, topics=TOPICS)
    return rows.where("given and score >= 40").drop("summary", "given")


#: Scores of a part of the days, so that the rule for days without any shows.
_PART = "doc_scores as (select s.* from scores s join news n using (url) where n.date <= date '2024-01-24')"


@query(X.sql(f"{_PART}, {G4.replace('left join scores s', 'left join doc_scores s')}, gp as (select * replace ({ALIASED} as source) from g4 where given and score >= 40), {POOL('gp')}, {GREEDY}, bare as (select *, row_number() over (partition by date order by url) k from g4 where not given) select g4.date, url, headline, {ALIASED.replace('source', 'g4.source')} as source, score, pos_label, neg_label, cast(slot as int) as slot from g4 join best on g4.date = best.date and url = c.u union all select date, url, headline, {ALIASED}, 0, pos_label, neg_label, cast(k as int) from bare where k <= 7", "news", "scores"))
def g4_score_news(spark, sf):
    early = news_(spark, sf).where("date <= date '2024-01-24'").select("url")
    named = news_(spark, sf).withColumn("source", F.expr(ALIASED))
    return scoring.score_news(named, X.scores(spark, sf).join(early, "url", "left_semi"), 2024, boosts=G4_BOOSTS, topics=TOPICS)


# --- tables


def _halves(spark, sf):
    n = news_(spark, sf).select("date", "url", "headline")
    return n.where("date <= date '2024-01-20'"), n.where("date >= date '2024-01-10'").withColumn("headline", F.concat("headline", F.lit("!")))


@query(X.sql("select date, url, case when date >= date '2024-01-10' then headline||'!' else headline end as headline from news", "news"))
def a5_upsert_last(spark, sf):
    old, new = _halves(spark, sf)
    return tables.upsert_last(old, new, ["date", "url"], ["headline"])


@query(X.sql("select date, url, headline||'!' as headline from news where date > date '2024-01-20'", "news"))
def a6_insert_ignore(spark, sf):
    old, new = _halves(spark, sf)
    return tables.insert_ignore(old, new, ["date", "url"], ["headline"])


@query(X.sql("select date, url, headline||'!' as headline from news where date > date '2024-01-20'", "news"))
def a7_insert_news(spark, sf):
    old, new = _halves(spark, sf)
    blank = new.limit(1).select("date", F.lit("").alias("url"), "headline")
    return tables.insert_news_deduped(old, new.unionByName(blank), as_of(), ["headline"])


COUNTERS = "ct as (select news_url, count(*) filter (feedback_type='thumbs_up') n_up, count(*) filter (feedback_type='thumbs_down') n_down, count(*) filter (feedback_type='hot_click') n_clicks from feedback group by 1)"


@query(X.sql(f"{COUNTERS} select date, url, headline, coalesce(n_up, 0) as n_up, coalesce(n_down, 0) as n_down from news left join ct on news_url = url", "news", "feedback"))
def a8_refresh_keeping(spark, sf):
    old = tables.counters(X.feedback(spark, sf)).withColumnRenamed("news_url", "url")
    new = news_(spark, sf).select("date", "url", "headline", F.lit(0).alias("n_up"), F.lit(0).alias("n_down"))
    return tables.refresh_keeping(old, new, ["url"], ["n_up", "n_down"])


@query(X.sql(f"{COUNTERS} select * from ct", "feedback"))
def h5_counters(spark, sf):
    return tables.counters(X.feedback(spark, sf))


@query(X.sql("select distinct date from news where date not in (select date from rankings where date <= date '2024-01-10')", "news", "rankings"))
def a9_new_files(spark, sf):
    return tables.new_files(news_(spark, sf).select("date").distinct(), X.rankings(spark, sf).where("date <= date '2024-01-10'"))


@query(X.sql("select 'news' as source_table, date, count(*) as n from news group by 2 union all select 'rankings', date, count(*) from rankings group by 2 union all select 'games', date, count(*) from games where not is_port group by 2 union all select 'ports', date, count(*) from games where is_port group by 2", "news", "rankings", "games"))
def a10_source_coverage(spark, sf):
    g = X.games(spark, sf)
    return tables.source_coverage({"news": news_(spark, sf), "rankings": X.rankings(spark, sf), "games": g.where("not is_port"), "ports": g.where("is_port")})


@query(X.sql("rq as (select distinct category as query, date from news), ch as (select md5(category || '|' || date) query_hash, timestamp '2024-01-30 00:00:00' - to_hours(cast(length(body) % 48 as int)) cached_at, url as result from news), fr as (select * from (select *, row_number() over (partition by query_hash order by cached_at desc, result) k from ch where cached_at <= timestamp '2024-01-30 00:00:00' and cached_at > timestamp '2024-01-30 00:00:00' - interval 24 hours) where k = 1) select query, date, md5(query || '|' || date) as query_hash, result from rq left join fr on fr.query_hash = md5(query || '|' || date)", "news"))
def a22_ttl_lookup(spark, sf):
    n, now = news_(spark, sf), F.expr("timestamp '2024-01-30 00:00:00'")
    cache = n.select(F.md5(F.concat_ws("|", "category", F.col("date").cast("string"))).alias("query_hash"), (now - F.make_dt_interval(hours=F.length("body") % 48)).alias("cached_at"), F.col("url").alias("result"))
    return tables.ttl_lookup(n.select(F.col("category").alias("query"), "date").distinct(), cache, 24, now).select("query", "date", "query_hash", "result")


TOLD = "told as (select url item_key, case source when 'src1' then 'bilibili' when 'src2' then 'taptap' else 'news' end item_type, date reported_date, '' meta from news)"


def told_items(spark, sf):
    kind = F.when(F.col("source") == "src1", "bilibili").when(F.col("source") == "src2", "taptap").otherwise("news")
    return news_(spark, sf).select(F.col("url").alias("item_key"), kind.alias("item_type"), F.col("date").alias("reported_date"), F.lit("").alias("meta"))


@query(X.sql(f"{TOLD} select item_key, item_type, case when item_type = 'news' and item_key like '%1' then date '2024-01-30' else reported_date end as reported_date, case when item_type = 'news' and item_key like '%1' then 'again' else '' end as meta from told union all select url, 'news', date '2024-01-30', 'again' from news where source in ('src1', 'src2') and url like '%1'", "news"))
def h1_mark_reported(spark, sf):
    keys = news_(spark, sf).where("url like '%1'").select(F.col("url").alias("item_key"))
    return tables.mark_reported(told_items(spark, sf), keys, "news", as_of(), "again")


@query(X.sql(f"{TOLD} select item_key, item_type from told where item_type = 'news' or date '2024-01-30' - reported_date <= case item_type when 'bilibili' then 20 else 7 end", "news"))
def h1_prune_reported(spark, sf):
    return tables.prune_reported(told_items(spark, sf), as_of(), {"bilibili": 20, "taptap": 7}).select("item_key", "item_type")


@query(X.sql("select url from news where date '2024-01-30' - date <= 15", "news"))
def h1_prune(spark, sf):
    return tables.prune(news_(spark, sf), as_of(), 15).select("url")


@query(X.sql("select url, coalesce(pos_label, '-') as pos_label from news left join scores using (url)", "news", "scores"))
def h2_label_write_back(spark, sf):
    t = news_(spark, sf).select("url", F.lit("-").alias("pos_label"))
    return tables.write_back(t, X.scores(spark, sf), ["url"], ["pos_label"])


@query(X.sql(f"{SC}, t as (select * from (select *, row_number() over (partition by date order by score desc, url) k from sc) where k <= 7) select url, url in (select url from t) as selected from news", "news", "scores"))
def h3_selection_flag(spark, sf):
    chosen = scoring.top_n(scored(spark, sf), ["date"], [F.desc("score"), "url"], 7).select("url")
    return tables.set_flag(news_(spark, sf).select("url"), chosen, ["url"], "selected")


@query(X.sql("select url, coalesce(score, -1) as score, headline from news left join scores using (url)", "news", "scores"))
def h4_score_write_back(spark, sf):
    t = news_(spark, sf).select("url", F.lit(-1).alias("score"), "headline")
    return tables.write_back(t, X.scores(spark, sf), ["url"], ["score"])


@query(X.sql("select date, max(url) as url, case when date >= date '2024-01-10' then cast(count(*) as int) else 0 end as version from news group by 1", "news"))
def h6_report_upsert(spark, sf):
    """The reports of a part of the days come again."""
    n = news_(spark, sf).groupBy("date").agg(F.max("url").alias("url"), F.count(F.lit(1)).cast("int").alias("version"))
    return tables.upsert_last(n.withColumn("version", F.lit(0)), n.where("date >= date '2024-01-10'"), ["date"], ["version"])


VERS = "select cast(event_id as int) version, user_id % 2 = 0 applied from events where event_type = 'signup'"


@query(f"with v as ({VERS}) select version, applied or version = (select max(version) from v) as applied from v")
def h6_mark_applied(spark, sf):
    v = X.table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").cast("int").alias("version"), (F.col("user_id") % 2 == 0).alias("applied"))
    top = v.agg(F.max("version").alias("top"))
    return tables.mark_applied(v.join(F.broadcast(top)), F.col("top")).drop("top")


@query(X.sql("runs as (select cast(row_number() over (order by run_id) as bigint) id, run_id, total from (select run_id, cast(sum(latency_ms) as bigint) total from audit_log group by 1)) select * from runs union all select (select max(id) from runs) + row_number() over (order by nm), nm, n from (values ('late', 5::bigint), ('a run', 7::bigint)) x(nm, n)", "audit_log"))
def h6_append_run(spark, sf):
    runs = X.audit_log(spark, sf).groupBy("run_id").agg(F.sum("latency_ms").alias("total"))
    runs = tables.numbered(runs.withColumn("all", F.lit(1)), ["all"], ["run_id"], "id").select(F.col("id").cast("long").alias("id"), "run_id", "total")
    return tables.append_runs(runs, spark.createDataFrame([("late", 5), ("a run", 7)], "run_id string, total long"), ["run_id"])


@query(X.sql("select source, count(*) as n from news group by 1", "news"))
def d19_source_counts(spark, sf):
    return news_(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(X.sql("select keyword as bundle_id, cast(cast(sum(2 * (30 - (date '2024-01-30' - date))) as decimal(18,4)) / 30 as decimal(18,4)) as priority from feedback where date '2024-01-30' - date between 0 and 29 and feedback_type = 'hot_click' group by 1", "feedback"), "priority")
def x3_priority(spark, sf):
    q = X.feedback(spark, sf).where("feedback_type = 'hot_click'").select(F.col("keyword").alias("bundle_id"), "date")
    return feedback.priority(q, as_of())


@query(X.sql("select date, keyword, cast(least(20, count(*) * 5) / 10.0 as decimal(4,1)) as boost from feedback where feedback_type = 'hot_click' group by all", "feedback"), "boost")
def x4_click_boost(spark, sf):
    return feedback.click_boost(X.feedback(spark, sf).where("feedback_type = 'hot_click'"))
