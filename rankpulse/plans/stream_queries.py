"""Streams run to their end over the given tables, payloads, and the SQL surface."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import charts, recompute
from ..operators.tables import work_dir
from ..streaming import jobs
from . import query, sqlapi
from .chart_queries import CHANGES, STORIES, STREAK, WORDS
from .news_queries import _b
from .scalar_queries import BODY, TOKENS, _stripped


def _folder(spark: SparkSession) -> str:
    return work_dir(spark, "stream")


def _drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """A stream run to its end into a table; complete and update modes keep the last batch's rows."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _votes(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """The feedback table as a stream of files."""
    rows = X.feedback(spark, sf).withColumn("ts", F.col("date").cast("timestamp"))
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query(X.sql("select date, platform, chart_type, bundle_id, case when date >= date '2024-01-10' then rank + 1000 else rank end as rank from rankings", "rankings"))
def k1_file_ingest(spark, sf):
    """Later files hold other ranks for dates that earlier ones have, each row twice, the good one last by its category mark."""
    folder = _folder(spark)
    rows = X.rankings(spark, sf).withColumn("category", F.lit("b"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    late = rows.where("date >= date '2024-01-10'").withColumn("rank", F.col("rank") + 1000)
    for part in (rows.where("date <= date '2024-01-15'"), late.unionByName(late.withColumns({"rank": F.lit(-1), "category": F.lit("a")}))):
        part.repartition("date").write.mode("append").parquet(f"{folder}/in")  # rows of one key in one file
        jobs.ingest_files(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state", schema, ["date", *charts.KEY], order=["category"]).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("date", *charts.KEY, "rank")


@query(X.sql("v as (select news_url, case when event_id % 50 = 0 then '' else open_id end open_id, feedback_type from feedback) select distinct * from v where open_id <> '' union all select v.* from v, range(3) where open_id = ''", "feedback"))
def k2_one_vote(spark, sf):
    """Two runs of one stream: the second brings all votes again, twice, a hundred days later. Votes without a user pass each time."""
    folder = _folder(spark)
    rows = X.feedback(spark, sf).select(F.col("date").cast("timestamp").alias("ts"), "news_url", F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("open_id")).alias("open_id"), "feedback_type")
    later = rows.withColumn("ts", F.expr("ts + interval 100 days"))
    for part in (rows, later.unionByName(later)):
        part.write.mode("append").parquet(f"{folder}/in")
        votes = jobs.one_vote(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out = _drained(votes, folder)
    return out.select("news_url", "open_id", "feedback_type")


@query(X.sql("select news_url, count(*) filter (feedback_type='thumbs_up') as n_up, count(*) filter (feedback_type='thumbs_down') as n_down, count(*) filter (feedback_type='hot_click') as n_clicks from feedback group by 1", "feedback"))
def k3_counters(spark, sf):
    folder = _folder(spark)
    return _drained(jobs.running_counters(_votes(spark, sf, folder)), folder, "complete")


@query(X.sql("select date as day, feedback_type, count(*) as n from feedback group by all", "feedback"))
def k3_windowed_counts(spark, sf):
    folder = _folder(spark)
    out = _drained(jobs.windowed_counts(_votes(spark, sf, folder)), folder, "complete")
    return out.select(F.to_date("window.start").alias("day"), "feedback_type", "n")


@query(X.sql("select keyword, count(distinct open_id) as users from feedback where feedback_type = 'hot_click' and open_id <> '' group by 1 having count(distinct open_id) >= 3", "feedback"))
def k4_threshold_trigger(spark, sf):
    folder = _folder(spark)
    clicks = _votes(spark, sf, folder).where("feedback_type = 'hot_click'")
    jobs.threshold_trigger(clicks, f"{folder}/clicks", f"{folder}/fired", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/fired").select("keyword", "users")


@query(X.sql("select event_id, case event_id % 4 when 3 then null else feedback_type end as action, case event_id % 4 when 3 then null else news_url end as news_url from feedback", "feedback"))
def k5_payloads(spark, sf):
    inner = F.to_json(F.struct(F.when(F.col("event_id") % 4 == 3, "other").otherwise(F.col("feedback_type")).alias("action"), "news_url", "keyword"))
    payload = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(inner)
    return X.feedback(spark, sf).select("event_id", jobs.parse_payload(payload).alias("p")).select("event_id", "p.action", "p.news_url")


@query(X.sql("select platform, chart_type, count(*) as n from rankings where rank <= 3 group by all", "rankings"))
def i1_read_only_sql(spark, sf):
    X.rankings(spark, sf).createOrReplaceTempView("rankings")
    return sqlapi.run_sql(spark, "select platform, chart_type, count(*) as n from rankings where rank <= 3 group by all")[0]


@query(X.sql(CHANGES + " select date, change_type, rank_change from changes where bundle_id = '7'", "rankings"))
def i2_templates(spark, sf):
    charts.diff(X.rankings(spark, sf), WORDS).createOrReplaceTempView("changes")
    return sqlapi.template(spark, "change_history", bundle_id="7")


@query(X.sql("select date, rank from rankings where bundle_id = '7' and chart_type = 'view'", "rankings"))
def i2_rank_history(spark, sf):
    X.rankings(spark, sf).createOrReplaceTempView("rankings")
    return sqlapi.template(spark, "rank_history", bundle_id="7", chart_type="view")


@query(X.sql("select rank, game_name, bundle_id from rankings where date = date '2024-01-09' and platform = 'iOS' and chart_type = 'view'", "rankings"))
def i2_chart_of_day(spark, sf):
    X.rankings(spark, sf).createOrReplaceTempView("rankings")
    return sqlapi.template(spark, "chart_of_day", date=dt.date(2024, 1, 9), platform="iOS", chart_type="view")


@query(X.sql("select distinct date from rankings", "rankings"))
def i2_dates(spark, sf):
    X.rankings(spark, sf).createOrReplaceTempView("rankings")
    return sqlapi.template(spark, "dates")


@query(X.sql(CHANGES + " select platform, chart_type, bundle_id, attention_score from changes where date = date '2024-01-09' and is_significant", "rankings"), "attention_score")
def i2_significant_changes(spark, sf):
    charts.diff(X.rankings(spark, sf), WORDS).createOrReplaceTempView("changes")
    return sqlapi.template(spark, "significant_changes", date=dt.date(2024, 1, 9)).select(*charts.KEY, "attention_score")


@query(X.sql("sc as (select category as query, source as engine, cast(length(body) as int) result_count, date + to_hours(cast(length(headline) as int)) searched_at from news) select query, engine, result_count, searched_at from sc order by searched_at desc, query, engine, result_count limit 10", "news"))
def i2_recent_searches(spark, sf):
    at = (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.length("headline"))).alias("searched_at")
    X.news(spark, sf).select(F.col("category").alias("query"), F.col("source").alias("engine"), F.length("body").alias("result_count"), at).createOrReplaceTempView("search_cache")
    return sqlapi.template(spark, "recent_searches")


_HIT = lambda w: f"regexp_matches(lower(headline), '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')"


@query(X.sql(f"select url, lower(regexp_replace(url, '[?#].*$', '')) as canonical, {_HIT('und')} as hit, contains(lower(headline), 'e3') as part, contains(lower(headline), 'a.') as dot from news", "news"))
def i2_sql_functions(spark, sf):
    sqlapi.register_functions(spark)
    X.news(spark, sf).createOrReplaceTempView("news")
    return spark.sql("select url, url_canonical(url) as canonical, keyword_match(headline, 'und') as hit, keyword_match(headline, 'E3') as part, keyword_match(headline, 'a.') as dot from news")


@query(X.sql(f"{BODY.replace('from body', 'from (select *, body as b from news)')} select url, array_to_string(list_sort({TOKENS}), '|') as tokens, cast(facts as int) as facts, fresh, digest, case source when 'src1' then '3DM' when 'src2' then null else source end as source from (select *, {_stripped('headline')} c from sig0)", "news"))
def i2_text_functions(spark, sf):
    sqlapi.register_functions(spark)
    X.news(spark, sf).createOrReplaceTempView("news")
    named = "case source when 'src1' then ' 3dmgame' when 'src2' then 'GamerSky' else source end"
    return spark.sql(f"select url, array_join(array_sort(dedup_tokens(headline)), '|') as tokens, s.facts, s.fresh, s.digest, source from (select url, headline, body_signals(body, 2024) as s, source_canonical({named}) as source from news)")


_TRACK = _b("concat_ws(' ', game_name, category, developer)", [w.lower() for w in WORDS])


@query(X.sql(CHANGES + " select date, platform, chart_type, bundle_id, attention_score - case when " + _TRACK + " and change_type <> 'dropped_out' then 1.5 else 0 end as attention from changes where attention_score < 10", "rankings"), "attention")
def i2_attention_function(spark, sf):
    sqlapi.register_functions(spark)
    charts.diff(X.rankings(spark, sf), WORDS).createOrReplaceTempView("changes")
    return spark.sql("select date, platform, chart_type, bundle_id, cast(attention_tenths(change_type, today_rank, yesterday_rank, rank_change) / 10 as decimal(4, 1)) as attention from changes where attention_score < 10")


#: Charts whose 5th is upside down, whose 9th is gone, and whose 20th lacks a platform in places.
RERUN = """rankings2 as materialized (select * replace (case when date = date '2024-01-05' then 51 - rank else rank end as rank) from rankings where date <> date '2024-01-09' and not (date = date '2024-01-20' and rank % 2 = 0))"""
_ANEW = lambda text: text.replace("from rankings", "from rankings2")


def _rerun(spark, sf) -> str:
    root, rows = _folder(spark), X.rankings(spark, sf)
    recompute.build(rows, root, WORDS)
    late = rows.where("date = date '2024-01-05'").withColumn("rank", 51 - F.col("rank"))
    blank = rows.where("date = date '2024-01-20'").withColumn("platform", F.when(F.col("rank") % 2 == 0, "").otherwise(F.col("platform")))
    dates = spark.sql("select explode(array(date '2024-01-05', date '2024-01-09', date '2024-01-20')) as date")
    recompute.recompute(spark, root, late.unionByName(blank), dates, WORDS)
    return root


@query(X.sql(f"{RERUN}, {_ANEW(CHANGES)} select date, platform, chart_type, bundle_id, change_type, rank_change, attention_score from changes", "rankings"), "attention_score")
def h7_forced_rerun(spark, sf):
    """Changes after three dates came anew."""
    return spark.read.parquet(f"{_rerun(spark, sf)}/changes").select("date", *charts.KEY, "change_type", "rank_change", "attention_score")


@query(X.sql(f"{RERUN}, {_ANEW(CHANGES)}, {_ANEW(STREAK)}, {STORIES} select date, story_type, platform, chart_type, bundle_id, headline, priority, cast(k as int) as place from (select *, row_number() over (partition by date order by priority desc, story_type, platform, chart_type, bundle_id, headline) as k from sd) where k <= 8", "rankings"), "priority")
def h7_rerun_stories(spark, sf):
    return spark.read.parquet(f"{_rerun(spark, sf)}/stories").drop("attention_score")
