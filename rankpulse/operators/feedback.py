"""Reader feedback: votes, fidelity, calibration of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import first_by, overwrite_dates


def one_vote(feedback: DataFrame) -> DataFrame:
    """One row a (url, user, type), the first by event; rows without url or user are all kept."""
    blank = (F.coalesce("news_url", F.lit("")) == "") | (F.coalesce("open_id", F.lit("")) == "")
    return first_by(feedback.where(~blank), ["news_url", "open_id", "feedback_type"], "event_id").unionByName(feedback.where(blank))


def feedback_votes(feedback: DataFrame, since: Column, until: Column) -> DataFrame:
    """Votes of each url in a span of dates: up, down, net, sentiment."""
    rows = feedback.where((F.col("date") >= since) & (F.col("date") <= until))
    v = rows.groupBy("news_url").agg(F.count_if(F.col("feedback_type") == "thumbs_up").alias("up"), F.count_if(F.col("feedback_type") == "thumbs_down").alias("down")).where("up + down > 0")
    net = F.col("up") - F.col("down")
    return v.withColumn("net", net).withColumn("sentiment", F.when(net > 0, "positive").when(net < 0, "negative").otherwise("neutral"))


def feedback_stats(feedback: DataFrame, as_of: Column, days: int) -> DataFrame:
    return feedback.where(F.datediff(as_of, "date") < days).groupBy("date", "feedback_type").agg(F.count(F.lit(1)).alias("n"))


def click_stats(feedback: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    return feedback.where((F.datediff(as_of, "date") < days) & (F.col("feedback_type") == "hot_click")).groupBy("keyword").agg(F.count(F.lit(1)).alias("clicks"))


#: Folders of daily partials below a root, each partitioned by date.
COUNTS, USERS, SKETCHES = "counts", "users", "sketches"


def write_daily(feedback: DataFrame, root: str) -> None:
    """Daily partials of the dates in feedback, over those that are there: counts by type and keyword, distinct users of clicks, and their sketches.

    Any window of days is merged from them without the feedback itself. A blank or missing user is none.
    """
    counts = feedback.groupBy("date", "feedback_type", "keyword").agg(F.count(F.lit(1)).alias("n"))
    users = feedback.where((F.col("feedback_type") == "hot_click") & (F.col("open_id") != "")).select("date", "keyword", "open_id").distinct()
    sketches = users.groupBy("date", "keyword").agg(F.hll_sketch_agg("open_id", F.lit(14)).alias("sketch"))
    for name, df in ((COUNTS, counts), (USERS, users), (SKETCHES, sketches)):
        overwrite_dates(df, f"{root}/{name}")


def window_stats(spark: SparkSession, root: str, as_of: Column, days: int) -> DataFrame:
    """feedback_stats() from daily partials; the plan reads the folders of the window alone."""
    return _days(spark, root, COUNTS, F.date_sub(as_of, days - 1)).groupBy("date", "feedback_type").agg(F.sum("n").alias("n"))


def window_clicks(spark: SparkSession, root: str, as_of: Column, days: int = 14) -> DataFrame:
    """click_stats() from daily partials."""
    return _days(spark, root, COUNTS, F.date_sub(as_of, days - 1)).where("feedback_type = 'hot_click'").groupBy("keyword").agg(F.sum("n").alias("clicks"))


def window_users(spark: SparkSession, root: str, since: Column, approximate: bool = False) -> DataFrame:
    """topic_clicks() from daily partials: exact from the sets of users, or from their merged sketches, of which a day has one a keyword."""
    if approximate:
        return _days(spark, root, SKETCHES, since).groupBy("keyword").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
    return _days(spark, root, USERS, since).groupBy("keyword").agg(F.countDistinct("open_id").alias("users"))


def window_queue(spark: SparkSession, root: str, reports: DataFrame, since: Column, least: int = 3) -> DataFrame:
    """research_queue() from daily partials."""
    return window_users(spark, root, since).where(F.col("users") >= least).join(reports.select(F.col("topic").alias("keyword")).distinct(), "keyword", "left_anti")


def _days(spark: SparkSession, root: str, name: str, since: Column) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").where(F.col("date") >= since)


def topic_clicks(feedback: DataFrame, since: Column, approximate: bool = False) -> DataFrame:
    """Distinct users of each keyword since a date; a blank or missing user is none."""
    rows = feedback.where((F.col("date") >= since) & (F.col("feedback_type") == "hot_click") & (F.col("open_id") != ""))
    return rows.groupBy("keyword").agg((F.approx_count_distinct("open_id") if approximate else F.countDistinct("open_id")).alias("users"))


def topic_clickers(feedback: DataFrame, since: Column) -> DataFrame:
    """The distinct (keyword, user) pairs since a date; a blank or missing user is none."""
    return feedback.where((F.col("date") >= since) & (F.col("feedback_type") == "hot_click") & (F.col("open_id") != "")).select("keyword", "open_id").distinct()


def feedback_with_news(votes: DataFrame, news: DataFrame) -> DataFrame:
    """Votes with the latest news row of their url."""
    one = first_by(news, ["url"], F.desc("date"), "headline").select(F.col("url").alias("news_url"), "date", "headline", "source")
    return votes.join(one, "news_url", "left")


def with_fidelity(votes: DataFrame, labels: DataFrame, track: Column, least: float = 0.30) -> DataFrame:
    """Votes with fidelity decimal(4,3), whether they are kept, and a level. labels: url, pos_label, neg_label, what track looks at."""
    rows = votes.join(labels.withColumn("_track", track).select(F.col("url").alias("news_url"), "pos_label", "neg_label", "_track"), "news_url", "left").fillna("", ["pos_label", "neg_label"])
    f = S.fidelity(F.col("up"), F.col("down"), F.col("pos_label"), F.col("neg_label"), F.coalesce("_track", F.lit(False)))
    rows = rows.withColumn("fidelity", f).drop("_track").withColumn("kept", F.col("fidelity") >= F.lit(str(least)).cast("decimal(4,3)"))
    return rows.withColumn("level", F.when(~F.col("kept"), "low").when(F.col("fidelity") < F.lit("0.600").cast("decimal(4,3)"), "medium").otherwise("high"))


def topic_evidence(votes: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """topic, up, down, n of votes (headline, up, down) by keyword match; a row may hit many topics. Topics are parameters."""
    hit = F.filter(F.array(*[F.when(S.keyword_match(F.col("headline"), w), F.lit(t)) for t, w in sorted(topics.items())]), lambda x: x.isNotNull())
    rows = votes.withColumn("topic", F.explode(hit))
    return rows.groupBy("topic").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))


def topic_boost(evidence: DataFrame) -> DataFrame:
    """topic, boost: -10 - 2 a vote over three against, else 5 + 2 a vote over five for, within 20."""
    net = F.col("up") - F.col("down")
    boost = F.when((F.col("down") >= 3) & (net < 0), F.greatest(F.lit(-20), -10 - 2 * (F.col("down") - 3))).when((F.col("up") >= 5) & (net > 0), F.least(F.lit(20), 5 + 2 * (F.col("up") - 5)))
    return evidence.select("topic", boost.cast("int").alias("boost")).where("boost is not null")


def merge_boosts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Current boosts, and previous ones of absent topics halved toward zero; zeros go."""
    p, c = previous.withColumnRenamed("boost", "old"), current.withColumnRenamed("boost", "new")
    half = (F.col("old") / 2).cast("int")
    return p.join(c, "topic", "full_outer").select("topic", F.coalesce("new", half).alias("boost")).where("boost <> 0")


def dim_nets(votes: DataFrame) -> DataFrame:
    """Net votes of the rows on followed topics (track_relevant), of those on density and of those on insight (by label), in one row."""
    net, pos, neg = F.col("up") - F.col("down"), F.coalesce("pos_label", F.lit("")), F.coalesce("neg_label", F.lit(""))
    of = {
        "track": F.coalesce("track_relevant", F.lit(False)), "density": pos.contains("high_info_density") | neg.contains("low_info"),
        "insight": pos.contains("overseas_insight") | pos.contains("exclusive_scoop"),
    }
    return votes.agg(*[F.coalesce(F.sum(F.when(c, net)), F.lit(0)).alias(f"{n}_net") for n, c in of.items()], *[F.count_if(c).alias(f"{n}_rows") for n, c in of.items()])


def dim_weights(nets: DataFrame, previous: dict[str, int]) -> DataFrame:
    """Weights of track, density and insight: moved by net votes, held to 10..70, scaled to 100, the rest to the largest (the first)."""
    names = ("track", "density", "insight")
    moved = {}
    for n in names:
        net = F.col(f"{n}_net")
        step = F.when(net >= 3, F.least(F.lit(15), 5 + net - 3)).when(net <= -3, -F.least(F.lit(15), 5 - net - 3)).otherwise(0)
        moved[n] = F.greatest(F.lit(10), F.least(F.lit(70), previous[n] + step))
    total = moved["track"] + moved["density"] + moved["insight"]
    rows = nets.select(*[F.bround((moved[n] * 100 / total).cast("decimal(10,4)"), 0).cast("int").alias(n) for n in names])
    rest = 100 - F.col("track") - F.col("density") - F.col("insight")
    top = F.greatest(*names)
    first = F.when(F.col("track") == top, "track").when(F.col("density") == top, "density").otherwise("insight")
    return rows.select(*[(F.col(n) + F.when(first == n, rest).otherwise(0)).cast("int").alias(n) for n in names])


def findings(evidence: DataFrame, boosts: DataFrame) -> DataFrame:
    """A finding a boosted topic, with a confidence by its votes."""
    n = F.col("up") + F.col("down")
    conf = F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low")
    return evidence.join(boosts, "topic").select("topic", F.when(F.col("boost") > 0, "raise").otherwise("lower").alias("action"), "boost", conf.alias("confidence"))


def calibrate(votes: DataFrame, topics: dict[str, tuple[str, ...]], previous: DataFrame, versions: DataFrame, weights: dict[str, int], least: int = 30) -> DataFrame:
    """A row of parameters with the next version, or none under `least` kept votes. votes: kept ones with headline and labels."""
    evidence = topic_evidence(votes, topics)
    boosts = merge_boosts(previous, topic_boost(evidence)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "boost")))).alias("topic_boosts"))
    enough = votes.agg(F.sum(F.col("up") + F.col("down")).alias("n_votes")).where(F.col("n_votes") >= least)
    version = versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return enough.join(F.broadcast(version)).join(F.broadcast(boosts)).join(F.broadcast(dim_weights(dim_nets(votes), weights)))


def research_queue(feedback: DataFrame, reports: DataFrame, since: Column, least: int = 3) -> DataFrame:
    """Keywords with `least` distinct users or more since a date and no report (topic) yet."""
    return topic_clicks(feedback, since).where(F.col("users") >= least).join(reports.select(F.col("topic").alias("keyword")).distinct(), "keyword", "left_anti")


def feedback_digest(votes: DataFrame, news: DataFrame, top: int = 30) -> DataFrame:
    """The most voted urls with their news."""
    place = F.row_number().over(Window.orderBy(F.desc(F.col("up") + F.col("down")), "news_url"))
    best = votes.orderBy(F.desc(F.col("up") + F.col("down")), "news_url").limit(top)
    return feedback_with_news(best.withColumn("place", place.cast("int")), news)


def priority(questions: DataFrame, as_of: Column, points: int = 2, days: int = 30) -> DataFrame:
    """Points a question (bundle_id, date) of the last `days` days, fading in proportion to age."""
    age = F.datediff(as_of, "date")
    return questions.where((age >= 0) & (age < days)).groupBy("bundle_id").agg((F.sum((points * (days - age)).cast("decimal(18,4)")) / days).cast("decimal(18,4)").alias("priority"))


def click_boost(clicks: DataFrame) -> DataFrame:
    """Half a point a click of a day, two at most."""
    return clicks.groupBy("date", "keyword").agg(F.least(F.lit(20), F.count(F.lit(1)) * 5).alias("tenths")).select("date", "keyword", (F.col("tenths") / 10).cast("decimal(4,1)").alias("boost"))
