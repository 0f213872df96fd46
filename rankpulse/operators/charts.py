"""Chart snapshots: differences between days, attention, day classes, histories, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyword_match
from ..params import TRACK_WORDS

KEY = ["platform", "chart_type", "bundle_id"]


def prev_date(rankings: DataFrame) -> DataFrame:
    """date, prev_date: the latest earlier date over all charts. The window runs over distinct dates."""
    return rankings.select("date").distinct().withColumn("prev_date", F.lag("date").over(Window.orderBy("date")))


def diff_snapshots(rankings: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Each date's charts against the previous date: one row a game of either day; charts that are missing today give none.

    Ranks below 1 are left out unless keep_zero. The first date gives no rows. Besides the distinct dates the charts are read and shuffled once: each row goes to its own
    date and to the next one, and both sides of a game meet there. A game stands once in a chart and day.
    """
    rows = rankings if keep_zero else rankings.where("rank >= 1")
    days = prev_date(rows)
    following = days.select(F.col("prev_date").alias("date"), F.col("date").alias("next_date")).where("date is not null")
    known = days.join(following, "date", "left").select(F.col("date").alias("_d"), F.when(F.col("prev_date").isNotNull(), F.col("date")).alias("_own"), F.col("next_date").alias("_next"))  # a row a date
    side = F.struct("rank", "game_name", "developer", "category").alias("side")
    each = rows.join(F.broadcast(known), rows["date"] == F.col("_d")).select(*KEY, side, F.explode(F.array(F.struct(F.col("_own").alias("date"), F.lit(True).alias("now")), F.struct(F.col("_next").alias("date"), F.lit(False).alias("now")))).alias("x"))
    dealt = each.select("x.date", "x.now", *KEY, "side").where("date is not null").repartition("date", "platform", "chart_type")
    both = dealt.groupBy("date", *KEY).agg(F.max(F.when(F.col("now"), F.col("side"))).alias("t"), F.max(F.when(~F.col("now"), F.col("side"))).alias("y"))
    here = F.max(F.col("t").isNotNull()).over(Window.partitionBy("date", "platform", "chart_type"))
    both = both.withColumn("_here", here).where("_here").withColumns({"today_rank": F.col("t.rank"), "yesterday_rank": F.col("y.rank")})
    change = F.col("yesterday_rank") - F.col("today_rank")
    kind = (
        F.when(F.col("yesterday_rank").isNull(), "new_entry").when(F.col("today_rank").isNull(), "dropped_out")
        .when(change > 0, "up").when(change < 0, "down").otherwise("stable")
    )
    named = F.coalesce("t", "y")
    return both.select("date", *KEY, named["game_name"].alias("game_name"), named["developer"].alias("developer"), named["category"].alias("category"), "today_rank", "yesterday_rank", change.alias("rank_change"), kind.alias("change_type"))


def attention_tenths(track: Column | None = None) -> Column:
    """Attention in tenths, 0..100, of a change row. track: whether a row is on a followed topic; drop-outs get no bonus."""
    rank = F.coalesce("today_rank", "yesterday_rank", F.lit(99))
    before, delta = F.coalesce(F.nullif(F.col("yesterday_rank"), F.lit(0)), F.lit(99)), F.abs(F.coalesce("rank_change", F.lit(0)))
    kind = F.col("change_type")
    band = F.when(rank <= 3, 50).when(rank <= 5, 35).when(rank <= 10, 20).when(rank <= 30, 10).when(rank <= 50, 5).otherwise(2)
    entry = F.when(rank <= 10, 50).when(rank <= 50, 35).otherwise(20)
    drop = F.when(before <= 10, 40).when(before <= 30, 20).otherwise(5)
    near = F.when((rank <= 5) & (delta >= 1), 15).when((rank <= 10) & (delta >= 3), 10).otherwise(0)
    far = F.when(delta >= 20, 35).when(delta >= 10, 20).when(delta >= 5, 10).otherwise(3)
    climb = F.when((before > 30) & (delta >= 10), 20).otherwise(0) + F.when((before > 50) & (delta >= 5), 10).otherwise(0)
    move = near + far + F.when(kind == "up", climb).otherwise(0)
    points = band + F.when(kind == "new_entry", entry).when(kind == "dropped_out", drop).when(kind.isin("up", "down"), move).otherwise(0)
    if track is not None:
        points = points + F.when(track & (kind != "dropped_out"), 15).otherwise(0)
    return F.least(points, F.lit(100))


def is_significant(tenths: Column) -> Column:
    """Attention of 5 or more, or an entry into the top 50, or a move within the top 5."""
    kind, today = F.col("change_type"), F.coalesce("today_rank", F.lit(999))
    return (tenths >= 50) | (kind.isin("new_entry", "dropped_out") & (today <= 50)) | (kind.isin("up", "down") & (today <= 5))


def diff(rankings: DataFrame, track_words: tuple[str, ...] = TRACK_WORDS) -> DataFrame:
    """diff_snapshots() of every date with attention_score decimal(4,1) and is_significant."""
    track = keyword_match(F.concat_ws(" ", "game_name", "category", "developer"), track_words)
    changes = diff_snapshots(rankings).withColumn("tenths", attention_tenths(track))
    return changes.withColumn("attention_score", (F.col("tenths") / 10).cast("decimal(4,1)")).withColumn("is_significant", is_significant(F.col("tenths"))).drop("tenths")


def _big() -> Column:
    return (F.abs(F.coalesce("rank_change", F.lit(0))) >= 15) | ((F.col("change_type") == "dropped_out") & (F.col("yesterday_rank") <= 30))


def overview(changes: DataFrame) -> DataFrame:
    """Counts by date and chart, and by date (platform and chart_type null), in one pass. total: games of today."""
    kind = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    counts = [F.count_if(F.col("change_type") != "dropped_out").alias("total"), *map(kind, ("up", "down", "new_entry", "dropped_out", "stable")), F.count_if(_big()).alias("big_moves")]
    sets = changes.groupingSets([["date", "platform", "chart_type"], ["date"]], "date", "platform", "chart_type")
    return sets.agg(*counts)


def classify_day(counts: DataFrame) -> DataFrame:
    """day_class of rows with total, up, down, new_entry, dropped_out, big_moves."""
    moved, inout = F.col("up") + F.col("down") + F.col("new_entry") + F.col("dropped_out"), F.col("new_entry") + F.col("dropped_out")
    quiet = (moved * 10 <= F.col("total")) & (inout <= 2) & (F.col("big_moves") == 0)
    wild = (moved * 10 >= F.col("total") * 3) | (inout >= 8) | (F.col("big_moves") >= 5)
    return counts.withColumn("day_class", F.when(F.col("total") == 0, "quiet").when(quiet, "quiet").when(wild, "volatile").otherwise("normal"))


def classify_days(rankings: DataFrame) -> DataFrame:
    """date, day_class with counts for each date; the first date is first_day."""
    days = classify_day(overview(diff_snapshots(rankings)).where("platform is null").drop("platform", "chart_type"))
    out = prev_date(rankings).join(days, "date", "left")
    return out.select("date", F.when(F.col("prev_date").isNull(), "first_day").otherwise(F.coalesce("day_class", F.lit("quiet"))).alias("day_class"), "total", "up", "down", "new_entry", "dropped_out", "big_moves")


def classify_day_report(changes: DataFrame) -> DataFrame:
    """The report's day class: big moves count by rank change alone."""
    kind = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    big = F.count_if(F.abs(F.coalesce("rank_change", F.lit(0))) >= 15).alias("big_moves")
    return classify_day(changes.groupBy("date").agg(F.count_if(F.col("change_type") != "dropped_out").alias("total"), *map(kind, ("up", "down", "new_entry", "dropped_out")), big))


def available_dates(rankings: DataFrame) -> DataFrame:
    return rankings.select("date").distinct()


def available_charts(rankings: DataFrame) -> DataFrame:
    """Charts with their first and last date."""
    return rankings.groupBy("platform", "chart_type").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("n_dates"))


def history(rankings: DataFrame, n: int = 30, keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """The last n dates of each game, numbered in order."""
    last = Window.partitionBy(*keys).orderBy(F.desc("date"))
    rows = rankings.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("date")).cast("int")).select(*keys, "date", "rank", "seq")


def rising_streak(rankings: DataFrame, min_days: int = 5, window: int = 30) -> DataFrame:
    """For every game and date the run of strict improvements that ends there, counted in observations, if min_days or longer.

    Gaps and islands: an observation that doesn't improve on the last one starts an island.
    """
    order = Window.partitionBy(*KEY).orderBy("date")
    rows = rankings.where("rank >= 1").withColumn("prior", F.lag("rank").over(order)).withColumn("starts", F.when(F.col("rank") < F.col("prior"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*KEY, "island").orderBy("date")
    run = island.rowsBetween(-(window - 1), 0)
    rows = rows.withColumn("streak", F.count(F.lit(1)).over(run)).withColumn("start_rank", F.first("rank").over(run)).withColumn("end_rank", F.col("rank"))
    return rows.where(F.col("streak") >= min_days).select("date", *KEY, "game_name", "start_rank", "end_rank", F.col("streak").cast("int").alias("streak"))


def latest_summary(rankings: DataFrame) -> DataFrame:
    """Dates, class and counts of the latest date."""
    days = classify_days(rankings).join(prev_date(rankings), "date")
    return days.join(F.broadcast(rankings.agg(F.max("date").alias("date"))), "date", "left_semi")


def with_category(changes: DataFrame, rankings: DataFrame) -> DataFrame:
    """Changes with the category that the chart of the day, else of the day before, gives the game."""
    dates = prev_date(rankings).where("prev_date is not null")
    cat = lambda df, name: df.select("date", *KEY, F.col("category").alias(name))
    before = rankings.withColumnRenamed("date", "prev_date").join(F.broadcast(dates), "prev_date")
    out = changes.drop("category").join(cat(rankings, "now"), ["date", *KEY], "left").join(cat(before, "then"), ["date", *KEY], "left")
    return out.withColumn("category", F.coalesce("now", "then", F.lit(""))).drop("now", "then")


def cross_chart(changes: DataFrame, lead: int = 10) -> DataFrame:
    """Games in two charts or more a day: how far their ranks lie apart, and whether one chart leads by `lead` places or more."""
    rows = changes.where("today_rank is not null").groupBy("date", "platform", "bundle_id").agg(
        F.count(F.lit(1)).alias("n_charts"), F.min("today_rank").alias("best_rank"), F.max("today_rank").alias("worst_rank"),
        F.count_if(F.col("rank_change") > 0).alias("n_up"), F.count_if(F.col("rank_change") < 0).alias("n_down"),
    ).where("n_charts >= 2")
    signal = F.when((F.col("n_up") > 0) & (F.col("n_down") > 0), "divergence").when(F.col("worst_rank") - F.col("best_rank") >= lead, "leading").when(F.col("n_up") == F.col("n_charts"), "harvest").otherwise("none")
    return rows.withColumn("signal", signal)


def cross_chart_signals(changes: DataFrame, free: str, grossing: str, hot: str, least: int = 1) -> DataFrame:
    """Games in two of three charts or more a day and platform: rank and move in each, and a signal. A move of `least` places counts.

    divergence: up in one and down in another; leading: up in all three; traffic_leak: up in the free chart, not up in the grossing one;
    harvest: up in the grossing chart alone; word_of_mouth: up in the hot chart alone; else none. Divergence and leading come first.
    """
    names = {"free": free, "grossing": grossing, "hot": hot}
    rows = changes.where(F.col("chart_type").isin(*names.values()) & F.col("today_rank").isNotNull())
    role = F.lit(None).cast("string")
    for k, v in names.items():
        role = F.when(F.col("chart_type") == v, k).otherwise(role)
    wide = rows.withColumn("role", role).groupBy("date", "platform", "bundle_id").pivot("role", list(names)).agg(F.min("today_rank").alias("rank"), F.max("rank_change").alias("move"))
    wide = wide.where(sum(F.col(f"{k}_rank").isNotNull().cast("int") for k in names) >= 2)
    up = {k: F.coalesce(F.col(f"{k}_move") >= least, F.lit(False)) for k in names}
    down = [F.coalesce(F.col(f"{k}_move") <= -least, F.lit(False)) for k in names]
    signal = (
        F.when((up["free"] | up["grossing"] | up["hot"]) & (down[0] | down[1] | down[2]), "divergence").when(up["free"] & up["grossing"] & up["hot"], "leading")
        .when(up["free"] & ~up["grossing"] & F.col("grossing_rank").isNotNull(), "traffic_leak").when(up["grossing"] & ~up["free"] & F.col("free_rank").isNotNull(), "harvest")
        .when(up["hot"] & ~up["free"] & F.col("free_rank").isNotNull(), "word_of_mouth").otherwise("none")
    )
    return wide.withColumn("signal", signal)


def volatility(days: DataFrame) -> DataFrame:
    """Share of moved games a day, and its mean over the seven dates before."""
    v = days.withColumn("volatility", F.when(F.col("total") > 0, (F.col("up") + F.col("down") + F.col("new_entry") + F.col("dropped_out")).cast("double") / F.col("total")))
    return v.select("date", F.round("volatility", 4).alias("volatility"), F.round(F.avg("volatility").over(Window.orderBy("date").rowsBetween(-7, -1)), 4).alias("week_mean"))
