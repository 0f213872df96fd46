"""Story rules over change rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import STORY_BASE
from .charts import rising_streak
from .tables import stored

COLUMNS = ["date", "story_type", "platform", "chart_type", "bundle_id", "headline", "attention_score"]


def _story(rows: DataFrame, kind: str, headline: str) -> DataFrame:
    return rows.select("date", F.lit(kind).alias("story_type"), "platform", "chart_type", "bundle_id", F.expr(headline).alias("headline"), F.col("attention_score").cast("decimal(4,1)").alias("attention_score"))


def detect_big_jumps(changes: DataFrame, least: int = 15) -> DataFrame:
    return _story(changes.where((F.col("change_type") == "up") & (F.col("rank_change") >= least)), "big_jump", "concat(game_name, ' +', rank_change)")


def detect_black_horses(changes: DataFrame, top: int = 50) -> DataFrame:
    return _story(changes.where((F.col("change_type") == "new_entry") & (F.col("today_rank") <= top)), "black_horse", "concat(game_name, ' #', today_rank)")


def detect_cliff_drops(changes: DataFrame, least: int = 20, top: int = 30) -> DataFrame:
    fell = (F.col("change_type") == "down") & (F.col("rank_change") <= -least)
    gone = (F.col("change_type") == "dropped_out") & (F.col("yesterday_rank") <= top)
    return _story(changes.where(fell | gone), "cliff_drop", "concat(game_name, ' -', coalesce(cast(-rank_change as string), 'out'))")


def detect_steady_climbers(changes: DataFrame, rankings: DataFrame, min_days: int = 5) -> DataFrame:
    """Games up today whose run of improvements is min_days observations or longer."""
    streaks = rising_streak(rankings, min_days).select("date", "platform", "chart_type", "bundle_id", "streak", "start_rank")
    return _story(changes.where("change_type = 'up'").join(streaks, ["date", "platform", "chart_type", "bundle_id"]), "steady_climber", "concat(game_name, ' ', streak, 'd from #', start_rank)")


def detect_cluster_moves(changes: DataFrame, least: int = 3) -> DataFrame:
    """`least` games or more of one category or developer that move the same way on a day; unknown ones don't count."""
    moved = changes.where("change_type in ('up', 'down')")

    def by(column: str) -> DataFrame:
        known = moved.where(F.col(column).isNotNull() & (F.col(column) != "") & (F.col(column) != "unknown"))
        groups = known.groupBy("date", F.col(column).alias("member"), "change_type").agg(F.countDistinct("bundle_id").alias("n")).where(F.col("n") >= least)
        return groups.select("date", F.concat(F.lit(f"{column}: "), "member", F.lit(" "), "change_type", F.lit(" "), F.col("n").cast("string")).alias("headline"))

    both = by("category").union(by("developer"))
    empty = F.lit("")
    return both.select("date", F.lit("cluster_move").alias("story_type"), empty.alias("platform"), empty.alias("chart_type"), empty.alias("bundle_id"), "headline", F.lit(0).cast("decimal(4,1)").alias("attention_score"))


def with_priority(stories: DataFrame) -> DataFrame:
    """priority decimal(6,2): base of the type plus a tenth of the attention."""
    base = F.lit(0)
    for kind, points in STORY_BASE.items():
        base = F.when(F.col("story_type") == kind, points).otherwise(base)
    return stories.withColumn("priority", (base + F.col("attention_score") / 10).cast("decimal(6,2)"))


def dedup_stories(stories: DataFrame) -> DataFrame:
    """One story a date, type and game (headline where there is no game): the one of highest priority, then by chart."""
    key = F.when(F.col("bundle_id") != "", F.col("bundle_id")).otherwise(F.col("headline"))
    order = Window.partitionBy("date", "story_type", "key").orderBy(F.desc("priority"), "platform", "chart_type", "bundle_id", "headline")
    return stories.withColumn("key", key).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "key")


def pick_stories(changes: DataFrame, rankings: DataFrame, top: int = 8) -> DataFrame:
    """The `top` stories of each date. The changes are written once for the five rules that read them."""
    changes = stored(changes, "story-changes")
    found = [detect_big_jumps(changes), detect_black_horses(changes), detect_cliff_drops(changes), detect_steady_climbers(changes, rankings), detect_cluster_moves(changes)]
    stories = found[0]
    for f in found[1:]:
        stories = stories.unionByName(f)
    order = Window.partitionBy("date").orderBy(F.desc("priority"), "story_type", "platform", "chart_type", "bundle_id", "headline")
    return dedup_stories(with_priority(stories)).withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= top).select(*COLUMNS, "priority", "place")
