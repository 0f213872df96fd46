"""A changed chart date and what hangs on it: its changes, those of the next date, and the stories of dates whose changes or streaks are others now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import TRACK_WORDS
from . import charts, stories
from .tables import discard, overwrite_dates, stored

#: Folders below the root, each partitioned by date.
RANKINGS, CHANGES, STORIES = "rankings", "changes", "stories"


def build(rankings: DataFrame, root: str, track_words: tuple[str, ...] = TRACK_WORDS) -> None:
    """All three tables of all dates."""
    overwrite_dates(rankings, f"{root}/{RANKINGS}")
    charts_ = rankings.sparkSession.read.parquet(f"{root}/{RANKINGS}")
    changes = charts.diff(charts_, track_words)
    overwrite_dates(changes, f"{root}/{CHANGES}")
    overwrite_dates(stories.pick_stories(rankings.sparkSession.read.parquet(f"{root}/{CHANGES}"), charts_), f"{root}/{STORIES}")


def affected(before: DataFrame, after: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dates whose changes, and dates whose stories must be made anew when the charts of `dates` (date) become those of after.

    A date's changes hang on its own charts and those of the date before. Its stories hang on its changes and on the runs of improvements that
    end on it; runs may reach over many dates, so those of the games in question are compared.
    """
    known = before.select("date").union(after.select("date")).distinct()
    following = charts.prev_date(known).join(dates.withColumnRenamed("date", "prev_date"), "prev_date", "left_semi").select("date")
    # a date that goes, or comes, lies before the next one of either state
    nexts = [charts.prev_date(s).join(known.join(dates, "date", "left_semi").withColumnRenamed("date", "prev_date"), "prev_date", "left_semi").select("date") for s in (before, after)]
    changed = dates.union(following).union(nexts[0]).union(nexts[1]).distinct()
    games = before.join(dates, "date", "left_semi").select(*charts.KEY).union(after.join(dates, "date", "left_semi").select(*charts.KEY)).distinct()
    runs = [charts.rising_streak(s.join(games, charts.KEY, "left_semi")).select("date", *charts.KEY, "streak", "start_rank") for s in (before, after)]
    other = runs[0].exceptAll(runs[1]).union(runs[1].exceptAll(runs[0])).select("date")
    return changed, changed.union(other).distinct()


def recompute(spark: SparkSession, root: str, new: DataFrame, dates: DataFrame, track_words: tuple[str, ...] = TRACK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Put new (rows of rankings) in the place of the charts of dates (date) under root, and remake what hangs on them. Gives the dates of changes and of stories.

    A date that new lacks goes. Rows without a platform, which other files brought in, are dropped. Folders of other dates aren't touched. The
    charts are written last, so that a run which fails can be run again as it was.
    """
    before = spark.read.parquet(f"{root}/{RANKINGS}")
    columns = before.columns
    new = stored(new.join(F.broadcast(dates), "date", "left_semi").where("platform <> ''").select(*columns), "recompute-new")
    after = before.join(F.broadcast(dates), "date", "left_anti").select(*columns).unionByName(new)
    changed, told = (stored(d, "recompute-dates") for d in affected(before, after, dates))
    # the changed dates and the one before each are enough for their changes
    days = charts.prev_date(after)
    needed = days.join(changed, "date", "left_semi").select("date").union(days.join(changed, "date", "left_semi").select("prev_date")).where("date is not null").distinct()
    changes = charts.diff(after.join(F.broadcast(needed), "date", "left_semi"), track_words).join(F.broadcast(changed), "date", "left_semi")
    changes = stored(changes, "recompute-changes")
    kept = spark.read.schema(changes.schema).parquet(f"{root}/{CHANGES}").join(F.broadcast(told), "date", "left_semi").join(F.broadcast(changed), "date", "left_anti")
    picked = stored(stories.pick_stories(kept.select(*changes.columns).unionByName(changes), after), "recompute-stories")
    replace_dates(picked, f"{root}/{STORIES}", told)
    replace_dates(changes, f"{root}/{CHANGES}", changed)
    replace_dates(new, f"{root}/{RANKINGS}", dates)
    discard(new, changes, picked)
    return changed, told


def replace_dates(rows: DataFrame, path: str, dates: DataFrame) -> None:
    """Write the rows over the folders of their dates; those of dates without rows are deleted."""
    overwrite_dates(rows, path)
    spark = rows.sparkSession
    empty = dates.join(rows.select("date").distinct(), "date", "left_anti").select(F.col("date").cast("string")).collect()  # dates alone
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for (day,) in empty:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"date={day}"), True)


def forget_reported(reported: DataFrame, date, types: tuple[str, ...] = ("news", "news_h")) -> DataFrame:
    """Reported items without those that a date marked, so that a run of it again isn't blocked by its first one."""
    return reported.where(~(F.col("item_type").isin(*types) & (F.col("reported_date") == date)))
