"""Topic classes by keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import keyword_match
from ..params import IGNORED_WORDS, TRACK_WORDS


def track_class(text: Column, port: Column | None = None, track=TRACK_WORDS, ignored=IGNORED_WORDS) -> Column:
    """track for ports and followed topics, else ignored, else neutral."""
    hit = keyword_match(text, track)
    if port is not None:
        hit = F.coalesce(port, F.lit(False)) | hit
    return F.when(hit, "track").when(keyword_match(text, ignored), "ignored").otherwise("neutral")


def classify_track(df: DataFrame, columns: tuple[str, ...], port: str | None = None, track=TRACK_WORDS, ignored=IGNORED_WORDS) -> DataFrame:
    """df with track_class over the named text columns together."""
    return df.withColumn("track_class", track_class(F.concat_ws(" ", *columns), F.col(port) if port else None, track, ignored))


def bucket_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("track_class").agg(F.count(F.lit(1)).alias("n"))


def include(classified: DataFrame) -> DataFrame:
    return classified.where("track_class <> 'ignored'")


def filter_track_changes(changes: DataFrame, monitored: DataFrame, track=TRACK_WORDS) -> DataFrame:
    """Changes on followed topics or of a monitored name (column game_name, case ignored); rows without a name are dropped."""
    names = monitored.select(F.lower("game_name").alias("low")).where("low <> ''").distinct().withColumn("watched", F.lit(True))
    rows = changes.where(F.trim("game_name") != "").withColumn("low", F.lower("game_name")).join(names, "low", "left").drop("low")
    hit = track_class(F.concat_ws(" ", "game_name", "category", "developer"), track=track) == "track"
    return rows.where(F.coalesce("watched", F.lit(False)) | hit).drop("watched")
