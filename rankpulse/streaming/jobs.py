"""Streaming jobs: file ingestion, votes, counters, triggers, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import first_by, stored, upsert_last


def ingest_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, keys: list[str], kind: str = "parquet", order: list[str] | None = None
) -> StreamingQuery:
    """Take up new files of a folder into a table partitioned by date, last wins; a file is read once. Only dates of the batch are rewritten.

    The last row of a key is that of the newest file, and in it the one that order (columns) puts last; files of one time go by name.
    A later batch wins over what the table has. New dates are written beside the table first, so a lost task never reads what it overwrites.
    """
    names = [F.col("_time"), F.col("_file"), *[F.col(c) for c in order or []]]

    def upsert(batch: DataFrame, _: int) -> None:
        dates = batch.select("date").distinct()
        plain = batch.drop("_time", "_file")
        try:
            old = batch.sparkSession.read.schema(plain.schema).parquet(target).join(dates, "date", "left_semi")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = plain.limit(0)
        newest = first_by(batch, keys, *[c.desc_nulls_last() for c in names]).drop("_time", "_file")
        merged = stored(upsert_last(old, newest, keys, []), "ingest")
        merged.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)

    rows = spark.readStream.schema(schema).format(kind).load(source)
    told = rows.withColumn("_time", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_path"))
    return told.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which goes beyond memory, unless the session names another store."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def one_vote(events: DataFrame) -> DataFrame:
    """A stream of (news_url, open_id, feedback_type, ..): one vote a url, user and type, for ever; blank ids all pass.

    A vote is a key of the stream's state without a horizon, so a repeat is dropped however late it comes, also in a later run from the same checkpoint.
    The state is keyed and spread like a shuffle; it grows with the distinct votes, on disk.
    """
    state_on_disk(events.sparkSession)
    blank = (F.coalesce("news_url", F.lit("")) == "") | (F.coalesce("open_id", F.lit("")) == "")
    return events.where(~blank).dropDuplicates(["news_url", "open_id", "feedback_type"]).unionByName(events.where(blank))


def running_counters(votes: DataFrame, key: str = "news_url") -> DataFrame:
    """Counters of each key, for update or complete mode."""
    kind = lambda k, n: F.count_if(F.col("feedback_type") == k).alias(n)
    return votes.groupBy(key).agg(kind("thumbs_up", "n_up"), kind("thumbs_down", "n_down"), kind("hot_click", "n_clicks"))


def windowed_counts(votes: DataFrame, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Votes of each type a window, late ones up to the delay; in append or update mode the watermark drops what is over."""
    return votes.withWatermark("ts", delay).groupBy(F.window("ts", size), "feedback_type").agg(F.count(F.lit(1)).alias("n"))


def users_of(clicks: DataFrame) -> DataFrame:
    """Distinct (keyword, open_id) of clicks; a blank or missing user is none."""
    return clicks.where("open_id <> ''").select("keyword", "open_id").distinct()


def fire_once(users: DataFrame, fired: DataFrame, least: int = 3) -> DataFrame:
    """Keywords of `least` users or more, of distinct (keyword, open_id), that haven't fired."""
    many = users.groupBy("keyword").agg(F.count(F.lit(1)).alias("users")).where(F.col("users") >= least)
    return many.join(fired.select("keyword").distinct(), "keyword", "left_anti")


def threshold_trigger(clicks: DataFrame, state: str, fired: str, checkpoint: str, least: int = 3) -> StreamingQuery:
    """Append keywords to the table `fired` when their users reach the threshold, each once.

    state holds each (keyword, user) once, by the batch that brought it; a batch counts only keywords that it touches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch that runs again writes its own folders anew
        for path, kind in ((state, "keyword string, open_id string"), (fired, "keyword string, users long")):
            spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/batch=-1")
        known, told = (spark.read.parquet(p).where(F.col("batch") < batch_id).drop("batch") for p in (state, fired))
        new = stored(users_of(batch).join(known, ["keyword", "open_id"], "left_anti"), "clicks")
        touched = new.select("keyword").distinct()
        users = known.join(touched, "keyword", "left_semi").unionByName(new)
        fire_once(users, told, least).write.mode("overwrite").parquet(f"{fired}/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return clicks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def parse_payload(col: Column, actions: tuple[str, ...] = ("thumbs_up", "thumbs_down", "hot_click")) -> Column:
    """A callback payload as struct(action, news_url, keyword, target_date): an object, a JSON text or a text within a text; else null."""
    schema = "action string, news_url string, keyword string, target_date string"
    inner = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")
    plain, twice = F.from_json(col, schema), F.from_json(inner, schema)
    out = F.when(plain["action"].isNotNull(), plain).otherwise(twice)
    return F.when(out["action"].isin(*actions), out)
