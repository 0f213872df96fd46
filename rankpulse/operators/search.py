"""Searches through a cache table: it is read first, what it lacks is asked, and answers are taken up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discard, first_by, query_hash, stored

RESULT = ("title", "url", "snippet", "time_str")
CACHE = "query_hash string, query string, engine string, results array<struct<title: string, url: string, snippet: string, time_str: string>>, result_count int, called_by string, cached_at timestamp"


def cached_search(
    requests: DataFrame, cache: DataFrame, search: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], as_of: Column,
    hours: int = 24, called_by: str = "hot_topics",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, the cache's new rows and the queries that were asked, for requests (keyword, date, variant, query).

    The variants of a keyword and date are tried in order until one has results that keep() leaves. A variant takes the freshest row of the
    cache (CACHE) for its query and date, if it is no older than `hours` and not empty; if there is none, or keep() leaves nothing of it, the query goes to search
    (query_hash, query, date), which gives rows (query_hash, engine, title, url, snippet, time_str). What keep() leaves of an answer is a new row of the cache.
    keep gets rows of RESULT with query_hash and date. Results: keyword, date, variant, query_hash, engine, RESULT, cached. All variants
    of one number go together, so a run has as many rounds as there are numbers.
    """
    spark = requests.sparkSession
    asked = requests.withColumn("query_hash", query_hash(F.col("query"), F.col("date")))
    open_ = stored(asked, "search-open")
    fresh = cache.where((F.col("cached_at") <= as_of) & (F.col("cached_at") > as_of - F.expr(f"interval {hours} hours")) & (F.col("result_count") > 0))
    known = first_by(fresh, ["query_hash"], F.desc("cached_at"), "engine").select("query_hash", "engine", "results")
    numbers = [r[0] for r in open_.select("variant").distinct().orderBy("variant").collect()]  # a handful: the forms that a query has
    found, rows, misses = [], [], []
    for number in numbers:
        now = open_.where(F.col("variant") == number).select("keyword", "date", "variant", "query", "query_hash")
        queries = stored(now.select("query_hash", "query", "date").distinct(), "search-queries")
        hits = queries.join(known, "query_hash").select("query_hash", "date", "engine", F.inline("results"))
        hits = stored(keep(hits).select("query_hash", "engine", *RESULT, F.lit(True).alias("cached")), "search-hits")
        missed = stored(queries.join(hits.select("query_hash").distinct(), "query_hash", "left_anti"), "search-missed")
        answers = search(missed).join(missed.select("query_hash", "date"), "query_hash")
        answers = stored(keep(answers.select("query_hash", "date", "engine", *RESULT)).select("query_hash", "engine", *RESULT, F.lit(False).alias("cached")), "search-answers")
        here = stored(now.join(hits.unionByName(answers), "query_hash").select("keyword", "date", "variant", "query_hash", "engine", *RESULT, "cached"), "search-results")
        packed = answers.groupBy("query_hash").agg(F.min("engine").alias("engine"), F.array_sort(F.collect_list(F.struct(*RESULT))).alias("results"))
        rows.append(packed.join(queries.select("query_hash", "query"), "query_hash").select("query_hash", "query", "engine", "results", F.size("results").alias("result_count"), F.lit(called_by).alias("called_by"), as_of.cast("timestamp").alias("cached_at")))
        found.append(here)
        misses.append(missed.withColumn("variant", F.lit(number)))
        left = stored(open_.join(here.select("keyword", "date").distinct(), ["keyword", "date"], "left_anti"), "search-open")
        discard(open_, hits)
        open_ = left
        if not open_.limit(1).count():
            break
    discard(open_)
    none = spark.createDataFrame([], CACHE)
    for r in rows:
        none = none.unionByName(r)
    out, told = found[0] if found else None, misses[0] if misses else None
    for f, m in zip(found[1:], misses[1:], strict=True):
        out, told = out.unionByName(f), told.unionByName(m)
    if out is None:
        out = spark.createDataFrame([], "keyword string, date date, variant int, query_hash string, engine string, title string, url string, snippet string, time_str string, cached boolean")
        told = spark.createDataFrame([], "query_hash string, query string, date date, variant int")
    return out, none.select(*[c.split()[0] for c in ("query_hash", "query", "engine", "results", "result_count", "called_by", "cached_at")]), told


def take_up(rows: DataFrame, path: str) -> None:
    """Append new rows to a cache; the freshest of a query is the one that counts."""
    rows.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at a path, without rows if nothing was taken up yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def compact(cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The freshest row of each query that is still of use."""
    return first_by(cache.where(F.col("cached_at") > as_of - F.expr(f"interval {hours} hours")), ["query_hash"], F.desc("cached_at"), "engine")
