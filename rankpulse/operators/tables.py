"""Table mutations as set operations: upserts, inserts, refreshes, caches. Each gives the new table; writing it is the caller's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The folder of the workspace that is open, if any.
_WORKSPACE: ContextVar[str | None] = ContextVar("workspace", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Within it all work folders lie in one, which is deleted at its end, also after an error. Results that are lazy must be written before.

    Outside of a workspace the tables that a lazy result reads stay in the shared folder; what an operator has read for the last time, it deletes.
    """
    path = work_dir(spark, "workspace")
    token = _WORKSPACE.set(path)
    try:
        yield path
    finally:
        _WORKSPACE.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder in the open workspace, else under spark.checkpoint.dir, which driver and executors share. Only a local session may lack that
    setting: then it gets a temporary folder; a cluster without it is an error, as its executors would not see each other's files."""
    base = _WORKSPACE.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankpulse-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a fresh work folder and read back: lineage is cut and a lost executor costs nothing. stored_at is its path; discard() deletes it."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row; a filter on one of withColumn would work it out a second time."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(df: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1. A group is cut into ranges of the order, each numbered on its own and moved by
    the sizes of those before it, so that no task holds a whole group."""
    cut = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    met = own.join(moved, [*same, F.col("_range") == F.col("_of")])
    return met.select(*[F.col(c) for c in df.columns], (F.col("_own") + F.col("_before")).cast("int").alias(name))


def falling(column: str) -> Column:
    """A number's place in a falling order, for best_of; nulls come last."""
    return F.struct(F.col(column).isNull(), -F.col(column))


def best_of(df: DataFrame, by: list[str], order: list, limit: Column, name: str = "place") -> DataFrame:
    """The first rows of each group by rising order with their place, from 1; how many is an expression that is the same for all rows of a group.

    A group is dealt by a hash of the order to as many parts as a shuffle has, and each part keeps its own first rows. Those of all parts, no more than the
    limit times the parts, are merged by an aggregate as a sorted, cut array. So no task sees a whole group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)])
    dealt = df.withColumns({"_key": key, "_limit": limit.cast("int")}).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)))
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key"))).where("_n <= _limit")
    row = F.struct("_key", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    merged = own.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("_limit").alias("_limit"))
    best = merged.select(F.posexplode(F.slice("_rows", F.lit(1), F.greatest(F.lit(0), F.col("_limit")))).alias("_at", "_r"))
    return best.select("_r._row.*", (F.col("_at") + 1).cast("int").alias(name))


def write_scannable(table: DataFrame, path: str, by: str = "date", order: tuple[str, ...] = (), blooms: tuple[str, ...] = ()) -> None:
    """table in folders of `by`, each in order, with bloom filters of some columns: a layout that scan() reads in part.

    An equality on `by` leaves other folders unread; ranges of the first column of the order leave row groups unread by their statistics, and
    equalities on the blooms columns by their filters. Rows of a folder are dealt to files in ranges of the order, so a large date has many files.
    """
    laid = table.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    out = laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    for c in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    out.parquet(path)


def scan(table: DataFrame, order: list | None = None, most: int | None = None, **equal) -> DataFrame:
    """Rows whose columns have the given values (None: any), in order, `most` of them. Equalities on a partition column prune files."""
    for column, value in equal.items():
        if value is not None:
            table = table.where(F.col(column) == (value if isinstance(value, Column) else F.lit(value)))
    table = table.orderBy(*order) if order else table
    return table if most is None else table.limit(most)


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones of their key; of new rows with one key the last by order stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, F.desc("_new"), *[F.desc(c) for c in order]).drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that an insert adds: keys that old lacks, the first by order of each."""
    return first_by(new.join(old.select(*keys), keys, "left_anti"), keys, *order)


def insert_news_deduped(old: DataFrame, new: DataFrame, date: Column, order: list[str]) -> DataFrame:
    """News to add: without empty or known (date, url), the last of each; a missing date is filled."""
    rows = new.withColumn("date", F.coalesce("date", date)).where("url <> ''").join(old.select("date", "url"), ["date", "url"], "left_anti")
    return first_by(rows, ["date", "url"], *[F.desc(c) for c in order])


def refresh_keeping(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """New rows with the kept counters of old rows that come back, else 0."""
    counters = old.groupBy(*keys).agg(*[F.max(c).alias(c) for c in keep])
    return new.drop(*keep).join(counters, keys, "left").fillna(0, keep)


def new_files(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files whose date the table lacks."""
    return files.join(table.select("date").distinct(), "date", "left_anti")


def source_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source table and date."""
    out = None
    for name, df in tables.items():
        counted = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source_table"), "date", "n")
        out = counted if out is None else out.union(counted)
    return out


def query_hash(query: Column, date: Column) -> Column:
    """The key of a cached search: md5(query|date)."""
    return F.md5(F.concat_ws("|", query, date.cast("string")))


def ttl_lookup(requests: DataFrame, cache: DataFrame, hours: int, as_of: Column) -> DataFrame:
    """Requests (query, date) with the freshest cached result within `hours`, if any. The key is md5(query|date)."""
    asked = requests.withColumn("query_hash", query_hash(F.col("query"), F.col("date")))
    fresh = cache.where((F.col("cached_at") <= as_of) & (F.col("cached_at") > as_of - F.expr(f"interval {hours} hours")))
    return asked.join(first_by(fresh, ["query_hash"], F.desc("cached_at"), "result"), "query_hash", "left")


def prune(table: DataFrame, as_of: Column, days: int, column: str = "date") -> DataFrame:
    return table.where(F.datediff(as_of, F.col(column)) <= days)


REPORTED = ["item_key", "item_type", "reported_date", "meta"]


def mark_reported(table: DataFrame, keys: DataFrame, item_type: str, date: Column, meta: str = "") -> DataFrame:
    """The table (REPORTED) with the keys (item_key) of a type as reported on a date; a key that it has gets the new date."""
    new = keys.select("item_key", F.lit(item_type).alias("item_type"), date.alias("reported_date"), F.lit(meta).alias("meta")).distinct()
    return table.select(*REPORTED).join(new, ["item_key", "item_type"], "left_anti").select(*REPORTED).unionByName(new)


def prune_reported(table: DataFrame, as_of: Column, days: dict[str, int]) -> DataFrame:
    """The table without rows over the age of their type; types without an age stay."""
    age, limit = F.datediff(as_of, "reported_date"), F.lit(None).cast("int")
    for kind, n in days.items():
        limit = F.when(F.col("item_type") == kind, n).otherwise(limit)
    return table.where(limit.isNull() | (age <= limit))


def mark_applied(versions: DataFrame, version: Column) -> DataFrame:
    """Parameter versions with applied true for the given one; others keep theirs."""
    return versions.withColumn("applied", (F.col("version") == version) | F.coalesce("applied", F.lit(False)))


def append_runs(runs: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """runs and the new rows with the ids after the greatest. new is a few rows: those of one run."""
    top = runs.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered_ = new.withColumn("_n", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(top))
    return runs.unionByName(numbered_.withColumn(id_col, (F.col("_top") + F.col("_n")).cast(runs.schema[id_col].dataType)).select(*runs.columns))


def write_back(table: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The table with new values of some columns where values has the key."""
    got = values.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(got, keys, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def set_flag(table: DataFrame, chosen: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The flag true for the chosen keys and false for all others."""
    return table.drop(flag).join(chosen.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").fillna(False, [flag])


def counters(votes: DataFrame) -> DataFrame:
    """Vote counters of each url, derived from the rows."""
    kind = lambda k, n: F.count_if(F.col("feedback_type") == k).alias(n)
    return votes.groupBy("news_url").agg(kind("thumbs_up", "n_up"), kind("thumbs_down", "n_down"), kind("hot_click", "n_clicks"))


def overwrite_dates(table: DataFrame, path: str, column: str = "date") -> None:
    """Write the table's dates over those under path and leave others alone; a forced run of a date does the same."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
