"""Filter interaction audit: what each filter removes in every order of the filters.

A document becomes a mask of the filters that it fails. Masks are counted by part, which leaves at most 2^filters cells a part. A recursive
query then extends prefixes of filters by each unused letter: it joins a part's cells, carries the bits that are applied and emits what the
new step keeps, removes and finds already removed. Orders share their prefixes, so a part costs 325 rows for five filters; they are laid out into
120 orders of 5 steps at the end.

Everything is DataFrame and SQL. Equal texts meet by digest: rows are counted by (digest, part, labels) before that, so that a text with a third
of all rows is a few counted rows. Only cells, not documents, take part in the recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

LETTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_checks(text: Column, w: Column) -> list[Column]:
    """Whether a text fails A, B, C and D; w: its words."""
    n, capitals = F.size(w), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(w)) < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail; bit i of mask is LETTERS[i]."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", words(F.col("text")).alias("w"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_checks(F.col("text"), F.col("w")))), F.lit(0))
    marked = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("bits"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    told = marked.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # a row repeated with its id isn't smaller than itself: the rows of the least id of a text all pass E
    by_id = told.groupBy("doc_id", "digest", "part", "good", "toxic", "bits").agg(F.count(F.lit(1)).alias("c"))
    there = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy("digest", "part", "good", "toxic", "bits").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(~there, F.col("c"))), F.lit(0)).alias("blank"), F.min(F.when(there, F.struct("doc_id", "c"))).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("blank") + F.when(F.col("least.doc_id") == first, F.col("least.c")).otherwise(0)
    copies = 1 << LETTERS.index("E")
    split = by_text.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("bits") + copies).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"),
    ).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


#: {0}: a view (part, cells) with an array of a part's cells. Each level of the recursion is one step of all orders.
STEPS = """
with recursive letters as (select letter, shiftleft(1, i) as bit from (select posexplode(array({letters})) as (i, letter))),
steps (part, prefix, applied, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost) as (
  select part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L from {cells}
  union all
  select s.part, s.prefix || l.letter, s.applied | l.bit, l.bit,
    aggregate(filter(c.cells, x -> x.mask & (s.applied | l.bit) = 0), 0L, (t, x) -> t + x.n),
    aggregate(filter(c.cells, x -> x.mask & l.bit > 0 and x.mask & s.applied = 0), 0L, (t, x) -> t + x.n),
    aggregate(filter(c.cells, x -> x.mask & l.bit > 0 and x.mask & s.applied > 0), 0L, (t, x) -> t + x.n),
    aggregate(filter(c.cells, x -> x.mask = l.bit), 0L, (t, x) -> t + x.n),
    aggregate(filter(c.cells, x -> x.mask & l.bit > 0 and x.mask & s.applied = 0), 0L, (t, x) -> t + x.good),
    aggregate(filter(c.cells, x -> x.mask & l.bit > 0 and x.mask & s.applied = 0), 0L, (t, x) -> t + x.toxic)
  from steps s join {cells} c on c.part = s.part join letters l on s.applied & l.bit = 0
)
select * from steps where bit > 0
"""


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the step's metrics, of every part of cells() and every order of the filters."""
    spark, n = counted.sparkSession, len(LETTERS)
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n cells at most
    unlimited(spark)
    steps = spark.sql(STEPS.format(cells="{cells}", letters=", ".join(f"'{x}'" for x in LETTERS)), cells=packed)
    steps = stored(steps.withColumns({"step": F.length("prefix"), "letter": F.right("prefix", F.lit(1))}), "filter-steps")  # two branches read it
    # a prefix of k letters begins (n - k)! orders
    orders = F.factorial(F.lit(n) - F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    laid = F.filter(F.lit(_orders(LETTERS)), lambda o: F.startswith(o, F.col("prefix")))
    metrics = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return steps.join(shapley, ["part", "letter"]).select("part", F.explode(laid).alias("filter_order"), F.col("step").cast("int").alias("step"), *metrics, "shapley")


def _orders(letters: str) -> list[str]:
    return [a + rest for a in letters for rest in _orders(letters.replace(a, ""))] if letters else [""]


def unlimited(spark: SparkSession) -> None:
    """Let recursive queries give as many rows as they have: 325 for each part, of which there may be many."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters A to E and step, zeros included.

    docs: any columns besides the three named. A null text is empty, a null part is the part of the empty string. Rows are documents: of rows
    that repeat an id with the same text none is a copy of another; a null id is never a copy and makes no copies. labels (doc_id, quality,
    toxic): a document is good, or toxic, if any of its rows says 1. An empty table has no parts and gives no rows.
    """
    return interactions(stored(cells(docs, labels, id_col, text_col, part_col), "filter-cells"))
