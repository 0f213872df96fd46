"""Hot topics: keyword merge and choice, result filters, replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalars as S
from .tables import best_of, falling, first_by, numbered, once, stored


def hot_list_rows(raw: DataFrame, top: int = 30, relevant=P.RELEVANT_WORDS, discussions: tuple[str, ...] = ("zhihu",)) -> DataFrame:
    """raw (date, source, title, url, place): the first `top` of a source, titles of two characters or more, relevant, as keywords.

    rank is the place. Sources of discussions give questions alone, by URL, question mark or question word, articles by URL go; there a
    keyword is compact, stands once a date, and rank counts those that are left.
    """
    title, url = F.trim("title"), F.lower(F.coalesce("url", F.lit("")))
    talk = F.col("source").isin(*discussions)
    asked = S.contains_any(url, P.QUESTION_URLS) | title.rlike("[?？]$") | S.contains_any(title, P.QUESTION_WORDS)
    fine = F.when(talk, asked | ~S.contains_any(url, P.ARTICLE_URLS)).otherwise(F.lit(True))
    rows = raw.where((F.col("place") <= top) & (F.length(title) >= 2) & S.is_relevant(title, relevant) & fine)
    keyword = F.when(talk, S.normalize_keyword(S.clean_discussion(title))).otherwise(S.normalize_keyword(title))
    rows = rows.select("date", "source", keyword.alias("keyword"), F.col("place").cast("int").alias("rank"), "url")
    told = first_by(rows.where(talk & (F.col("keyword") != "") & S.is_compact(F.col("keyword"), F.col("source"))), ["date", "source", "keyword"], "rank", "url")
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("date", "source").orderBy("rank", "url")).cast("int"))
    return rows.where(~talk).unionByName(told)


def merge_keywords(rows: DataFrame) -> DataFrame:
    """One row a date and keyword, the one of best rank; long pseudo-keywords go."""
    fine = rows.where(S.is_compact(F.col("keyword"), F.col("source")))
    return first_by(fine, ["date", "keyword"], "rank", "source")


def weigh_keywords(rows: DataFrame, clicks: DataFrame) -> DataFrame:
    """rows with weight decimal(10,2) by rank and clicks (keyword, clicks)."""
    return rows.join(clicks, "keyword", "left").withColumn("weight", S.keyword_weight(F.col("rank"), F.col("clicks")).cast("decimal(10,2)"))


def pick_keywords(rows: DataFrame, plain: int = 7, total: int = 10) -> DataFrame:
    """Per date up to `plain` keywords that aren't curated by weight, then curated ones, then the rest; `total` in all.

    More than `total` of either kind are never needed, so Spark cuts both to it before they are shuffled.
    """
    curated = F.col("source") == "curated"
    place = F.row_number().over(Window.partitionBy("date", curated).orderBy(F.desc("weight"), "keyword"))
    kind = F.when(curated, 1).when(F.col("_place") <= plain, 0).otherwise(2)
    rows = rows.withColumn("_place", place).where(F.col("_place") <= max(plain, total)).withColumn("kind", kind).drop("_place")
    slot = F.row_number().over(Window.partitionBy("date").orderBy("kind", F.desc("weight"), "keyword")).cast("int")
    return rows.withColumn("slot", slot).where(F.col("slot") <= total).drop("kind")


def first_engine(results: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Results of the first engine of the order that has any, for each keyword and query."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    rows = results.withColumn("place", place).where("place > 0")
    best = rows.groupBy(F.col("keyword").alias("_k"), F.col("query").alias("_q")).agg(F.min("place").alias("best"))
    met = rows.join(best, F.col("keyword").eqNullSafe(F.col("_k")) & F.col("query").eqNullSafe(F.col("_q")) & (F.col("place") == F.col("best")))
    return met.select(*results.columns)


def first_variant(results: DataFrame) -> DataFrame:
    """Kept results (date, keyword, variant) of the first variant of the query that has any, for each date and keyword."""
    best = results.groupBy("date", "keyword").agg(F.min("variant").alias("variant"))
    return results.join(best, ["date", "keyword", "variant"], "left_semi")


def filter_by_age(results: DataFrame, as_of: Column, most: int = 7) -> DataFrame:
    """results (title, snippet, time_str) up to `most` days old: by a date in the title, then the time field, bracketed and relative words."""
    title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    bracket = lambda c: F.regexp_extract(c, r"\(([^)]+)\)", 1)
    relative = r"[0-9]+\s*(小时前|天前)|昨天|前天"
    said = F.coalesce(
        S.age_days(F.coalesce("time_str", F.lit("")), as_of), S.age_days(bracket(title), as_of), S.age_days(bracket(snippet), as_of),
        F.when(title.rlike(relative), S.age_days(title, as_of)), F.when(snippet.rlike(relative), S.age_days(snippet, as_of)),
    )
    stale = F.coalesce(S.title_age_days(title, as_of) > most, F.lit(False)) | F.coalesce(said > most, F.lit(False))
    return results.where(~stale)


def rule_hot_topics(results: DataFrame, score: Column, least: int = 4, top: int = 7) -> DataFrame:
    """Distinct URLs of score `least` or more, the `top` of each date."""
    rows = first_by(once(results, "score", score).where(F.col("score") >= least), ["date", "url"], F.desc("score"), "title")
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "url")).cast("int")).where(F.col("slot") <= top)


def local_candidates(news: DataFrame, score: Column, relevant: Column, top: int = 20, fallback: int = 7) -> DataFrame:
    """Articles for days without results: the `top` relevant ones by score, else the `fallback` best."""
    rows = news.withColumn("score", score).where("score > 0").withColumn("relevant", relevant)
    has = rows.groupBy("date").agg(F.max("relevant").alias("any"))
    rows = rows.join(has, "date").where(F.col("relevant") | ~F.col("any"))
    limit = F.when(F.col("any"), top).otherwise(fallback)
    return best_of(rows, ["date"], [falling("score"), "url"], limit, "slot").drop("any", "relevant")


def dedup_against(selected: DataFrame, pool: DataFrame, news: DataFrame) -> DataFrame:
    """selected (date, url, title) without what news (date, url, headline) of the day has by URL or token; pool rows fill up to the old count.

    The pool goes by its column place and gives only rows that news lacks as well.
    """
    urls = news.select("date", S.url_canonical(F.col("url")).alias("key")).distinct()
    tokens = news.select("date", F.explode(S.dedup_tokens(F.col("headline"))).alias("token")).distinct()

    def fresh(df: DataFrame) -> DataFrame:
        hit = df.select("date", "url", F.explode(S.dedup_tokens(F.col("title"))).alias("token")).join(tokens, ["date", "token"], "left_semi").select("date", "url").distinct()
        return df.withColumn("key", S.url_canonical(F.col("url"))).join(urls, ["date", "key"], "left_anti").drop("key").join(hit, ["date", "url"], "left_anti")

    counts = selected.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    kept = fresh(selected).select("date", "url", "title", F.lit(0).alias("late"), F.col("slot").alias("place"))
    more = fresh(pool).join(selected.select("date", "url"), ["date", "url"], "left_anti").select("date", "url", "title", F.lit(1).alias("late"), "place")
    return best_of(kept.union(more).join(counts, "date"), ["date"], ["late", "place", "url"], F.col("n"), "slot").select("date", "url", "title", "slot")


def apply_selection(candidates: DataFrame, picks: DataFrame, as_of: Column, top: int = 7, most: int = 7) -> DataFrame:
    """Candidates (date, number, url, title) that picks (date, number, value) name; numbers nobody has and old titles go; best value first."""
    rows = candidates.join(picks.where("value between 0 and 100"), ["date", "number"])
    rows = rows.where(~F.coalesce(S.title_age_days(F.col("title"), as_of) > most, F.lit(False)))
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "number")).cast("int")).where(F.col("slot") <= top)


def intel(results: DataFrame, score: Column) -> DataFrame:
    """Results with a score that isn't below nought."""
    return once(results, "score", score.cast("int")).where("score >= 0")


def hot_topics(
    keywords: DataFrame, clicks: DataFrame, results: DataFrame, news: DataFrame, as_of: Column, score: Column, engines: tuple[str, ...],
    relevant=P.RELEVANT_WORDS, local_score: Column | None = None, local_relevant: Column | None = None, total: int = 7,
    known: DataFrame | None = None,
) -> DataFrame:
    """date, url, title, keyword, slot: the hot topics of each date.

    keywords (date, keyword, source, rank) are merged, kept if relevant or curated, weighed by rank and clicks (keyword, clicks), and ten of
    a date are picked. results (date, keyword, variant, engine, url, title, snippet, time_str): of each query the first engine with results,
    without what is old or of no value; of each keyword the first variant that still has some. Each URL counts once a date; the best by
    rules are chosen and those that known (date, url, headline; news, if not given) has already are replaced from the rest. A date without
    any result takes the best articles by local_score (an expression over news) instead.
    """
    merged = merge_keywords(keywords)
    merged = merged.where((F.col("source") == "curated") | S.is_relevant(F.col("keyword"), relevant))
    picked = pick_keywords(weigh_keywords(merged, clicks)).select("date", "keyword")
    asked = results.join(picked, ["date", "keyword"], "left_semi").withColumn("query", F.concat_ws("|", F.col("date").cast("string"), F.col("variant").cast("string")))
    kept = first_variant(intel(filter_by_age(first_engine(asked, engines).drop("query"), as_of), score))
    pool = first_by(kept, ["date", "url"], F.desc("score"), "keyword", "title").select("date", "url", "title", "keyword", "score")
    if local_score is not None:
        bare = news.join(pool.select("date").distinct(), "date", "left_anti")
        local = local_candidates(bare.select("date", "url", "headline", local_score.alias("_score"), local_relevant.alias("_hit")), F.col("_score"), F.col("_hit"))
        pool = pool.unionByName(local.select("date", "url", F.col("headline").alias("title"), F.lit("").alias("keyword"), F.col("score").cast("int").alias("score")))
    pool = stored(pool, "hot-pool")
    chosen = rule_hot_topics(pool, F.col("score"), top=total)
    out = dedup_against(chosen, numbered(pool, ["date"], [F.desc("score"), "url"]), news if known is None else known)
    return out.join(pool.select("date", "url", "keyword"), ["date", "url"]).select("date", "url", "title", "keyword", "slot")
