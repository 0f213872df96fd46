"""Scores of news: fusion, distribution, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalars as S
from .tables import discard, numbered, once, stored


def check_distribution(scored: DataFrame, by: list[str]) -> DataFrame:
    """Whether at least a quarter of a group's scores lie below 40 and at most three tenths above 60; groups under four pass."""
    g = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < 40).alias("n_low"), F.count_if(F.col("score") > 60).alias("n_high"))
    g = g.withColumn("need_low", F.floor(F.col("n") / 4)).withColumn("most_high", F.floor(F.col("n") * 3 / 10))
    return g.withColumn("ok", (F.col("n") < 4) | ((F.col("n_low") >= F.col("need_low")) & (F.col("n_high") <= F.col("most_high"))))


def apply_score_fallback(scored: DataFrame, by: list[str], tie: str = "url") -> DataFrame:
    """The lowest max(1, n/4) scores come to 39 at most, the highest 3n/10 to 64 at most; raw_score keeps what was.

    Counts of each score say where the two cuts fall; only the rows of a score that a cut divides are put in order, by `tie`.
    """
    groups = Window.partitionBy(*by)
    earlier = lambda order: F.coalesce(F.sum("_n").over(groups.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scored.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_all", F.sum("_n").over(groups)).withColumn("_below", earlier(F.col("score"))).withColumn("_above", earlier(F.desc("score")))
    low, high = F.greatest(F.lit(1), F.floor(F.col("_all") / 4)) - F.col("_below"), F.floor(F.col("_all") * 3 / 10) - F.col("_above")
    # how many rows of this score are low and high, where that matters
    cuts = counts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("score").alias("_score"), "_n",
        F.when(F.col("score") >= 40, low).otherwise(0).alias("_low"), F.when(F.col("score") > 65, high).otherwise(0).alias("_high"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    rows = scored.join(cuts, [*same, F.col("score").eqNullSafe(F.col("_score"))])
    divided = ((F.col("_low") > 0) & (F.col("_low") < F.col("_n"))) | ((F.col("_high") > 0) & (F.col("_high") < F.col("_n")))
    place = F.row_number().over(Window.partitionBy(*by, "score").orderBy(tie))
    told = rows.where(~divided).withColumn("_place", F.lit(1)).unionByName(rows.where(divided).withColumn("_place", place))
    capped = F.when(F.col("_place") <= F.col("_low"), 39).when(F.col("_place") <= F.col("_high"), 64).otherwise(F.col("score")).cast("int")
    return told.select(*[capped.alias(c) if c == "score" else F.col(c) for c in scored.columns], F.col("score").alias("raw_score"))


def batch_number(df: DataFrame, by: list[str], order: list[str], size: int = 15) -> DataFrame:
    n = F.col("place") - 1
    return numbered(df, by, order).withColumn("batch", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, numbered."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("place") <= n)


def topic_boost(headline: Column, boosts: dict[str, int], topics: dict[str, tuple[str, ...]], score: Column) -> Column:
    """Score plus the boosts of all topics that a headline hits, within 0..100."""
    total = F.lit(0)
    for topic, points in sorted(boosts.items()):
        total = total + F.when(S.keyword_match(headline, topics[topic]), points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score + total))


def story_marks(summary: Column, headline: Column) -> Column:
    """What tells a story: tokens and entities of the summary, entities of the headline."""
    return F.struct(S.similarity_tokens(summary).alias("tokens"), S.named_entities(summary).alias("said"), S.named_entities(headline).alias("named"))


def same_story(a: Column, b: Column, percent: int = 15, entities: int = 2) -> Column:
    """Whether two story_marks tell one story: similar summaries, or entities in common."""
    common = lambda k: F.size(F.array_intersect(a[k], b[k]))
    either = F.size(F.array_union(a["tokens"], b["tokens"]))
    alike = (F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0) & (100 * common("tokens") >= percent * either)
    return alike | (common("said") >= entities) | (common("named") >= entities)


_CHOSEN = "url string, source string, outlet string, game string, score int, far boolean, story struct<tokens: array<string>, said: array<string>, named: array<string>>"


def select_diverse(
    scored: DataFrame, overseas: tuple[str, ...] = ("pocketgamer.biz",), pairs: DataFrame | None = None, story: Column | None = None,
    total: int = 7, videos: int = 2, per_source: int = 3, per_game: int = 2,
) -> DataFrame:
    """Per date a diverse choice of scored news (date, url, headline, source, score): caps a source, game and video, no same story twice.

    Caps count sources by their canonical name, removed and missing ones as one; overseas holds canonical names.

    The last place is kept for an overseas item while none is chosen; a second pass adds one; a third fills up. What doesn't fit once never
    fits later, so a pass takes the best row that fits, again and again: one aggregate a place over all rows of all dates, and only the
    chosen rows of each date are carried from place to place. Rows are held against the chosen ones' story (a story_marks column) or
    links (date, a, b), never against each other.
    """
    game = F.coalesce(F.nullif(F.regexp_extract("headline", "《([^》]+)》", 1), F.lit("")), F.substring("headline", 1, 8))
    outlet = F.coalesce(S.source_canonical(F.col("source")), F.lit(""))
    abroad = outlet.isin(*overseas)
    kind = _CHOSEN.split("story ")[1]
    marks = F.lit(None).cast(kind) if story is None else story
    rows = stored(scored.select("date", "url", "source", outlet.alias("outlet"), game.alias("game"), F.col("score").cast("int").alias("score"), abroad.alias("far"), marks.alias("story")), "diverse-rows")
    if pairs is not None:
        pairs = stored(pairs.select("date", F.col("a").alias("url"), F.col("b").alias("other")).union(pairs.select("date", "b", "a")), "diverse-pairs")

    none = F.from_json(F.lit("[]"), f"array<struct<{_CHOSEN.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean').replace('story ', 'story: ')}>>")
    state = stored(rows.groupBy("date").agg(F.max("far").alias("any_far")).withColumn("chosen", none), "diverse-chosen")
    n, found_far = F.size("chosen"), F.exists("chosen", lambda c: c["far"])
    count = lambda key: F.size(F.filter("chosen", lambda c: c[key].eqNullSafe(F.col(key))))
    fits = lambda cap: (count("outlet") < F.when(F.col("outlet") == "Bilibili", videos).otherwise(cap)) & (count("game") < per_game) & (count("url") == 0)
    held = ~F.col("far") & (n == total - 1) & ~found_far & F.col("any_far")
    turn = F.when(fits(per_source) & ~held, 1).when(F.col("far") & ~found_far & fits(total - 1), 2).when(fits(per_source), 3)
    if story is not None:
        turn = F.when(~F.exists("chosen", lambda c: same_story(c["story"], F.col("story"))), turn)
    first = F.struct("turn", F.col("score").isNull().alias("blank"), (-F.col("score")).alias("down"), "url", "source", "outlet", "game", "score", "far", "story")
    for _ in range(total):
        left = rows.join(state.withColumnRenamed("date", "on"), F.col("date").eqNullSafe(F.col("on"))).drop("on").where(n < total).withColumn("turn", turn).where("turn is not null")
        if pairs is not None:
            told = state.select(F.col("date"), F.explode("chosen.url").alias("url"))
            left = left.join(pairs.join(told, ["date", "url"]).select("date", F.col("other").alias("url")).distinct(), ["date", "url"], "left_anti")
        best = stored(left.groupBy("date").agg(F.min(first).alias("best")), "diverse-best")
        if not best.limit(1).count():
            discard(best)
            break
        one = F.array(F.struct(*[F.col(f"best.{c}").alias(c) for c in ("url", "source", "outlet", "game", "score", "far", "story")]))
        grown = state.join(best.withColumnRenamed("date", "on"), F.col("date").eqNullSafe(F.col("on")), "left")
        more = stored(grown.select("date", "any_far", F.when(F.col("best").isNull(), F.col("chosen")).otherwise(F.concat("chosen", one)).alias("chosen")), "diverse-chosen")
        discard(state, best)
        state = more
    discard(rows, *([] if pairs is None else [pairs]))
    out = state.select("date", F.posexplode("chosen").alias("slot", "c"))
    return out.select("date", "c.url", "c.source", "c.score", (F.col("slot") + 1).cast("int").alias("slot"))


def judged_news(candidates: DataFrame, scores: DataFrame, year: int, weak: int = 15, boosts: dict[str, int] | None = None, topics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Candidates (date, url, headline, source, body) with given scores (url, score, labels, summary) as far as the gate.

    Weak signals go; an article without a score has 0; scores fuse with signals, topic boosts move them, and the scores of a date out of
    shape are capped. given says whether the article's date has any score. Texts are read once, what follows works on short rows.
    """
    asked = once(candidates.select("date", "url", "headline", "source", "body"), "signal", S.signal_score(F.col("body"), year))
    asked = asked.where(F.col("signal") >= weak).select("date", "url", "headline", "source", "signal")
    told = scores.select("url", F.col("score").alias("told"), "pos_label", "neg_label", "summary")
    rows = asked.join(told, "url", "left")
    score = S.fuse(F.col("signal"), F.coalesce("told", F.lit(0)))
    rows = rows.withColumn("score", topic_boost(F.col("headline"), boosts, topics, score) if boosts else score)
    rows = rows.withColumn("pos_label", F.coalesce(S.valid_label(F.col("pos_label"), P.POS_LABELS), F.lit(""))).withColumn("neg_label", F.coalesce(S.valid_label(F.col("neg_label"), P.NEG_LABELS), F.lit("")))
    rows = stored(rows, "judged-news")  # with the scores, as what follows reads them again and again
    dates = rows.groupBy(F.col("date").alias("on")).agg((F.count("told") > 0).alias("given"))
    shape = check_distribution(rows, ["date"]).select(F.col("date").alias("of"), "ok")
    capped = apply_score_fallback(rows, ["date"]).join(shape, F.col("date").eqNullSafe(F.col("of"))).join(dates, F.col("date").eqNullSafe(F.col("on")))
    fitted = F.when(F.col("ok"), F.col("raw_score")).otherwise(F.col("score"))
    return capped.withColumn("score", fitted.cast("int")).select("date", "url", "headline", "source", "score", "pos_label", "neg_label", F.coalesce("summary", F.lit("")).alias("summary"), "given")


def score_news(
    candidates: DataFrame, scores: DataFrame, year: int, weak: int = 15, gate: int = 40, boosts: dict[str, int] | None = None,
    topics: dict[str, tuple[str, ...]] | None = None, overseas: tuple[str, ...] = ("pocketgamer.biz",), total: int = 7,
) -> DataFrame:
    """The news of each date: judged_news over the gate, of them a diverse choice; of a date without any score the first `total` by url, with 0."""
    rows = stored(judged_news(candidates, scores, year, weak, boosts, topics), "score-news")
    over = rows.where("given").where(F.col("score") >= gate)
    chosen = select_diverse(over, overseas, story=story_marks(F.col("summary"), F.col("headline")), total=total).select("date", "url", "slot")
    bare = top_n(rows.where("not given").withColumn("score", F.lit(0)), ["date"], ["url"], total).withColumnRenamed("place", "slot")
    best = over.join(chosen, ["date", "url"])
    columns = ["date", "url", "headline", "source", "score", "pos_label", "neg_label", "slot"]
    return best.select(*columns).unionByName(bare.select(*columns))


def report_order(rows: DataFrame) -> DataFrame:
    """Followed topics first, then by score; numbered a date."""
    return numbered(rows, ["date"], [F.desc("track_relevant"), F.desc("score"), "url"])
