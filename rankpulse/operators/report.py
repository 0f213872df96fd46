"""Daily report tables, quality checks and audit counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import best_of, falling, numbered, source_coverage, stored


def merge_new_games(ports: DataFrame, games: DataFrame) -> DataFrame:
    """(date, game_name) of both tables with a badge: both, port or calendar."""
    p, g = ports.select("date", "game_name").distinct().withColumn("p", F.lit(True)), games.select("date", "game_name").distinct().withColumn("g", F.lit(True))
    badge = F.when(F.col("p") & F.col("g"), "both").when(F.col("p"), "port").otherwise("calendar")
    return p.join(g, ["date", "game_name"], "full_outer").select("date", "game_name", badge.alias("badge"))


def fresh_games(games: DataFrame, reported: DataFrame, days: int = 7) -> DataFrame:
    """Games (date, game_name, is_port) neither reported (game_name, date) before, nor in the table: within `days` before, ports ever.

    Of a name only its distinct dates matter: the first one, the first reported one and the one before each, so no row meets another.
    """
    told = reported.select("game_name", "date", F.lit(False).alias("in_table"), F.lit(True).alias("told"), F.lit(False).alias("is_port"))
    rows = games.select("game_name", "date", F.lit(True).alias("in_table"), F.lit(False).alias("told"), "is_port").union(told).where("game_name is not null and date is not null")
    each = rows.groupBy("game_name", "date").agg(*[F.max(c).alias(c) for c in ("in_table", "told", "is_port")])
    before = Window.partitionBy("game_name").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("in_table"), F.col("date"))).over(before)
    each = each.withColumns({"told": F.coalesce(F.max("told").over(before), F.lit(False)), "last": last})
    seen = each.where("in_table").where(F.col("told") | (F.col("is_port") & F.col("last").isNotNull()) | (F.datediff("date", "last") <= days))
    return games.join(seen.select("date", "game_name"), ["date", "game_name"], "left_anti")


def choose_new_games(games: DataFrame, top: int = 5) -> DataFrame:
    """Per date the games on followed topics (track_class), else the `top` others by downloads, with a note."""
    on = F.col("track_class") == "track"
    has = games.groupBy("date").agg(F.max(on).alias("any"))
    rows = stored(games.join(has, "date").where(on | ~F.col("any")), "new-games")  # of a date with followed ones only those
    followed = numbered(rows.where("any"), ["date"], [F.desc("downloads"), "game_name"])
    others = best_of(rows.where("not any"), ["date"], [falling("downloads"), "game_name"], F.lit(top))
    rows = followed.unionByName(others)
    return rows.select("date", "game_name", "downloads", "place", F.when(F.col("any"), "").otherwise("no followed topic").alias("note"))


def force_include(changes: DataFrame, shown: DataFrame, top: int = 12) -> DataFrame:
    """Ranking rows of each date: the games shown on the day before (date, game_name) first, then by attention; `top` in all."""
    again = shown.select(F.date_add("date", 1).alias("date"), "game_name").distinct().withColumn("forced", F.lit(True))
    rows = changes.join(again, ["date", "game_name"], "left").fillna(False, ["forced"])
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("forced"), F.desc("attention_score"), "platform", "chart_type", "bundle_id")).cast("int")
    return rows.withColumn("place", place).where(F.col("place") <= top)


def card_images(rows: DataFrame, top: int = 3) -> DataFrame:
    """Images (date, image, tier): distinct, the best tier of each, `top` a date."""
    one = rows.groupBy("date", "image").agg(F.min("tier").alias("tier"))
    return one.withColumn("slot", F.row_number().over(Window.partitionBy("date").orderBy("tier", "image")).cast("int")).where(F.col("slot") <= top)


def news_line() -> Column:
    return F.concat(F.lit("> **"), "headline", F.lit("** — "), S.source_label(F.col("source")), F.lit(" [link]("), "url", F.lit(")"))


def rank_line() -> Column:
    """Rank text with the change: ▲ is up."""
    mark = F.when(F.col("change_type") == "new_entry", "NEW").when(F.col("change_type") == "dropped_out", "OUT").when(F.col("rank_change") > 0, F.concat(F.lit("▲"), F.col("rank_change").cast("string"))).when(F.col("rank_change") < 0, F.concat(F.lit("▼"), (-F.col("rank_change")).cast("string"))).otherwise("=")
    return F.concat_ws(" ", F.concat(F.lit("#"), F.coalesce("today_rank", "yesterday_rank").cast("string")), "game_name", mark)


def section(rows: DataFrame, line: Column, place: str = "place") -> DataFrame:
    """date, text: the lines of each date in order of place. Sections are cut to a few lines a date before they come here."""
    lines = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), line.alias("line")))).alias("l"))
    return lines.select("date", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def daily_report(news: DataFrame, ranks: DataFrame, games: DataFrame) -> DataFrame:
    """One row a date with three texts."""
    g = section(games, F.concat_ws(" · ", "game_name", F.col("downloads").cast("string")))
    out = section(news, news_line()).withColumnRenamed("text", "market").join(section(ranks, rank_line()).withColumnRenamed("text", "ranking"), "date", "full_outer")
    return out.join(g.withColumnRenamed("text", "new_games"), "date", "full_outer").fillna("", ["market", "ranking", "new_games"])


def reports(table: DataFrame, date: Column | None = None) -> DataFrame:
    return (table if date is None else table.where(F.col("date") == date)).orderBy("date")


def attach_by_url(lines: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """Lines (date, line) of a published text with items.column of the URL that they link."""
    rows = lines.withColumn("url", F.get(S.headline_links(F.col("line")), 0))
    return rows.join(items.select("url", column), "url", "left")


def report_lines(reports_: DataFrame, column: str) -> DataFrame:
    return reports_.select("date", F.posexplode(F.split(column, "\n")).alias("place", "line")).where("line <> ''")


def quality_checks(
    table: DataFrame, known: DataFrame, block: tuple[str, ...], deprecated: tuple[str, ...] = (), most: int = 7, long_: int = 200, games: DataFrame | None = None
) -> DataFrame:
    """Failed checks as rows (date, check, points): section missing, blocked or deprecated word, over `most` items, unknown URL, no link,
    over-long, a market section without any link. With games (date, game_name, is_port) also a new game that none of them is, and
    another game in one of the first places, as many as the date has ports."""
    table = stored(table, "report")  # the checks read it again and again
    lines = report_lines(table, "market")
    url = F.get(S.headline_links(F.col("line")), 0)
    told = lambda df, name, points: df.select("date", F.lit(name).alias("check"), F.lit(points).alias("points"))
    found = [told(table.where(f"{c} = ''"), f"no_{c}", 20) for c in ("market", "ranking", "new_games")]
    found.append(told(lines.where(S.contains_any(F.col("line"), block, fold=True)), "block_word", 10))
    found.append(told(lines.where(S.contains_any(F.col("line"), deprecated)), "deprecated_word", 5))
    found.append(told(lines.groupBy("date").count().where(F.col("count") > most), "too_many", 10))
    found.append(told(lines.withColumn("url", url).where("url is not null").join(known.select("url").distinct(), "url", "left_anti"), "unknown_url", 15))
    found.append(told(lines.where(url.isNull()), "no_link", 5))
    found.append(told(lines.where(F.length("line") > long_), "over_long", 5))
    bare = lines.groupBy("date").agg(F.count(url).alias("links"))
    found.append(told(bare.where("links = 0"), "no_links", 5))
    if games is not None:
        shown = report_lines(table, "new_games").select("date", "place", F.trim(F.substring_index("line", " · ", 1)).alias("game_name"))
        told_games = games.groupBy("date", "game_name").agg(F.max("is_port").alias("port"))
        held = shown.join(told_games, ["date", "game_name"], "left")
        found.append(told(held.where("port is null"), "unknown_game", 3))
        ports = games.where("is_port").groupBy("date").agg(F.countDistinct("game_name").alias("ports"))
        late = held.join(ports, "date").where((F.col("place") < F.col("ports")) & ~F.coalesce("port", F.lit(False)))
        found.append(told(late.select("date").distinct(), "port_order", 1))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def quality_score(table: DataFrame, checks: DataFrame) -> DataFrame:
    """100 less the points of each date's checks, 0 at least; passed without any."""
    s = checks.groupBy("date").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n_failed"))
    return table.select("date").join(s, "date", "left").select("date", F.greatest(F.lit(0), 100 - F.coalesce("points", F.lit(0))).cast("int").alias("score"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.col("n_failed").isNull().alias("passed"))


def audit_metrics(news: DataFrame, block: tuple[str, ...], track: Column) -> DataFrame:
    """Counters of each date's articles: rows, sources, top source, share on topics, languages, block words."""
    per = news.groupBy("date", "source").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("date").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("top_source"), F.max("n").alias("top_rows"))
    base = news.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.count_if(track).alias("n_track"),
        F.count_if(F.col("category") == "en").alias("n_en"), F.count_if(S.contains_any(F.col("headline"), block, fold=True)).alias("n_blocked"),
    )
    return base.join(top, "date").withColumn("track_percent", F.floor(F.col("n_track") * 100 / F.col("n_rows")).cast("int"))


def audit_report(tables: dict[str, DataFrame], table: DataFrame, news: DataFrame, changes: DataFrame, block: tuple[str, ...], overseas: tuple[str, ...] = ("pocketgamer.biz",)) -> DataFrame:
    """Counters of each date as rows (date, counter, name, n): rows of each source table, published items and their sources, the top source,
    sections that a report has, blocked words in the published text, changes, news on followed topics, and both languages."""
    out = lambda df, counter, name, n: df.select("date", F.lit(counter).alias("counter"), (name if isinstance(name, Column) else F.lit(name)).alias("name"), n.cast("long").alias("n"))
    one = F.count(F.lit(1))
    table = stored(table, "report")
    lines = report_lines(table, "market")
    source = F.regexp_extract("line", r"— (\S+) \[", 1)
    sources = lines.where(source != "").groupBy("date", source.alias("source")).agg(one.alias("n"))
    top = sources.groupBy("date").agg(F.min(F.struct((-F.col("n")).alias("less"), "source", "n")).alias("t"))
    found = [
        out(source_coverage(tables), "rows", F.col("source_table"), F.col("n")), out(sources, "source", F.col("source"), F.col("n")),
        out(top, "top_source", F.col("t.source"), F.col("t.n")), out(lines.where(F.size(S.headline_links(F.col("line"))) > 0).groupBy("date").agg(one.alias("n")), "published", "", F.col("n")),
        *[out(table, "section", c, (F.col(c) != "").cast("int")) for c in ("new_games", "market", "ranking")],
        out(changes.groupBy("date").agg(one.alias("n")), "changes", "", F.col("n")),
        out(news.groupBy("date").agg(F.count_if("track_relevant").alias("n")), "track_news", "", F.col("n")),
        *[out(news.groupBy("date").agg(F.count_if(F.col("source").isin(*overseas) == far).alias("n")), "language", n, F.col("n")) for n, far in (("home", False), ("abroad", True))],
        *[out(table.where(S.contains_any(F.col("market"), (w,), fold=True)), "blocked", w, F.lit(1)) for w in block],
    ]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


def tool_timing(log: DataFrame) -> DataFrame:
    """Calls, total and floor average latency and cache hits by run and tool, and by run (tool_name null)."""
    sets = log.groupingSets([["run_id", "tool_name"], ["run_id"]], "run_id", "tool_name")
    return sets.agg(F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("total_ms"), F.floor(F.avg("latency_ms")).alias("avg_ms"), F.count_if("cache_hit").alias("cache_hits"))


def run_summary(steps: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Steps (run_id, step, status, ms): counts of each status, total, and whether a required step failed."""
    bad = (F.col("status") == "failed") & F.col("step").isin(*required)
    return steps.groupBy("run_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("ms").alias("total_ms"), F.bool_or(bad).alias("fatal"))
