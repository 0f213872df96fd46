"""Chart and article files: names, rows, mappings, CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalars as S
from ..operators.tables import stored
from ..operators.tracks import track_class

#: Headers of chart files and our names.
ALIASES = {
    "排名": "rank", "Bundle ID": "bundle_id", "应用": "game_name", "Android/iOS": "platform_raw", "iOS/Android": "platform_raw", "类别": "category",
    "开发者": "developer", "platform": "platform_raw", "scrape_date": "date_override", "genre": "category", "publisher": "developer",
}
CHART_WORDS = ("热门", "免费", "畅销", "新品", "下载", "收入")
OTHER_FILES = ("资讯", "Steam移植", "新游", "B站", "bilibili", "steam_port")
RAW = ("rank", "bundle_id", "game_name", "platform_raw", "category", "developer", "date_override")


def file_date(name: Column) -> Column:
    """The date in a file name, hyphenated first, then eight digits; null if neither."""
    full = F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    short = F.regexp_replace(F.regexp_extract(name, r"([0-9]{8})", 1), r"^(....)(..)(..)$", "$1-$2-$3")
    return F.coalesce(F.try_to_date(F.nullif(full, F.lit(""))), F.try_to_date(F.nullif(short, F.lit(""))))


def file_chart_type(name: Column) -> Column:
    """The chart in a file name, 热门榜 by default; null for files that are no charts. A full chart name beats a part."""
    out = F.when(name.rlike("|".join(OTHER_FILES)), F.lit(None))
    for suffix in ("榜", ""):
        for word in CHART_WORDS:
            out = out.when(name.contains(word + suffix), f"{word}榜")
    return out.otherwise("热门榜")


def normalize_rankings(rows: DataFrame) -> DataFrame:
    """Rows (RAW, date, chart_type): platform, bundle fallback, developer "0" as null, ranks that aren't numbers as 0, the row's own date."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    bundle, dev, rank = t("bundle_id"), t("developer"), t("rank")
    return rows.where(t("game_name") != "").select(
        F.coalesce(F.try_to_date(F.nullif(t("date_override"), F.lit(""))), "date").alias("date"), S.normalize_platform(F.col("platform_raw")).alias("platform"), "chart_type",
        t("category").alias("category"), F.when(rank.rlike("^[0-9]+$"), rank.try_cast("int")).otherwise(0).alias("rank"),
        F.when(bundle.isin("", "0"), F.concat(F.lit("fallback:"), t("game_name"))).otherwise(bundle).alias("bundle_id"), t("game_name").alias("game_name"),
        F.when(dev != "0", dev).alias("developer"),
    )


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def chart_files(spark: SparkSession, paths: str | list[str], name=file_name) -> DataFrame:
    """path, date, chart_type, names of every file: what its name says and its header's columns by our names, in order.

    One pass takes the first line of each file. name: what a path is called, by default the file's own name.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "id").alias("header"))
    cells = F.transform(F.split("header", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: _plain(F.regexp_replace(c, '^\ufeff?\\s*"|"\\s*$', "")))
    return first.select("path", file_date(name(F.col("path"))).alias("date"), file_chart_type(name(F.col("path"))).alias("chart_type"), cells.alias("header"))


def _plain(cell: Column) -> Column:
    """A header's cell without the file's mark and outer white space."""
    return F.trim(F.replace(F.coalesce(cell, F.lit("")), F.lit("\ufeff"), F.lit("")))


def read_rankings(spark: SparkSession, paths: str | list[str], name=file_name) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of chart CSVs, of which each has a header of its own: any columns in any order, by their own or aliased names, with a BOM or not.

    Rows are normalised; of two columns with one meaning the last one counts. A file is rejected (path, reason) if its name has no date, if it is no
    chart, or if no row has a name. All files are read at once, as cells by position, and each row finds its columns by its own file's header.
    """
    files = stored(chart_files(spark, paths, name), "chart-files")
    width = files.agg(F.max(F.size("header"))).first()[0] or 1  # one number
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.schema(schema).options(recursiveFileLookup=True, multiLine=True, escape='"').csv(paths).withColumn("path", F.col("_metadata.file_path"))
    ours = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    meaning = F.transform("header", lambda c: F.coalesce(ours[c], c))
    last = lambda n: F.array_max(F.transform(meaning, lambda c, i: F.when(c == n, i)))
    known = files.select("path", "date", "chart_type", "header", *[last(n).alias(f"_at_{n}") for n in RAW])
    cells = F.array(*[f"c{i}" for i in range(width)])
    own = F.transform(F.slice(cells, F.lit(1), F.size("header")), _plain)
    rows = raw.join(known, "path").where(own != F.col("header"))
    rows = rows.select("path", "date", "chart_type", *[F.get(cells, F.col(f"_at_{n}")).alias(n) for n in RAW])
    named = rows.where(F.trim(F.coalesce("game_name", F.lit(""))) != "")
    filled = named.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    why = F.when(F.col("date").isNull(), "no date in the name").when(F.col("chart_type").isNull(), "not a chart").when(F.col("n").isNull(), "no rows")
    rejects = files.join(filled, "path", "left").select("path", why.alias("reason")).where("reason is not null")
    return normalize_rankings(rows.where("date is not null and chart_type is not null")), rejects


def write_rankings(rankings: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder a platform, chart and date."""
    out = rankings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform", "chart_type", "date")
    (out.option("header", True).csv if kind == "csv" else out.parquet)(path)


def positional_rows(rows: DataFrame, layout: list[str], cells: str = "cells") -> DataFrame:
    """Rows of cells as named columns: the most frequent width of each group is right, others are padded or cut to it; first row a rank."""
    width = rows.groupBy("group", F.size(cells).alias("width")).agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("width", F.struct("n", "width")).alias("width"))
    fit = rows.join(width, "group").withColumn("_c", F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.col("width"))), 1, F.col("width")))
    out = fit.select("group", "row", *[F.coalesce(F.get("_c", i), F.lit("")).alias(n) for i, n in enumerate(layout)]).withColumn("rank", F.col("rank").try_cast("int")).where("rank between 1 and 500")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("group", "rank").orderBy("row"))).where("_n = 1").drop("_n")


def standardize(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without columns that are empty in every row: one pass that gives a flag a column."""
    flags = df.agg(*[F.max((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if flags[c]])


def _first(df: DataFrame, *names: str) -> Column:
    there = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit("")) if there else F.lit("")


def to_market_news(df: DataFrame, track=P.TRACK_WORDS) -> DataFrame:
    """Scraped articles under alternative headers as news; rows without headline or URL go."""
    h = _first(df, "headline", "title", "标题")
    flag = F.lower(_first(df, "track_relevant")).isin("1", "true", "yes") | (track_class(h, track=track) == "track")
    rows = df.select(h.alias("headline"), S.source_canonical(_first(df, "source", "来源")).alias("source"), _first(df, "url", "link", "链接").alias("url"), _first(df, "publish_date", "date", "日期").alias("publish_date"), flag.alias("track_relevant"))
    return rows.where("headline <> '' and url <> ''")


def to_new_games(df: DataFrame, track=P.TRACK_WORDS) -> DataFrame:
    """Calendar rows under alternative headers; blank names go, bundles lose their fallback mark, ratings that aren't numbers are null.

    track_relevant: a followed topic, or a port by its tags.
    """
    name, tags, genre, said = _first(df, "应用", "game_name", "name"), _first(df, "tags", "标签"), _first(df, "品类", "genre"), _first(df, "description")
    port = F.exists(F.split(tags, ","), lambda t: F.lower(t).contains("steam") | t.contains("移植"))
    return df.select(
        name.alias("game_name"), F.regexp_replace(_first(df, "Bundle ID", "bundle_id"), "fallback:", "").alias("bundle_id"), _first(df, "downloads").alias("downloads"),
        _first(df, "rating").try_cast("double").alias("rating"), tags.alias("tags"), genre.alias("genre"), said.alias("description"), _first(df, "taptap_url", "url").alias("url"),
        S.event_type(F.concat_ws(" ", _first(df, "event_type"), said)).alias("event_type"),
        (track_class(F.concat_ws(" ", name, genre, tags, said), port, track=track) == "track").alias("track_relevant"),
    ).where("game_name <> ''")


def to_ports(df: DataFrame) -> DataFrame:
    """Port rows: blank names go, bundles lose their fallback mark; every port has a mobile version and is of interest."""
    rows = df.select(
        _first(df, "应用", "game_name", "name").alias("game_name"), F.regexp_replace(_first(df, "Bundle ID", "bundle_id"), "fallback:", "").alias("bundle_id"),
        _first(df, "品类", "genre").alias("genre"), _first(df, "source").alias("source"), F.lit(True).alias("has_mobile_version"), F.lit(True).alias("track_relevant"),
    )
    return rows.where("game_name <> ''")


#: The columns of a video record; numbers that are none count 0.
VIDEO_TEXTS = ("creator_uid", "creator_label", "bvid", "title", "description", "url", "cover", "duration", "created_at", "category", "tags", "ai_subtitle")
VIDEO_NUMBERS = ("play_count", "comment_count", "video_review", "like_count", "favorite_count", "coin_count", "share_count")


def to_videos(df: DataFrame) -> DataFrame:
    """Video records of a file: all columns of VIDEO_TEXTS and VIDEO_NUMBERS; rows without an id go."""
    other = {"play_count": ("play", "views"), "created_at": ("published_at",)}
    texts = [_first(df, c, *other.get(c, ())).alias(c) for c in VIDEO_TEXTS]
    return df.select(*texts, *[F.coalesce(_first(df, c, *other.get(c, ())).try_cast("double").cast("long"), F.lit(0)).alias(c) for c in VIDEO_NUMBERS]).where("bvid <> ''")


def port_signal(text: Column, ports=("移植", "port"), platforms=("手机", "mobile", "ios", "android"), many=("多平台", "multi-platform"), marker=("steam_integration",)) -> Column:
    """port if an integration marker stands there, or port words with a platform, weak where multi-platform words are as frequent; else none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    times = lambda words: sum((F.size(F.split(low, w)) - 1 for w in words), F.lit(0))
    has = lambda words: S.contains_any(low, words)
    n, m = times(ports), times(many)
    return F.when(has(marker), "port").when((n > 0) & has(platforms), F.when(m >= n, "weak").otherwise("port")).otherwise("none")


def port_candidates(games: DataFrame, articles: DataFrame, longest: int = 30) -> DataFrame:
    """Calendar games (game_name) first, then names that articles (headline) hold in 《》 or 「」, not seen and not over-long."""
    calendar = games.groupBy("game_name").agg(F.lit(0).alias("kind"))
    named = articles.select(F.explode(S.game_names(F.col("headline"))).alias("game_name")).where(F.length("game_name") <= longest).distinct()
    return calendar.union(named.join(calendar, "game_name", "left_anti").withColumn("kind", F.lit(1)))


def video_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """Video API answers (creator_uid, creator_label, json) as video records with place, the newest of a creator first; videos without an id go."""
    schema = "data struct<list: struct<vlist: array<struct<bvid: string, title: string, description: string, pic: string, play: string, comment: string, video_review: string, length: string, created: long>>>>"
    v = raw.select("creator_uid", "creator_label", F.explode(F.from_json(column, schema)["data"]["list"]["vlist"]).alias("v")).select("creator_uid", "creator_label", "v.*")
    n = lambda c: F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0)).alias({"play": "play_count", "comment": "comment_count"}.get(c, c))
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    rows = v.where("bvid <> ''").select(
        "creator_uid", "creator_label", "bvid", text("title", "title"), text("description", "description"), F.concat(F.lit("https://www.bilibili.com/video/"), "bvid").alias("url"),
        text("pic", "cover"), n("play"), n("comment"), n("video_review"), text("length", "duration"), F.timestamp_seconds(F.nullif("created", F.lit(0))).alias("created_at"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("creator_uid").orderBy(F.desc("created_at"), "bvid")).cast("int"))


def with_details(videos: DataFrame, details: DataFrame, column: str = "json") -> DataFrame:
    """Video records with what a detail answer (bvid, json) adds: description, counts, category; duration and time where they lack. An answer
    with an error code, or none, leaves the record as it was, with counts of 0."""
    schema = "code int, data struct<desc: string, tname: string, duration: long, pubdate: long, stat: struct<like: long, favorite: long, coin: long, share: long>>"
    told = details.select(F.col("bvid").alias("_bvid"), F.from_json(column, schema).alias("_a")).where("_a.code = 0")
    rows = videos.join(told, F.col("bvid") == F.col("_bvid"), "left")
    d = F.col("_a")["data"]
    clock = F.concat_ws(":", F.lpad(F.floor(d["duration"] / 60).cast("string"), 2, "0"), F.lpad((d["duration"] % 60).cast("string"), 2, "0"))
    return rows.withColumns({
        "description": F.coalesce(d["desc"], "description"), "category": F.coalesce(d["tname"], F.lit("")),
        "duration": F.when((F.coalesce("duration", F.lit("")) == "") & (d["duration"] > 0), clock).otherwise(F.col("duration")),
        "created_at": F.coalesce("created_at", F.timestamp_seconds(F.nullif(d["pubdate"], F.lit(0)))),
        **{f"{k}_count": F.coalesce(d["stat"][k], F.lit(0)) for k in ("like", "favorite", "coin", "share")},
    }).drop("_bvid", "_a")


def or_page_videos(videos: DataFrame, pages: DataFrame) -> DataFrame:
    """Video records, and for creators without any those that their page (creator_uid, creator_label, html) links: id and title, in page order."""
    tag = F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)(<a\s[^>]*/video/BV[0-9A-Za-z]+[^>]*>.*?</a>)'), F.lit(1))).alias("at", "tag")
    rows = pages.join(videos.select("creator_uid").distinct(), "creator_uid", "left_anti").select("creator_uid", "creator_label", tag)
    title = F.coalesce(F.nullif(F.regexp_extract("tag", r'(?is)title="([^"]+)"', 1), F.lit("")), F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", " "), r"\s+", " ")))
    rows = rows.select("creator_uid", "creator_label", "at", F.regexp_extract("tag", "/video/(BV[0-9A-Za-z]+)", 1).alias("bvid"), title.alias("title")).where("title <> ''")
    one = rows.groupBy("creator_uid", "bvid").agg(F.min(F.struct("at", "creator_label", "title")).alias("f")).select("creator_uid", "bvid", "f.*")
    place = F.row_number().over(Window.partitionBy("creator_uid").orderBy("at")).cast("int")
    return videos.unionByName(one.withColumn("place", place).withColumn("url", F.concat(F.lit("https://www.bilibili.com/video/"), "bvid")).drop("at"), allowMissingColumns=True)


def rss_items(raw: DataFrame, column: str = "xml") -> DataFrame:
    """RSS documents as news rows: title and link (else guid) needed, the excerpt cleaned, RFC 2822 or ISO dates."""
    item = F.explode(F.regexp_extract_all(column, F.lit("(?s)<item>(.*?)</item>"), F.lit(1)))
    field = lambda n: F.trim(F.regexp_replace(F.regexp_extract("item", f"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    rows = raw.select(item.alias("item"))
    link = F.coalesce(F.nullif(field("link"), F.lit("")), field("guid"))
    return rows.select(field("title").alias("headline"), link.alias("url"), S.excerpt(field("description")).alias("excerpt"), S.rfc2822_date(field("pubDate")).alias("publish_date")).where("headline <> '' and url <> ''")


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """df with json (valid JSON text or null) and layer: 1 as it is, 2 without fences, 3 the outermost braces, 0 none."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    c = trim(F.coalesce(column, F.lit("")))
    fence = trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))
    brace = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    ok = lambda x: x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull()
    layer = F.when(ok(c), 1).when(ok(fence), 2).when(ok(brace), 3).otherwise(0)
    return df.withColumn("layer", layer).withColumn("json", F.when(F.col("layer") == 1, c).when(F.col("layer") == 2, fence).when(F.col("layer") == 3, brace))
