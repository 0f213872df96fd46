"""Features that keep or lay out tables: recomputed dates, caches, daily partials, scans, keyword tables, limits by group."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankpulse.functions import scalars as S
from rankpulse.operators import charts, feedback, hot, keywords, recompute, report, search, stories, tables
from rankpulse.streaming import jobs

DAY = dt.date(2024, 1, 1)


def days(n):
    return DAY + dt.timedelta(n)


def files(root):
    """The data files of each date folder below a table."""
    found = {}
    for f in Path(root).glob("date=*/*.parquet"):
        found.setdefault(f.parent.name[5:], set()).add(f.name)
    return found


def scan_metrics(df):
    """Counts of the file scans of a plan that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            metrics, it = {}, node.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                metrics[pair._1()] = pair._2().value()
            out.append(metrics)
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return out


# --- dates made anew


def chart_rows(spark):
    """Nine dates of two charts. Game x climbs on all of them; one date of it changes below, which ends runs on later dates."""
    out = []
    for d in range(9):
        for g in range(40):
            rank = (g * 7 + d * (11 if g % 3 else 5)) % 40 + 1
            out.append((days(d), "iOS" if g % 2 else "Android", "free", f"cat{g % 4}", rank, f"b{g}", f"game {g}", f"dev{g % 5}"))
        out.append((days(d), "iOS", "free", "cat", 90 - 5 * d, "x", "climber", "dev"))
    return spark.createDataFrame(out, "date date, platform string, chart_type string, category string, rank int, bundle_id string, game_name string, developer string")


def told(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("gone", [False, True])
def test_recompute_a_date(spark, tmp_path, gone):
    rows, root = chart_rows(spark), str(tmp_path)
    recompute.build(rows, root)
    before = {name: files(tmp_path / name) for name in ("rankings", "changes", "stories")}
    new = rows.where(F.col("date") == F.lit(days(3))).withColumn("rank", F.when(F.col("bundle_id") == "x", 99).otherwise(41 - F.col("rank")))
    new = new.limit(0) if gone else new.unionByName(new.limit(1).withColumn("platform", F.lit("")))
    dates = spark.createDataFrame([(days(3),)], "date date")
    changed, told_ = recompute.recompute(spark, root, new, dates)
    full = rows.where(F.col("date") != F.lit(days(3))).unionByName(new.where("platform <> ''"))
    want = charts.diff(full)
    assert told(spark.read.parquet(f"{root}/changes").select(want.columns)) == told(want)
    best = stories.pick_stories(want, full)
    assert told(spark.read.parquet(f"{root}/stories").select(best.columns)) == told(best)
    redone = {"rankings": {days(3)}, "changes": {days(3), days(4)}, "stories": {r["date"] for r in told_.collect()}}
    assert {r["date"] for r in changed.collect()} == redone["changes"] and redone["stories"] >= redone["changes"] and len(redone["stories"]) < 9
    for name, then in before.items():
        now = files(tmp_path / name)
        for day, names in then.items():
            if dt.date.fromisoformat(day) not in redone[name]:
                assert now[day] == names, (name, day)
        assert gone is False or name == "stories" or str(days(3)) not in now or name == "changes" and str(days(3)) not in now


def test_forget_reported(spark):
    df = spark.createDataFrame([("a", "news", days(1), ""), ("b", "news_h", days(1), ""), ("c", "taptap", days(1), ""), ("d", "news", days(2), "")], "item_key string, item_type string, reported_date date, meta string")
    assert {r["item_key"] for r in recompute.forget_reported(df, F.lit(days(1))).collect()} == {"c", "d"}


# --- caches


def test_cached_search(spark, tmp_path):
    """The first run asks all, the second nothing that the cache has; what is stale, empty or left empty by the filter is asked; variants go in order."""
    requests = spark.createDataFrame([(k, DAY, v, f"{k} {v}") for k in ("a", "b", "c") for v in (0, 1)], "keyword string, date date, variant int, query string")
    asked = []

    def answer(missed):
        asked.append(sorted(r["query"] for r in missed.collect()))
        key = lambda q: tables.query_hash(F.lit(q), F.lit(DAY))
        rows = [("a 0", "alpha", "t1", "u1"), ("a 0", "alpha", "old", "u2"), ("b 1", "beta", "t3", "u3"), ("c 0", "alpha", "old", "u4")]
        known = spark.createDataFrame(rows, "q string, engine string, title string, url string").select(tables.query_hash(F.col("q"), F.lit(DAY)).alias("query_hash"), "engine", "title", "url", F.lit("s").alias("snippet"), F.lit("").alias("time_str"))
        return known.join(missed.select("query_hash"), "query_hash", "left_semi")

    fine = lambda rows: rows.where("title <> 'old'")
    path, at = str(tmp_path / "cache"), F.lit(dt.datetime(2024, 1, 2, 12))

    def run(now, keep=fine):
        asked.clear()
        results, rows, misses = search.cached_search(requests, search.read_cache(spark, path), answer, keep, now)
        got = sorted((r["keyword"], r["variant"], r["url"], r["cached"]) for r in results.collect())
        assert sorted(r["query"] for r in misses.collect()) == sorted(q for part in asked for q in part)
        search.take_up(rows, path)
        return got, [list(x) for x in asked]

    assert run(at) == ([("a", 0, "u1", False), ("b", 1, "u3", False)], [["a 0", "b 0", "c 0"], ["b 1", "c 1"]])
    # the second run asks for no cached query; what gave nothing isn't kept
    assert run(at + F.expr("interval 1 hour")) == ([("a", 0, "u1", True), ("b", 1, "u3", True)], [["b 0", "c 0"], ["c 1"]])
    # a filter that leaves nothing of the cached rows falls through to the search
    assert run(at + F.expr("interval 2 hours"), lambda rows: rows.where("url <> 'u3' and title <> 'old'"))[1] == [["b 0", "c 0"], ["b 1", "c 1"]]
    # a day later all is stale
    assert run(at + F.expr("interval 25 hours"))[1][0] == ["a 0", "b 0", "c 0"]
    kept = search.compact(search.read_cache(spark, path), at + F.expr("interval 25 hours")).collect()
    assert len(kept) == 2 and {r["query"]: r["result_count"] for r in kept} == {"a 0": 1, "b 1": 1}
    assert run(at, fine)[0] and search.cached_search(requests.limit(0), search.read_cache(spark, path), answer, fine, at)[0].count() == 0


# --- daily partials


def test_windows_read_their_days_alone(spark, tmp_path):
    rows = [(days(d), kind, f"k{k}", f"u{(d * u) % 17}" if u % 5 else "") for d in range(20) for u in range(30) for k in range(2) for kind in ("hot_click", "thumbs_up")]
    df = spark.createDataFrame(rows, "date date, feedback_type string, keyword string, open_id string")
    root, as_of, since = str(tmp_path), F.lit(days(19)), F.lit(days(12))
    feedback.write_daily(df, root)
    late = df.where(F.col("date") >= F.lit(days(18)))
    feedback.write_daily(late, root)  # a day again replaces its partials
    pairs = [
        (feedback.window_stats(spark, root, as_of, 7), feedback.feedback_stats(df, as_of, 7), 7), (feedback.window_clicks(spark, root, as_of), feedback.click_stats(df, as_of), 14),
        (feedback.window_users(spark, root, since), feedback.topic_clicks(df, since), 8), (feedback.window_users(spark, root, since, True), feedback.topic_clicks(df, since), 8),
    ]
    for got, want, n in pairs:
        assert told(got) == told(want.select(got.columns))  # few users: the sketch is exact as well
        got.collect()
        scans = scan_metrics(got)
        assert len(scans) == 1 and scans[0]["numPartitions"] == n
    reports = spark.createDataFrame([("k1",)], "topic string")
    assert told(feedback.window_queue(spark, root, reports, since)) == told(feedback.research_queue(df, reports, since))


def test_sketches_are_close(spark, tmp_path):
    df = spark.range(40_000).select(F.date_add(F.lit(DAY), (F.col("id") % 5).cast("int")).alias("date"), F.lit("hot_click").alias("feedback_type"), F.lit("k").alias("keyword"), (F.col("id") % 13_000).cast("string").alias("open_id"))
    feedback.write_daily(df, str(tmp_path))
    exact, rough = (feedback.window_users(spark, str(tmp_path), F.lit(DAY), a).first()["users"] for a in (False, True))
    assert exact == 13_000 and abs(rough - exact) < 0.03 * exact


# --- scans


def test_scan_is_pruned(spark, tmp_path):
    df = spark.range(60_000).select(F.date_add(F.lit(DAY), (F.col("id") % 6).cast("int")).alias("date"), F.concat(F.lit("u"), F.col("id")).alias("url"), (F.col("id") % 100).cast("int").alias("score"))
    path = str(tmp_path / "t")
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        tables.write_scannable(df, path, "date", ("score",), ("url",))
    finally:
        spark.conf.unset("parquet.block.size")
    laid = spark.read.parquet(path)
    one = tables.scan(laid, date=F.lit(days(2)))
    assert one.count() == 10_000
    one.collect()
    assert scan_metrics(one)[0]["numPartitions"] == 1
    key = tables.scan(laid, date=F.lit(days(2)), url="u20000")
    assert [r["url"] for r in key.collect()] == ["u20000"]
    # the filter of the key leaves most row groups unread, and all of them if no row has it
    assert scan_metrics(key)[0]["numOutputRows"] < 5000
    none = tables.scan(laid, date=F.lit(days(2)), url="u20001x")
    assert none.collect() == [] and scan_metrics(none)[0]["numOutputRows"] < 1500
    score = tables.scan(laid, date=F.lit(days(2)), score=14)
    assert len(score.collect()) == 200 and scan_metrics(score)[0]["numOutputRows"] < 5000


# --- keyword tables


def test_keyword_table_is_keyword_match(spark):
    words = ["td", "塔防", "e3", "a.b", " Rogue ", "", None, "TD", "c++", "防", "ß", "new york"]
    texts = ["TD game", "ATD", "td_x", "塔防 td", "e3x", "xe3", "a.b", "axb", "rogue", "rogues", "C++!", "STRAßE", "in New York", "new yorker", "", None, "td" * 50 + " td"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in keywords.keyword_hits(df, spark.createDataFrame([(w,) for w in words], "word string"), F.col("text"), "id").collect():
        got.setdefault(r["id"], []).append(r["word"])
    known = sorted({w.strip().lower() for w in words if w and w.strip()})
    flags = df.select("id", *[S.keyword_match(F.col("text"), (w,)).alias(f"w{i}") for i, w in enumerate(known)]).collect()
    assert {k: sorted(v) for k, v in got.items()} == {r["id"]: hit for r in flags if (hit := [w for i, w in enumerate(known) if r[f"w{i}"]])}


def test_keyword_table_of_many_words(spark):
    """50,000 words in one scan of the texts, and the same rows where lists are cut."""
    words = spark.range(50_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"))
    texts = spark.range(300).select("id", F.concat_ws(" ", F.lit("x"), F.concat(F.lit("W"), F.translate((F.col("id") * 331).cast("string"), "0123456789", "abcdefghij")), F.lit("wab!")).alias("text"))
    got = keywords.keyword_hits(texts, words, F.col("text"), "id")
    assert len(re.findall("Range|Scan", got._jdf.queryExecution().executedPlan().toString())) == 1
    names = {r["word"] for r in words.collect()}
    want = {(r["id"], w) for r in texts.collect() for w in r["text"].lower().replace("!", "").split() if w in names}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in keywords.keyword_hits(texts, words, F.col("text"), "id", most=20_000).collect()} == want
    flagged = keywords.flag_rows(texts, words.limit(0), F.col("text"), "id", "hit")
    assert flagged.count() == 300 and flagged.where("hit").count() == 0
    topics = spark.createDataFrame([("one", "wab"), ("one", "x"), ("two", "none")], "topic string, word string")
    assert {tuple(r) for r in keywords.topic_rows(texts.limit(3), topics, F.col("text"), "id").collect()} == {(0, "one"), (1, "one"), (2, "one")}


# --- limits by group


def test_best_of(spark):
    """A limit by group, ties by the next column, nulls last, groups of any size, no task with a whole group."""
    df = spark.range(5000).select(F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 5 % 2).cast("int")).alias("g"), (F.col("id") * 37 % 101).cast("int").alias("score"), F.col("id").alias("url"))
    df = df.withColumn("score", F.when(F.col("url") % 11 == 0, None).otherwise(F.col("score")))
    limit = F.when(F.col("g").isNull(), 3).when(F.col("g") == 0, 0).otherwise(7)
    got = sorted((str(r["g"]), r["place"], r["url"]) for r in tables.best_of(df, ["g"], [tables.falling("score"), "url"], limit).collect())
    want = []
    for g, n in ((None, 3), (1, 7)):
        own = sorted((r for r in df.collect() if r["g"] == g), key=lambda r: (r["score"] is None, -(r["score"] or 0), r["url"]))
        want += [(str(g), i, r["url"]) for i, r in enumerate(own[:n], 1)]
    assert got == sorted(want)
    many = tables.best_of(df.where("g = 1"), ["g"], [tables.falling("score"), "url"], F.lit(100_000))
    assert many.count() == df.where("g = 1").count()


def test_no_whole_date_in_one_window(spark):
    """Windows over a date alone are cut by Spark before the shuffle."""
    i, word = F.col("id"), F.col("id").cast("string")
    day = F.date_add(F.lit(DAY), (i % 2).cast("int")).alias("date")
    names = [word.alias(c) for c in ("url", "headline", "title", "keyword", "query")]
    n = spark.range(100).select(day, *names, F.concat(F.lit("s"), i % 3).alias("source"), *[i.cast("int").alias(c) for c in ("score", "slot", "place")], (i / 3).cast("decimal(10,2)").alias("weight"), F.lit("alpha").alias("engine"))
    games = n.select("date", F.col("url").alias("game_name"), F.lit("other").alias("track_class"), F.col("score").alias("downloads"))
    plans = {
        "keywords": hot.pick_keywords(n), "local": hot.local_candidates(n, F.col("score"), F.col("score") > 50), "dedup": hot.dedup_against(n.limit(5), n, n.limit(0)),
        "games": report.choose_new_games(games), "engine": hot.first_engine(n, ("alpha",)),
    }
    for name, df in plans.items():
        assert df.count() > 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        whole = re.findall(r"\bWindow \[.*\], \[date#\d+(?:, \([^\]]*)?\], \[", plan)
        assert len(whole) * 2 <= plan.count("WindowGroupLimit"), (name, plan)  # a partial and a final cut each
        assert not re.search(r"windowspecdefinition\([a-z]+#\d+ (?:ASC|DESC)", plan), name  # nor without any partition


# --- votes


def test_one_vote_for_ever(spark, tmp_path):
    schema = "ts timestamp, news_url string, open_id string, feedback_type string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        votes = jobs.one_vote(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        votes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(map(str, r))[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    at = dt.datetime(2024, 1, 1)
    first = run([(at, "u", "a", "up"), (at, "u", "a", "up"), (at, "u", "a", "down"), (at, "", "a", "up"), (at, "u", None, "up")])
    assert first == [("", "a", "up"), ("u", "None", "up"), ("u", "a", "down"), ("u", "a", "up")]
    # a year later, after another run has moved on: repeats go, blank ids and new votes pass
    run([(at + dt.timedelta(300), "v", "b", "up")])
    again = run([(at + dt.timedelta(365), "u", "a", "up"), (at + dt.timedelta(1), "u", "a", "down"), (at, "", "a", "up"), (at + dt.timedelta(365), "u", "b", "up")])
    assert again == sorted([*first, ("v", "b", "up"), ("", "a", "up"), ("u", "b", "up")])
