"""What the reviews of a round found."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankpulse.operators import links, news, report
from rankpulse.sources import pages


def test_open_references_stay():
    line = "A line that is long enough, cut at &amp"
    html = f"<html><body><article><h1>{line}</h1><p>Fish &amp; chips &copy; &#65;&#x42; &ampre; &unknown; &copy 2024 &</p></article></body></html>"
    assert pages.body_text(html) == f"{line}\nFish & chips © AB &ampre; &unknown; &copy 2024 &"
    assert pages.body_text("<p>Without a tag behind it: R&D&amp") == "Without a tag behind it: R&D&amp"


def test_fresh_games_of_one_name(spark):
    """Rows of a name don't meet each other: of one name they were 4 * 10^10 here."""
    n = 200_000
    games = spark.range(n).selectExpr("date_add(date '2024-01-01', cast(id % 30 as int)) as date", "'all' as game_name", "id % 9 = 0 as is_port")
    few = spark.sql("""select * from values (date '2024-01-01', 'a', true), (date '2024-01-20', 'a', true), (date '2024-01-01', 'b', false), (date '2024-01-09', 'b', false),
        (date '2024-01-16', 'b', false), (date '2024-01-05', 'c', false), (date '2024-01-06', 'c', false), (date '2024-01-05', null, true), (date '2024-01-06', null, true),
        (null, 'd', false), (date '2024-01-05', 'e', null), (date '2024-01-20', 'e', null), (date '2024-01-21', 'e', null) as t(date, game_name, is_port)""")
    told = spark.sql("select * from values ('c', date '2024-01-05'), ('d', date '2024-01-01') as t(game_name, date)")
    fresh = report.fresh_games(games.union(few), told)
    assert "Join Inner" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    kept = fresh.groupBy("date", "game_name").count().collect()
    assert {(str(r.date)[-2:], r.game_name): r["count"] for r in kept} == {
        ("01", "all"): n // 30 + 1, ("01", "a"): 1, ("01", "b"): 1, ("09", "b"): 1, ("05", "c"): 1, ("05", None): 1, ("06", None): 1, ("ne", "d"): 1, ("05", "e"): 1, ("20", "e"): 1
    }


@pytest.mark.parametrize("rows", (8192, 7))
def test_links_in_blocks(spark, monkeypatch, rows):
    """Links of one block and of many are those of all pairs, and rows don't meet on their words before."""
    monkeypatch.setattr(links, "ROWS", rows)
    monkeypatch.setattr(links, "STRIP", 5)
    monkeypatch.setattr(links, "DENSE", 20)
    monkeypatch.setattr(links, "MATCHES", 30)
    random = np.random.default_rng(3)
    some = lambda n: sorted({f"w{int(x)}" for x in random.exponential(6, random.integers(n))})
    items = [(day, f"u{i}", some(12), some(3), some(4)) for day in (1, 2) for i in range(40)] + [(3, "v1", ["x"], [], []), (3, "v2", ["x"], [], []), (None, "v3", ["x"], [], []), (3, "v4", None, None, None)]
    df = spark.createDataFrame(items, "day int, id string, t array<string>, e array<string>, h array<string>")
    want = {}
    for d, a, *x in items[:-2]:
        for e, b, *y in items[:-2]:
            common, either = ([len(f(set(p), set(q))) for p, q in zip(x, y)] for f in (set.intersection, set.union))
            if d == e and a < b and (common[0] and 100 * common[0] >= 15 * either[0] or common[1] >= 2 or common[2] >= 2) and not {"w9"} & set(x[0]) & set(y[0]):
                want[d, a, b] = common[0], either[0]
    rules = [(F.col("t"), 0.15, 1), (F.col("e"), 0, 2), (F.col("h"), 0, 2)]
    got = links.word_links(df, ["day"], rules, F.filter("t", lambda w: w == "w9"))
    assert [tuple(r) for r in sorted(got.collect())] == [(*k, *v) for k, v in sorted(want.items())]
    story = news.same_story_pairs(df, F.col("t"), ["day"])
    assert "token" not in story._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("dense, matches", ((0, 1), (3, 5), (10**9, 7)))
def test_common_words(monkeypatch, dense, matches):
    monkeypatch.setattr(links, "DENSE", dense)
    monkeypatch.setattr(links, "MATCHES", matches)
    random = np.random.default_rng(4)
    words = [sorted({f"w{int(x)}" for x in random.integers(30, size=random.integers(20))}) for _ in range(25)]
    a, b = np.arange(0, 25, 2), np.arange(5, 20)
    want = [[len(set(words[i]) & set(words[j])) for j in b] for i in a]
    assert links._common(pa.array(words, pa.list_(pa.string())), a, b).tolist() == want


def test_story_pairs_come_once(spark):
    """A pair of several marks is made once, not once a mark and then made distinct."""
    df = spark.createDataFrame([(1, x, "Alpha Beta gamma went to Delta", "Alpha met Beta") for x in "abc"], "date int, id string, s string, h string")
    got = news.story_pairs(df, F.col("s"), F.col("h"), ["date"])
    assert sorted((r.a, r.b) for r in got.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_same_day_pairs_of_several_names(spark):
    df = spark.createDataFrame([("2024-01-01", "a", "《Y》《X》 great update news arrives"), ("2024-01-01", "b", "《X》《Y》《Z》 great update today"), ("2024-01-01", "c", "《Y》 update great"), ("2024-01-02", "d", "《Y》 update great")], "date string, id string, headline string")
    got = news.same_day_pairs(df)
    assert sorted((r.a, r.b) for r in got.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_drop_same_day_without_pairs(spark, monkeypatch):
    """The choice that takes up items best first, of items with several names, without a table of pairs."""
    random = np.random.default_rng(6)
    pick = lambda of, n: " ".join(random.choice(of, n))
    items = [(f"2024-01-0{i % 2 + 1}", f"u{i:02}", [1, 2, 3, None][int(random.integers(4))], pick(["《X》", "《Y》", "《Z》"], random.integers(3)) + " " + pick(["alpha", "bravo", "delta", "gamma", "kappa", "omega"], 3)) for i in range(60)]
    df = spark.createDataFrame(items, "date string, id string, place int, headline string")
    linked, kept = {frozenset((r.a, r.b)) for r in news.same_day_pairs(df).collect()}, []
    for _, i, _, _ in sorted(items, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
        if not any(frozenset((i, k)) in linked for k in kept):
            kept.append(i)
    monkeypatch.setattr(news, "word_links", None)
    monkeypatch.setattr(links, "ROWS", 5)
    assert 0 < len(kept) < 60 and sorted(r.id for r in news.drop_same_day_items(df).collect()) == sorted(kept)


def test_cross_validate_shuffles_no_whole_text(spark):
    """Of a snippet only the head that is given back is in what the rows of a claim are shuffled with."""
    claims = spark.createDataFrame([(1, "Alpha Studio released Bravo", "https://a.org/1")], "claim_id int, claim string, url string")
    results = spark.createDataFrame([(1, i, f"https://b.org/{i}", "Nothing", "x" * 5000) for i in range(5)], "claim_id int, place int, url string, title string, snippet string")
    got = news.cross_validate(claims, results)
    assert [len(x["snippet"]) for x in got.first()["unrelated"]] == [200] * 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Window")]  # windows shuffle what is below them
    assert "substring(coalesce(snippet" not in above and "substring(coalesce(snippet" in plan


def test_words_in_patterns(spark):
    """The pattern of a list finds what its plain alternatives find, whatever begins and follows its words."""
    import re

    from rankpulse.functions import scalars as S

    words = ("ab", "a", "é!", "b.c", "-x", "]^", "版号", "版本", "𝄞a", "ǅz", "x\\d", "ai")
    texts = ["", "ab", "xaby", "é", "é!", "e!", "bxc", "b.c", "a-x", "]", "]^", "^", "版", "号版", "版号", "新版本", "𝄞", "𝄞a", "ǅz", "ǅ", "x\\d", "x1", "AI", "-", "b", "\n-x\n", "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in (words, words[2:], ("版号", "版本"), ("ab", ""), ("-x", "]^")):
        got = [r.hit for r in df.select(S.contains_any(F.col("t"), some).alias("hit")).collect()]
        assert got == [any(w in t for w in some) for t in texts]
    plain = lambda t: re.search(r"(^|[^a-z0-9_])(ai|td|a)([^a-z0-9_]|$)", t.lower()) is not None or "版号" in t
    told = [*texts, "td", "TD", "atd", "td_", "x td\n", "td-ai", "a", "1a", "aa a", "taai"]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert [r.hit for r in df.select(S.keyword_match(F.col("t"), ("ai", "TD", "a", "版号")).alias("hit")).collect()] == [plain(t) for t in told]


def test_hot_scores_lower_a_text_once(spark):
    """Of a text of any number of words one lower-cased copy is made: the plan named it for each use before."""
    from rankpulse.functions import scalars as S

    df = spark.createDataFrame([("AI 引擎 Steam", "公测 肉鸽"), ("AI", None), (None, None), ("AI 股票 steam", ""), ("AI steam offer", ""), ("Steam NPC AIGC", "投资 投资")], "t string, s string")
    out = df.select(S.hot_score(F.col("t"), F.col("s"), F.lit("https://a.org/b")).alias("score"))
    assert [r.score for r in out.collect()] == [4 + 6 + 2, 2, -999, -999, -999, 8 + 3]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_scores_are_worked_out_once(spark):
    """A filter on a score doesn't work it out a second time."""
    from rankpulse.operators import hot

    df = spark.createDataFrame([("u1", "one"), ("u2", "three"), ("u3", None)], "url string, title string")
    kept = hot.intel(df, F.length(F.regexp_replace("title", "e", "")) - 3)
    assert {(r.url, r.score) for r in kept.collect()} == {("u2", 0)}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_block_pairs_are_tasks_of_their_own(spark, monkeypatch):
    """Pairs of blocks of one group are dealt to all parts of a shuffle; they stayed in the part of their group before."""
    monkeypatch.setattr(links, "ROWS", 10)
    df = spark.range(200).selectExpr("1 as day", "id", "array(cast(id % 50 as string), 'w') as words")
    rows = links.word_links(df, ["day"], [(F.col("words"), 0, 2)]).withColumn("part", F.spark_partition_id()).collect()
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in range(200) for b in range(a + 50, 200, 50)} and len(rows) == 300
    assert len({r.part for r in rows}) > 1


def _stored_columns(path):
    import pyarrow.parquet as pq

    groups = [f.row_group(g) for f in (pq.ParquetFile(p).metadata for p in path.glob("*.parquet")) for g in range(f.num_row_groups)]
    return [(g.num_rows, {g.column(c).path_in_schema: g.column(c) for c in range(g.num_columns)}) for g in groups]


def test_files_of_pairs_are_of_few_ids(spark, tmp_path, monkeypatch):
    """A task's pairs are of so few ids that a dictionary holds them; those of all blocks met in a few tasks, whose ids were written out pair by pair."""
    monkeypatch.setattr(links, "ROWS", 10)
    df = spark.range(200).selectExpr("date '2024-01-01' as date", "concat('https://a.org/', id) as id", "concat('《X》 great update ', id % 7) as headline")
    news.same_day_pairs(df).write.option("parquet.dictionary.page.size", "2000").parquet(f"{tmp_path}/out")
    stored = _stored_columns(tmp_path / "out")
    assert sum(n for n, _ in stored) == 200 * 199 / 2
    assert not any("PLAIN" in c.encodings for _, columns in stored for c in columns.values())


def test_pairs_of_copies_are_stored_small(spark, tmp_path):
    """Pairs of rows of equal words take much less than a place in a dictionary each, which is 10 bits here."""
    df = spark.range(1000).selectExpr("date '2024-01-01' as date", "cast(id * 7919 % 1000 as string) as id", "concat('《X》 great ', element_at(array('red', 'blue', 'green'), cast(id % 3 + 1 as int)), ' update') as headline")
    news.same_day_pairs(df).coalesce(1).write.parquet(f"{tmp_path}/out")
    stored = _stored_columns(tmp_path / "out")
    pairs = sum(n for n, _ in stored)
    assert pairs == 1000 * 999 / 2 == news.same_day_pairs(df).where("a < b").distinct().count()
    assert sum(c.total_compressed_size for _, columns in stored for c in columns.values()) < pairs / 2


@pytest.mark.parametrize("words", (800_000, 40))
def test_blocks_are_ranges_of_ids(spark, monkeypatch, words):
    """Of two blocks all ids of one come before those of the other, also where words and not rows make the blocks."""
    monkeypatch.setattr(links, "ROWS", 50)
    monkeypatch.setattr(links, "WORDS", words)
    df = spark.range(300).selectExpr("if(id < 290, 1, 2) as day", "concat('u', id) as id", "array('v', 'w', cast(id as string)) as words")
    dealt = links._by_blocks(df, ["day"], ["id"], [(F.col("words"), 0, 2)], None)
    seen = dealt.applyInArrow(lambda key, rows: rows.select(["day", "id", "_i", "_j", "_side"]), "day int, id string, _i int, _j int, _side boolean").collect()
    of = {}
    for r in seen:
        of.setdefault((r.day, r._j if r._side else r._i), set()).add(r.id)
    assert sorted(x for ids in of.values() for x in ids) == sorted(f"u{i}" for i in range(300))
    blocks = [of[k] for k in sorted(of) if k[0] == 1]
    assert len(blocks) == 6 if words > 40 else len(blocks) > 15
    assert all(max(x) < min(y) for x, y in zip(blocks, blocks[1:]))
    got = links.word_links(df, ["day"], [(F.col("words"), 0, 2)], sizes=False).collect()
    assert len(got) == len({(r.a, r.b) for r in got if r.a < r.b}) == (290 * 289 + 10 * 9) / 2


def test_charts_need_no_grid(spark, tmp_path, monkeypatch):
    """A value counts on its day and the six after it that any event has; no grid of days by users is joined and windowed for it."""
    from rankpulse import fixtures

    days = ["01-01", "01-02", "01-03", "01-05", "01-06", "01-07", "01-09", "01-10"]
    rows = [(f"2024-{d} 10:00:00", 2, "view", 1.0 if d == "01-01" else 0.0) for d in days] + [("2024-01-10 11:00:00", 3, "view", 2.5), ("2024-01-10 12:00:00", None, "view", 9.0), ("2024-01-10 12:00:00", 3, None, 9.0)]
    spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, "t", "n", "b")], "p_partkey long, p_type string, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(fixtures, "stored", lambda df, what: df)
    charts = fixtures.rankings(spark, str(tmp_path))
    assert {(str(r.date)[5:], r.platform, r.rank, r.bundle_id, r.game_name) for r in charts.collect()} == {(d, "iOS", 1, "2", "n 2") for d in days[:7]} | {("01-10", "Android", 1, "3", "item 3")}
    assert "RowFrame, -6" not in charts._jdf.queryExecution().optimizedPlan().toString()
