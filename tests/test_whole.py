"""The whole job where a query or an operator once did less of it."""

import datetime as dt
import re

import numpy as np

from pyspark.sql import GroupedData

from rankpulse import plans
from rankpulse.operators import news, scoring


def test_whole_texts(spark, tmp_path):
    """What stands after the first 300 or 400 characters counts, and bodies over 500 characters have their branch."""
    text = "Plain words stand here.\n" + "Plain words stand here. " * 25 + "《深空》 zebra 2024 and 17 and 18"
    spark.createDataFrame([(0, text, "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    at = lambda name: plans.QUERIES[name](spark, str(tmp_path)).where("id = 1000").first()
    assert at("s2_game_names")["names"] == "深空" and "zebra" in at("s3_topic_words")["words"].split("|")
    assert at("s7_body_signals")["facts"] == 4 and at("s8_signal_score")["signal"] == 40 + 5 + 5
    assert at("s27_question")["question"] == text
    whole = plans.QUERIES["f5_set_sizes"](spark, str(tmp_path)).first()
    assert (whole["common"], whole["either"]) == (4, 7)  # plain words stand here; 深空 zebra and


DAY = dt.date(2024, 1, 1)
SCORED = "date date, url string, headline string, source string, score int"


def greedy(rows, pairs, far, total=7):
    """The diverse choice of one date, item by item."""
    rows, chosen = sorted(rows, key=lambda r: (-r[4], r[1])), []
    game = lambda r: r[2].split("》")[0][1:]

    def fits(r, cap):
        return (
            r not in chosen and sum(c[3] == r[3] for c in chosen) < (2 if r[3] == "Bilibili" else cap) and sum(game(c) == game(r) for c in chosen) < 2
            and not any((c[1], r[1]) in pairs or (r[1], c[1]) in pairs for c in chosen)
        )

    has = lambda: any(c[3] == far for c in chosen)
    for r in rows:
        held = r[3] != far and len(chosen) == total - 1 and not has() and any(x[3] == far for x in rows)
        if len(chosen) < total and not held and fits(r, 3):
            chosen.append(r)
    for only in (True, False):
        for r in rows:
            if len(chosen) < total and (not only or (r[3] == far and not has())) and fits(r, total - 1 if only else 3):
                chosen.append(r)
    return [(i + 1, c[1]) for i, c in enumerate(chosen)]


def test_choice_looks_at_all_rows(spark):
    """One source holds the best 600 rows of a date; what the caps leave room for stands behind them."""
    rows = [(DAY, f"a{i}", f"《a{i}》x", "hot", 2000 - i) for i in range(600)] + [(DAY, f"b{i}", f"《b{i}》x", f"s{i}", 100 - i) for i in range(6)] + [(DAY, "far", "《f》x", "pg", 1)]
    got = scoring.select_diverse(spark.createDataFrame(rows, SCORED), ("pg",)).collect()
    assert sorted((r["slot"], r["url"]) for r in got) == greedy(rows, set(), "pg") and len(got) == 7 and "far" in {r["url"] for r in got}


def test_choice_is_the_greedy_one(spark):
    random = np.random.default_rng(6)
    rows, pairs = [], []
    for d in range(1, 25):
        at = [(dt.date(2024, 1, d), f"u{i}", f"《g{random.integers(2 + d)}》h", ("pg", "Bilibili", "s1", "s2", "s3")[min(4, random.integers(0 if d % 3 else 1, 3 + d % 4))], int(random.integers(30))) for i in range(1 + int(random.integers(40)))]
        rows += at
        pairs += [(r[0], r[1], o[1]) for r in at for o in at if r[1] < o[1] and random.random() < 0.1]
    got = scoring.select_diverse(spark.createDataFrame(rows, SCORED), ("pg",), spark.createDataFrame(pairs, "date date, a string, b string")).collect()
    for day in {r[0] for r in rows}:
        linked = {(a, b) for d, a, b in pairs if d == day}
        assert sorted((r["slot"], r["url"]) for r in got if r["date"] == day) == greedy([r for r in rows if r[0] == day], linked, "pg")


KNOWN = ["原神", "原神国际服", "Kingdom Rush", "Rush", "深空", "星穹铁道", "ab", "abcd", "Zed (beta)", "M"]
NAMES = ["原神", "原神 - 新", "新游 - Kingdom Rush", "x（星穹铁道）", "穹铁", "铁道", "星穹", "深空传说", "AB", "bc", "beta", "new: abcd game", "M", "M - x", "none", "d (b"]


def matched(name):
    """(known, way) by brute force: case counts and known names aren't cut."""
    base, found = re.split(r"\s*[-—–（(]\s*", name, maxsplit=1)[0].strip(), []
    for known in KNOWN:
        if name == known:
            found.append((1, known))
        elif base != name and base == known:
            found.append((2, known))
        elif base != name and min(len(base), len(known)) >= 3 and (base in known or known in base):
            found.append((3, known))
        elif len(known) >= 3 and (known in name or (len(name) >= 2 and name in known)):
            found.append((4, known))
    return min(found, default=None)


def test_full_names_are_found(spark):
    left, known = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (NAMES, KNOWN))
    got = {r["name"]: (r["way"], r["known"]) for r in news.fuzzy_name_join(left, known).collect()}
    assert got == {x: m for x in NAMES if (m := matched(x))} and got["穹铁"] == (4, "星穹铁道") and got["新游 - Kingdom Rush"] == (4, "Kingdom Rush")


def test_same_day_without_a_task_a_date(spark, monkeypatch):
    """The rounds give the choice that takes up items best first, and no date goes to one task as a whole."""
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    random = np.random.default_rng(8)
    items = [(dt.date(2024, 1, d), f"u{i:02}", int(random.integers(4))) for d in (1, 2, 3) for i in range(40)]
    pairs = [(a[0], a[1], b[1]) for a in items for b in items if a[0] == b[0] and a[1] < b[1] and random.random() < (0.02, 0.1, 0.5)[a[0].day - 1]]
    pairs += [(dt.date(2024, 1, 4), f"c{i:02}", f"c{i + 1:02}") for i in range(12)]  # a chain
    items += [(dt.date(2024, 1, 4), f"c{i:02}", i) for i in range(13)]
    linked, kept = {(d, x, y) for d, a, b in pairs for x, y in ((a, b), (b, a))}, []
    for d, i, place in sorted(items, key=lambda r: (r[0], r[2], r[1])):
        if not any((d, i, k) in linked for e, k, _ in kept if e == d):
            kept.append((d, i, place))
    df = spark.createDataFrame(items, "date date, id string, place int")
    got = news.drop_same_day(df, spark.createDataFrame(pairs, "date date, a string, b string"))
    assert sorted(tuple(r[c] for c in ("date", "id", "place")) for r in got.collect()) == sorted(kept)
    assert news.drop_same_day(df, spark.createDataFrame([], "date date, a string, b string")).count() == len(items)


def test_platform_of_every_row(spark):
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES["s1_platform"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").count() and {"iOS", "Android", "PC"} < {r["platform"] for r in got.select("platform").distinct().collect()}
