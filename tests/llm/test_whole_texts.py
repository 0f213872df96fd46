"""Numbers of rows, lost texts and scores against a brute-force model."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankpulse.llm import katz, near_dup


def test_numbers_of_rows_stay(spark, tmp_path, monkeypatch):
    """Each job splits the files of the documents in another way."""
    rows = [(g, " ".join(f"w{(g // 3) * 1000 + i}" for i in range(40)) + (f" x{g}" if g % 3 else "")) for g in range(60)]
    for i in range(20):  # the copies of a group stand in different files
        spark.createDataFrame(rows[i::20], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    write, calls = near_dup.stored, []

    def stored(df, what):
        out = write(df, what)
        calls.append(what)
        spark.conf.set("spark.sql.files.openCostInBytes", ("1", "100000000")[len(calls) % 2])
        return out

    monkeypatch.setattr(near_dup, "stored", stored)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        kept = [r["doc_id"] // 3 for r in near_dup.keep_one(spark.read.parquet(f"{tmp_path}/docs"), 5).collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(kept) == list(range(20))


def test_lost_texts_are_an_error(spark):
    classes = spark.createDataFrame([(1, 7, b"another text's")], "cid long, rep long, digest binary")
    with pytest.raises(RuntimeError, match="1 classes are wanted, 0"):
        near_dup._sets_of(classes.select("cid"), classes, spark.createDataFrame([(7, "a b c")], "doc_id long, text string"), 2, "doc_id", "text")


def katz_scores(train, texts, order):
    """The Katz backoff score of each text by brute force."""
    split = lambda t: ["<"] * (order - 1) + t.lower().split() + [">"]
    grams = lambda t, k: [tuple(w[i - k + 1 : i + 1]) for w in [split(t)] for i in range(order - 1, len(w))]
    p, weight = {}, {}
    for k in range(1, order + 1):
        c = Counter(g for t in train for g in grams(t, k))
        d = katz.good_turing(Counter(c.values()))
        dc, total, own, below = {g: d.get(n, 1) * n for g, n in c.items()}, Counter(), Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            own[g[:-1]] += dc[g]
            below[g[:-1]] += p[g[1:]] if k > 1 else 0
        extra = 0.5 if k == 1 else 0
        scale = {h: min(1, (n + extra) / (n + 1) * n / own[h]) / n for h, n in total.items()}
        p |= {g: dc[g] * scale[g[:-1]] for g in c}
        weight |= {(k, h): (1 - scale[h] * own[h]) / (1 - below[h]) for h in total}

    def chance(g):
        if g in p:
            return p[g]
        return weight[1, ()] if len(g) == 1 else weight.get((len(g), g[:-1]), 1) * chance(g[1:])

    return [sum(math.log10(chance(g)) for g in grams(t, order)) for t in texts]


@pytest.mark.parametrize("order, fitted, asked", [(2, 8 << 20, 8 << 20), (3, 8 << 20, 8 << 20), (2, 20, 8 << 20), (3, 8 << 20, 20), (3, 20, 12)])
def test_katz_scores(spark, monkeypatch, order, fitted, asked):
    """Fitting and scoring give the same, however many buckets each has; the catalog is left as it was."""
    random = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in random.zipf(1.6, 12) if x < 30) for _ in range(60)] + ["", "unseen words", "w1 unseen w1"]
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "row long, text string")
    monkeypatch.setattr(katz, "BUCKET_KEYS", fitted)
    model = katz.fit(rows(texts[:40]), order)
    monkeypatch.setattr(katz, "BUCKET_KEYS", asked)
    got = {r["row"]: r["score"] for r in katz.score(rows(texts), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(katz_scores(texts[:40], texts, order), abs=1e-9)
    buckets = {r[0] for r in model.counts(spark).select("bucket").collect()}
    assert (len(buckets) > 8) == (fitted == 20) and (max(buckets) > 7) == (fitted == 20)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_chunks_")]


def test_a_failed_katz_run_leaves_no_table(spark, monkeypatch):
    def broken(*_):
        raise ValueError("no answers")

    monkeypatch.setattr(katz, "_answered", broken)
    with pytest.raises(ValueError, match="no answers"):
        katz.fit(spark.createDataFrame([(0, "a b")], "row long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_chunks_")]
