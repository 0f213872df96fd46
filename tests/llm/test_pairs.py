import re
from functools import partial

import numpy as np
import pytest

from rankpulse.llm import near_dup, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n):
    """component of each place in rows"""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    out = [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "two words"), (906, "Two words"), (907, "x " * 9000)]
    for g in range(6):  # groups whose copies are linked to the first text more than to each other
        base = list(random.choice(words, 120))
        for k in range(30):
            copy = list(base)
            for at in random.integers(0, 120, k % 9):
                copy[at] = f"e{random.integers(10**6)}"
            out.append((int(1000 * g + k + 10), " ".join(copy)))
    common = " ".join(random.choice(words, 60))
    out += [(10_000 + i, common + " " + " ".join(random.choice(words, 60))) for i in range(60)]
    return out + out[20:25]


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, rows, n):
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, cid int, key string").repartition(4)
    got = near_dup.near_duplicates(df, n).collect()
    group, sets = brute(rows, n)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    want = sorted((i, len(s), least[g] if s else i) for (i, _), g, s in zip(rows, group, sets, strict=True))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("limit, size", [("BLOCK", 3), ("BLOCK_BYTES", 4000), ("MET", 2)])
def test_blocks_change_nothing(spark, rows, monkeypatch, limit, size):
    """Blocks so small, in members or in bytes, that clusters span many of them, and leaders of many salts."""
    monkeypatch.setattr(near_dup, limit, size)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    group, sets = brute(rows, 2)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    got = near_dup.near_duplicates(df, 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, least[g] if s else i) for (i, _), g, s in zip(rows, group, sets, strict=True))


@pytest.mark.parametrize("percent", [60, 80, 95, 100])
def test_size_classes_lose_no_link(spark, monkeypatch, percent):
    """One cluster of sets whose sizes are in every relation, the exact bound included: links as all pairs give them, with fewer copies than all blocks would take."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    random = np.random.default_rng(4)
    sets = []
    for n in [4, 7, 8, 11, 12, 16, 19, 57, 76, 95, 96, 399, 400]:
        own = np.unique(random.integers(1, 2**62, 2 * n).astype(np.uint64))
        sets += [np.sort(own[:m]) for m in {n, n + 1, n * 100 // percent, n * 100 // percent + 1, min(2 * n, n * 5 // 3)}]
    sets = [x for i, x in enumerate(sets) if not any(np.array_equal(x, y) for y in sets[:i])]
    members = spark.createDataFrame([(0, i, i, len(x), x.tobytes()) for i, x in enumerate(sets)], "cluster long, cid long, label long, n_shingles long, data binary")
    copies, in_arrow = [], near_dup.in_arrow

    def seen(df, run, schema):
        copies.append(df.count())
        return in_arrow(df, run, schema)

    monkeypatch.setattr(near_dup, "in_arrow", seen)
    found = [tuple(r) for r in near_dup._compared(members, partial(near_dup._Linked, percent), percent / 100).collect()]
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
    assert all(alike(sets[a], sets[b]) for a, b in found)

    def groups(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            of = [of[a] if g == of[b] else g for g in of]
        return [of.index(g) for g in of]

    assert groups(found) == groups([(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    assert copies[0] < len(sets) * (len(sets) / 4) * 0.7


def test_tiny_sets(spark, monkeypatch):
    """Sets too small to be linked with another one share no bucket; those of four and five shingles do."""
    rows = [(i, f"common phrase w{i}") for i in range(40)] + [(50, "a b c d e"), (51, "a b c d e f"), (52, "a b c d"), (53, "Common phrase w3"), (54, "common phrase")]
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    group, sets = brute(rows, 2)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    made, exploded = [], near_dup._exploded
    monkeypatch.setattr(near_dup, "_exploded", lambda classes: made.append(classes.count()) or exploded(classes))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, least[g]) for (i, _), g in zip(rows, group, strict=True))
    assert made == [2] and {r["component_id"] for r in got if r["doc_id"] in (51, 53)} == {50, 3}


def test_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z z z"), (None, None)], "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(df, 2).collect(), key=str)
    assert [(r["component_id"], r["kept"]) for r in got if r["n_shingles"] == 3] == [(5, True), (5, False)] or {(r["component_id"], r["kept"]) for r in got if r["n_shingles"] == 3} == {(5, True), (5, False)}
    assert all(r["kept"] for r in got if r["n_shingles"] in (0, 1))
    assert near_dup.near_duplicates(df.limit(0), 2).count() == 0


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = near_dup.keep_one(df, 5)
    group, sets = brute(rows, 5)
    least = {}
    for i, (row, g, s) in enumerate(zip(rows, group, sets, strict=True)):
        least[g if s else -1 - i] = min(least.get(g if s else -1 - i, row[0]), row[0])
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_estimates_are_near():
    random = np.random.default_rng(5)
    probes = near_dup._probes()
    for size, share in ((2000, 0.9), (300, 0.8), (40, 0.6), (500, 0.0)):
        errors = []
        for _ in range(20):
            x = random.integers(0, 2**63, size * 2).astype(np.uint64)
            k = int(round(size * 2 * share / (1 + share)))
            a, b = np.unique(x[:size]), np.unique(np.concatenate([x[:k], x[size : 2 * size - k]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            regs = near_dup.registers([a, b], probes)
            errors.append(near_dup.estimate(regs[:1], regs[1:], *(near_dup._shares(np.array([len(x)])) for x in (a, b)))[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15


def test_top_k(spark):
    random = np.random.default_rng(2)
    vectors = [(i, random.normal(size=24).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(30)]  # ties
    odd = [(1000, None), (1001, [None] * 24), (1002, [float("nan")] * 24), (None, vectors[0][1]), (1050, [1.0, 2.0]), (1051, [2.0, 2.0]), (1052, []), (3, vectors[3][1])]
    df = spark.createDataFrame([(*v, 1) for v in vectors + odd], "vec_id long, embedding array<float>, score int").repartition(5)
    got = {}
    for r in top_k.top_k(df, (df.vec_id % 50 == 0)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    data = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    for q in range(0, 430, 50):
        # vec_id 3 stands there twice
        best = sorted((-int(data[q] @ data[i]), i) for i in [*data, 3] if i != q)[:5]
        assert [(-s, i) for _, i, s in sorted(got[q])] == best
    assert [(i, s) for _, i, s in got[1050]] == [(1051, 256 * 512 + 512 * 512)]
    assert 1000 not in got and top_k.top_k(df.limit(0), df.vec_id % 50 == 0).count() == 0


@pytest.mark.parametrize("step, share", [(7, 4000), (4096, 32 << 20)])
def test_top_k_small_parts(spark, monkeypatch, step, share):
    """Floors carried from part to part, many shares, scores beyond doubles, a repeated query id with a bad twin."""
    monkeypatch.setattr(top_k, "STEP", step)
    monkeypatch.setattr(top_k, "SHARE_BYTES", share)
    monkeypatch.setattr(top_k, "BLOCK", 16)
    random = np.random.default_rng(3)
    vectors = [(i, random.normal(size=20).tolist()) for i in range(300)] + [(300 + i, (1e6 * random.normal(size=20)).tolist()) for i in range(3)]
    bad = [(50, None), (100, [float("inf")] * 20), (150, [None, 1.0])]
    df = spark.createDataFrame(bad + vectors + bad, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in top_k.top_k(df, df.vec_id % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    data = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}
    assert set(got) == {0, 50, 100, 150, 200, 250, 300}
    for q, rows in got.items():
        assert sorted(rows) == sorted((-sum(a * b for a, b in zip(data[q], data[i])), i) for i in data if i != q)[:5]


def test_bounds_are_bounds():
    random = np.random.default_rng(4)
    a, b = random.normal(size=(20, 50)), random.normal(size=(30, 50))
    for segments in top_k.LEVELS:
        n, qm, qd = top_k.statistics(a, segments)
        _, xm, xd = top_k.statistics(b, segments)
        assert ((qm * n) @ xm.T + qd @ xd.T >= a @ b.T - 1e-9).all()


@pytest.mark.parametrize("spread, step", [(0.1, 512), (0.1, 64), (None, 512)])
def test_bounds_prune(monkeypatch, spread, step):
    """Of vectors in clusters nearly no pair is computed; of vectors without structure all results are right as well."""
    monkeypatch.setattr(top_k, "STEP", step)
    random = np.random.default_rng(7)
    vectors = random.normal(size=(6000, 64))
    if spread:
        vectors = np.cumsum(random.normal(size=(50, 64)), axis=1)[random.integers(0, 50, 6000)] + spread * vectors
    data = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    at, tally = np.arange(0, 6000, 50), [0] * 5
    found = top_k.best(data[at], at, top_k.Share(np.arange(6000), data), 5, tally)
    scores = data[at] @ data.T
    scores[np.arange(len(at)), at] = -(2**62)
    want = [(i, int(x), int(scores[i, x])) for i in range(len(at)) for x in np.lexsort((np.arange(6000), -scores[i]))[:5]]
    assert list(zip(*(c.tolist() for c in found), strict=True)) == want
    assert tally[0] == 120 * 6000 and (spread is None or tally[-1] < tally[0] / 20)


def test_huge_components(spark):
    """What a 64-bit score can't come from takes no part; scores beyond 64 bits are held to them."""
    rows = [(0, [1.0, 2.0]), (1, [1e300, 0.0]), (2, [3.0, 1.0]), (3, [2.0**53, 1.0]), (50, [2.0**53, 1.0]), (4, [-(2.0**53), 0.0]), (5, [-1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in top_k.top_k(df, df.vec_id % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == {0, 50} and set(got[0]) == {2, 3, 4, 50} and set(got[50]) == {0, 2, 3, 4}
    assert got[50][3] == 2**63 - 1 and got[50][4] == -(2**63) and got[0][2] == 256 * 768 + 512 * 256
