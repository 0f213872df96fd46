import numpy as np
import pytest

from rankpulse.llm import vector_dups


def brute(rows, threshold=0.93):
    fine = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][2]) / np.linalg.norm(np.array(rows[i][2]) / max(map(abs, rows[i][2]))) / max(map(abs, rows[i][2])) for i in fine}
    near = {i: [j for j in fine if j != i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in fine}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(near.get(i, [])), least, vec_id == least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(5)
    out = []
    for g in range(12):  # chains of near copies, whose ends are further apart than the threshold
        base = random.normal(size=24)
        for k in range(9):
            out.append((100 * g + k + 50, g % 3, base.tolist()))
            base = base + random.normal(size=24) * 0.24
    out += [(2000 + i, i % 3, random.normal(size=24).tolist()) for i in range(150)]
    out += [(3000 + i, 1, [1.0] * 24) for i in range(30)] + [(3100 + i, 1, [2.0] * 23 + [2.0 + i / 100]) for i in range(30)]
    out += [(4000, None, [1.0] * 24), (4001, 1, None), (4002, 1, []), (4003, 1, [0.0] * 24), (4004, 1, [None] + [1.0] * 23), (4005, 1, [float("nan")] + [1.0] * 23)]
    out += [(4006, 1, [float("inf")] + [1.0] * 23), (4007, 1, [1.0] * 8), (4008, 1, [1.0] * 8), (4009, 2, [1e300] * 24), (4010, 2, [1e-300] * 24), (4011, 2, [-1e-300] * 24)]
    return out + [(None, 0, out[0][2]), (None, 7, [1.0, 2.0]), (None, 1, None)] + out[40:43]


@pytest.mark.parametrize("least, step, pairs", [(1024, 1024, 32_768), (8, 5, 3)])
def test_against_brute_force(spark, rows, monkeypatch, least, step, pairs):
    """Blocks and steps of any size give the same rows; clashing names of other columns change nothing."""
    for name, value in (("MIN_ROWS", least), ("STEP", step), ("PAIRS", pairs)):
        monkeypatch.setattr(vector_dups, name, value)
    df = spark.createDataFrame([(*r, 1, "g", 0) for r in rows], "vec_id long, label int, embedding array<double>, cid int, grp string, n_links int").repartition(5)
    got = sorted((tuple(r) for r in vector_dups.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_dups.near_duplicates(df).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bounds_prune_and_hold(dim):
    """No pair above the threshold is ruled out, and few others are left, also where codes are sums over several slices."""
    random = np.random.default_rng(dim)
    base = random.normal(size=(40, dim))
    rows = np.concatenate([base, base + 0.3 * random.normal(size=(40, dim)), random.normal(size=(200, dim)) * 10.0 ** random.integers(-9, 9, (200, 1))])
    tile, tally = vector_dups.Tile(rows), [0, 0, 0]
    whole = tile.unit @ tile.unit.T
    found = {(int(a), int(b)) for p, q in vector_dups.links(tile, None, 0.93, tally) for a, b in zip(p, q, strict=True)}
    assert found == {(i, j) for i in range(280) for j in range(i + 1, 280) if whole[i, j] >= 0.93}
    every = slice(0, 280)
    i, j = vector_dups.possible(tile, tile, every, every, -2.0)
    assert len(i) == 280 * 280
    exact, rough = whole, vector_dups.quantised(tile, tile, every, every) * tile.scale[:, None] * tile.scale
    slack = tile.error[:, None] * (tile.inside + tile.error) + tile.inside[:, None] * tile.error
    assert (np.abs(exact - rough) <= slack + 1e-12).all()
    if dim > 3:
        assert tally[1] <= tally[2] + 40
