import numpy as np
import pytest

from quillstone.llm import subspace as S


def brute(rows, cosine):
    good = []
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float64) if ok else None)
    n = len(rows)
    links = [[] for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= cosine:
                    links[a].append(b)
    comp = list(range(n))
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        comp[a] = min(rows[x][0] for x in seen)
    return {rows[a][0]: (len(links[a]), comp[a], comp[a] == rows[a][0]) for a in range(n)}


@pytest.mark.parametrize("dims,width,chunk,grid", [(64, 16, 3000, None), (64, 16, 3000, 4), (24, 8, 9, 2), (24, 8, 9, 3), (3, 16, 50, None)])
def test_matches_brute_force(spark, dims, width, chunk, grid):
    rng = np.random.default_rng(dims)
    rows, base = [], rng.standard_normal((12, dims))
    for i in range(180):
        v = base[i % 12] + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.25, 0.4]) * (i % 5 > 0)
        rows.append((i * 3, [float(np.float32(x)) for x in v]))
    hot = rng.standard_normal(dims)
    rows += [(1000 + i, [float(np.float32(x)) for x in hot]) for i in range(40)]
    rows += [(1100 + i, [float(np.float32(x)) for x in hot + rng.standard_normal(dims) * 0.08]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * dims), (2003, [float("nan")] + [1.0] * (dims - 1)), (2004, [None] + [1.0] * (dims - 1)), (2005, [float("inf")] * dims), (2006, [1e-30] * dims), (2007, [2.0] * dims), (2008, [1.0] * (dims + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'c' as component_id")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in S.near_duplicates(df, 0.95, width, grid, chunk).collect()}
    assert got == brute(rows, 0.95)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert S.near_duplicates(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")).collect()[0]["kept"]


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (base + rng.standard_normal(16) * 0.05) * scale]) for i, scale in enumerate([1.0, 1e200, 1e-200, 1e300, 1e-300, 3e-310])] + [(9, [float(-x) for x in base * 1e250])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in S.near_duplicates(df).collect()}
    assert got == {**{i: (5, 0) for i in range(6)}, 9: (0, 9)}


def test_rotation_is_orthogonal_and_blocks_lead_with_wide_axes():
    rng = np.random.default_rng(4)
    rows = S.unit(rng.standard_normal((600, 64)) * np.linspace(2, 0.1, 64))
    turn = S.fitted_rotation(rows, 16)
    assert np.allclose(turn.T @ turn, np.eye(64))
    spread = (rows @ turn).std(axis=0)
    assert spread[[0, 16, 32, 48]].min() > np.sort(spread)[-5] - 1e-12


def test_finer_grids_for_more_vectors():
    rng = np.random.default_rng(5)
    sample = {64: rng.standard_normal((1500, 64))}
    grids = [S.plan(sample, n, 0.95, 16, None)[64][1] for n in (2_000, 50_000, 10_000_000)]
    assert grids == sorted(grids) and grids[0] < grids[-1]
