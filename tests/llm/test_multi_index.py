import math

import numpy as np
import pytest

from graphloom.llm import multi_index
from graphloom.llm.common import Forest


def brute(rows, least):
    ids = sorted({i for i, *_ in rows if i is not None})
    at, forest, links = {i: k for k, i in enumerate(ids)}, Forest(len(ids)), [0] * len(rows)

    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v) if np.abs(v).max() > 0 else None

    units = [unit(v) for _, v, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                forest.join(at[rows[a][0]], at[rows[b][0]])
    return links, {i: ids[forest.find(at[i])] for i in ids}


def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=d)
        if k % 3 == 0 and k:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8, "cell_members": 5, "sample": 100}])
def test_links_equal_brute_force(spark, options):
    rows = vectors(1)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).collect()}
    links, components = brute(rows, 0.93)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(links)
    assert all(got[i]["n_links"] <= links[i] for i in got)
    assert np.mean([got[i]["component_id"] == c for i, c in components.items()]) > 0.99
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_crowded_cell_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(k, [float(x) for x in base + rng.normal(size=16) * 0.25], 1) for k in range(300)] + [(500 + k, [float(x) for x in base], 1) for k in range(50)]
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=32).collect()}
    links, components = brute(rows, 0.93)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(links)
    assert all(got[r[0]]["n_links"] <= n for r, n in zip(rows, links, strict=True))


@pytest.mark.parametrize("own_grid", [10, 100_000])
def test_vectors_of_several_lengths(spark, own_grid):
    rows = vectors(5, 300, 16) + [(1000 + k, v, y) for k, v, y in vectors(6, 120, 8)]
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), own_grid=own_grid).collect()}
    links = brute(vectors(5, 300, 16), 0.93)[0] + brute(vectors(6, 120, 8), 0.93)[0]
    want = {r[0]: n for r, n in zip(rows, links, strict=True)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.99 * sum(links)


@pytest.mark.parametrize(("d", "codes"), [(64, 16), (64, 64), (768, 32)])
def test_recall_on_vectors_that_calibration_has_not_seen(d, codes):
    rng = np.random.default_rng(d + codes)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    centres = rng.normal(size=(40, d))
    draw = lambda n: unit(np.concatenate([centres[rng.integers(40, size=n // 2)] + 0.7 * rng.normal(size=(n // 2, d)), rng.normal(size=(n - n // 2, d))]))
    grid = multi_index.Grid(draw(2000), draw(2000), np.zeros(2000, int), 0.93, codes, 0.999)
    one = draw(800)
    noise = rng.normal(size=one.shape)
    noise -= (noise * one).sum(axis=1)[:, None] * one
    two = 0.93 * one + np.sqrt(1 - 0.93**2) * unit(noise)
    a, b = grid.visits(one), grid.visits(two)
    assert np.mean((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)) >= 0.985


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    a, b = rng.random(7), rng.random(9)
    want = sorted(range(63), key=lambda c: a[c // 9] + b[c % 9])
    assert multi_index.multi_sequence(a, b, 63) == want and multi_index.multi_sequence(a, b, 5) == want[:5]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 4, 1), (4, [nan, 1.0, 1.0, 1.0], 1), (5, [inf, 1.0, 1.0, 1.0], 1), (6, [1.0, None, 1.0, 1.0], 1), (7, v, None), (8, v, 1), (9, v, 1), (10, [2 * x for x in v], 1), (11, v, 2), (12, [1e300, 2e300, 3e300, 4e300], 1), (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1), (15, [2.0, 4.0], 2), (16, [-3.0], 1), (17, [-1.0], 1), (18, [1.0], 1), (None, v, 3), (8, v, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, unit string, ka int")
    got = {}
    for r in multi_index.near_duplicates(table).collect():
        got.setdefault(r["vec_id"], r)
    for i in (1, 2, 3, 4, 5, 6, 7, 11, 15, 18):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (13, 14, 16, 17)] == [(1, 13), (1, 13), (1, 16), (1, 16)]  # vectors of a rarer length link too
    assert {got[i]["component_id"] for i in (8, 9, 10, 12)} == {8} and got[9]["n_links"] == 4
    assert multi_index.near_duplicates(table.where("false")).count() == 0
    assert multi_index.near_duplicates(table.where("vec_id < 4")).count() == 3
