"""Catalog queries on small tables against brute force over the whole graph."""

import hashlib
from collections import defaultdict

import pytest
from graphloom.plans import catalog

CUSTOMERS = [(c, c % 4) for c in range(1, 8)]
SUPPLIERS = [(1, 0), (2, 3)]
NATIONS = [(n, n % 2) for n in range(4)]
ORDERS = [(o, 1 + o * 5 % 7) for o in range(1, 19)]
LINES = [(1, [1, 2]), (2, [2, 3]), (3, [3, 4]), (4, [4, 5]), (5, [5, 6]), (6, [6, 7]), (7, [7, 8, 9]), (8, [9, 10]), (9, [11, 12, 13]), (10, [8, 10])]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    tables = {
        "customer": (CUSTOMERS, "c_custkey long, c_nationkey long"),
        "supplier": (SUPPLIERS, "s_suppkey long, s_nationkey long"),
        "nation": (NATIONS, "n_nationkey long, n_regionkey long"),
        "orders": (ORDERS, "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p) for o, parts in LINES for p in parts], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def typed():
    kinds = ((CUSTOMERS, 0, 4), (SUPPLIERS, 1, 4), (NATIONS, 4, 5), (ORDERS, 3, 0))
    return [(a * 8 + s, b * 8 + t) for rows, s, t in kinds for a, b in rows]


def copurchased():
    return sorted({(a * 8 + 2, b * 8 + 2) for _, parts in LINES for a in parts for b in parts if a < b})


def both_ways(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def test_node2vec_walks_the_whole_graph(spark, small):
    near = both_ways(typed())
    want = {}
    for start in near:
        path = [start]
        for k in range(1, catalog.WALK_LENGTH):
            draw = lambda *key: int(hashlib.md5("|".join(map(str, (catalog.SEED, *key))).encode()).hexdigest()[:13], 16) / (1 << 52)  # noqa: B023, E731
            options = sorted(near[path[-1]])
            came = path[-2] if len(path) > 1 else None
            weigh = lambda x: 2.0 if came is None or x == came else 1.0 if x in near[came] else 1 / 0.8  # noqa: B023, E731
            for t in range(6):
                x = options[int(draw("node2vec", start, 0, k, t) * len(options))]
                if draw("accept", start, 0, k, t) * 2 < weigh(x):
                    path.append(x)
                    break
            else:
                cum, u = 0.0, draw("node2vec", start, 0, k) * sum(map(weigh, options))
                for x in options:
                    cum += weigh(x)
                    if cum > u:
                        path.append(x)
                        break
        want[start, 0] = " ".join(map(str, path))
    got = {(r["start"], r["walk"]): r["path"] for r in catalog.node2vec(spark, small).collect()}
    assert got == want and sum(s % 8 == 3 for s, _ in got) == len(ORDERS)


def test_common_neighbors_answers_every_edge(spark, small):
    edges = copurchased()
    near = both_ways(edges)
    got = sorted(tuple(r) for r in catalog.common_neighbors(spark, small).select("a", "b", "common").collect())
    assert got == [(a, b, len(near[a] & near[b])) for a, b in edges]


def test_pregel_sssp_reaches_far_vertices(spark, small):
    edges = copurchased()
    want = dict.fromkeys(both_ways(edges)) | {10: 0.0}
    now = [10]
    while now:
        now = [b for a in now for s, b in edges if s == a and want[b] is None and want.update({b: want[a] + 1}) is None]
    got = {r["id"]: r["distance"] for r in catalog.pregel_sssp(spark, small).collect()}
    assert got == want and want[82] == 8.0 and want[90] is None


def test_connected_components_cover_the_whole_graph(spark, small):
    near = both_ways(typed())
    want = {}
    for root in sorted(near):
        now = [] if root in want else [root]
        while now:
            x = now.pop()
            if x not in want:
                want[x] = root
                now += near[x]
    got = {r["id"]: r["component"] for r in catalog.connected_components(spark, small).collect()}
    assert got == want and len(set(want.values())) == 2
