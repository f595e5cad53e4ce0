import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import chosen_path
from graphloom.llm.common import Forest, WordHashes, lower_words

from .conftest import edited, prose


def shingles(text, n):
    w = lower_words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """Smallest reachable id of each id; an id with several texts is one node."""
    ids = sorted({i for i, _ in rows if i is not None})
    at, forest = {i: k for k, i in enumerate(ids)}, Forest(len(ids))
    sets = [(at[i], s) for i, t in rows if i is not None and (s := shingles(t, n))]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (a, s) in enumerate(sets):
        for j, both in Counter(j for g in s for j in where[g] if j > k).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                forest.join(a, sets[j][0])
    return {i: ids[forest.find(at[i])] for i in ids}


def planted(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for group in range(40):
        text = prose(100 * seed + group, rng.randrange(20, 200))
        for copy in range(rng.choice([1, 1, 2, 5, 20])):
            rows.append((k, text if copy % 4 == 3 else edited(text, k, rng.randrange(0, 8))))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "threshold", "options"), [(3, 0.85, {}), (5, 0.8, {"small": 4, "block": 4, "depth": 2})])
def test_components_equal_brute_force(spark, words, threshold, options):
    rows = planted(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in chosen_path.near_duplicates(docs, words, threshold, **options).collect()}
    want = brute(rows, words, round(100 * threshold))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert all(got[i]["n_shingles"] == len(shingles(t, words)) for i, t in rows)


def test_large_group_of_near_copies(spark):
    text = prose(9, 120)
    rows = [(k, edited(text, k, 2)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(docs, 3, 0.85, block=128).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = chosen_path.near_duplicates(odd_docs, 3, 0.85).collect()
    assert len(got) == len(rows)
    want = brute(rows, 3, 85)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None)
    assert {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0} and {r["n_shingles"] for r in got if r["doc_id"] in (7, 8)} == {1}
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    hashes = WordHashes()
    a, b = (chosen_path.shingle_set(t, 3, hashes) for t in (prose(1, 5000), edited(prose(1, 5000), 2, 150)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((chosen_path.signature(a) == chosen_path.signature(b)).mean() - true) < 0.2


def test_spanning_links_connect_what_links_connect():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1]), rng.integers(0, 10_000, 60).astype(np.uint64), base)) for _ in range(80)]
    whole, found = Forest(80), Forest(80)
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                whole.join(i, j)
    links = list(chosen_path.spanning_links(sets, 80))
    assert all(found.join(i, j) for i, j in links)
    assert [found.find(k) for k in range(80)] == [whole.find(k) for k in range(80)]
