from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontam

from .conftest import edited, prose


def items_of(n):
    return [(k, prose(300 + k, 15 + k % 45) + ". " + prose(900 + k, 4) + ".") for k in range(n)]


@pytest.fixture(scope="module")
def index():
    items = items_of(300)
    words = [decontam.terms_of(t) for _, t in items]
    df = Counter(w for x in words for w in set(x))
    return items, decontam.Index(items, df, len(items), sum(map(len, words)) / len(items), 0.3)


def test_search_finds_all_above_threshold(index):
    items, ix = index
    weights = [dict() for _ in items]
    for w, (docs, x, _, _) in ix.postings.items():
        for d, v in zip(docs, x, strict=True):
            weights[d][w] = v
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in weights)
    for k in range(40):
        terms = set(decontam.terms_of(prose(k, 120) + " " + items[k][1]))
        score = [sum(v for w, v in x.items() if w in terms) for x in weights]
        for threshold in (0.3, 0.5, 0.9):
            got = dict(ix.search(terms, threshold))
            assert set(got) == {d for d, s in enumerate(score) if s >= threshold - 1e-9}
            assert all(abs(got[d] - score[d]) < 1e-9 for d in got)


def test_window_test_loses_nothing(index):
    items, ix = index
    for k in range(20):
        raw = decontam.lower_words(prose(k, 300) + " " + items[k][1] + " " + prose(k + 50, 100))
        n = max(1, -(-len(raw) // ix.longest) - 1)
        numbers = ix.numbers(raw)
        passed = set(ix.possible(numbers, ix.longest, n).tolist())
        for w in range(n):
            terms = {ix.vocabulary[x] for x in set(numbers[w * ix.longest : (w + 2) * ix.longest].tolist()) if x >= 0}
            if ix.search(terms, 0.3):
                assert w in passed


def test_planted_leaks(spark):
    items = items_of(60)
    rows = [(k, prose(k, 200 + 7 * k)) for k in range(80)]
    want = set()
    for k in range(0, 80, 3):
        item = items[k % 60][1]
        item = edited(item, k, 1) if k % 2 else item
        rows[k] = (k, rows[k][1][: 5 * k] + " " + item + "\n" + rows[k][1][5 * k :])
        want.add((k, items[k % 60][0]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_items": 7}):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, **options).collect()}
        assert got == want


def test_odd_documents_and_items(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, prose(4, 40), "x"), (3, "one", "x"), (3, "one", "x"), (4, prose(1, 60), "x")], "item_id long, text string, score string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd_docs, bench).collect())
    assert got[14, None] == 1 and got[7, 3] == 1 and got[11, 4] == 1 and got[12, 4] == 1
    assert decontam.contaminated(no_docs, bench).count() == 0
    assert decontam.contaminated(odd_docs, bench.where("false")).count() == 0


def test_question_and_answer():
    q, a = decontam.question_and_answer("What is it? A thing. The last one.")
    assert q == [b"what", b"is", b"it", b"a", b"thing"] and a == [b"the", b"last", b"one"]
    assert decontam.question_and_answer("one") == ([b"one"], [])
    assert np.isclose(sum(map(len, decontam.question_and_answer("a b c d e f"))), 6)
