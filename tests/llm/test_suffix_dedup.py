import random
from collections import defaultdict

import pytest
from graphloom.llm import suffix_dedup
from graphloom.llm.common import lower_words

from .conftest import prose


def brute(rows, least):
    words = [(i, lower_words(t)) for i, t in {(i, t) for i, t in rows if i is not None and t is not None}]
    where = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words:
        spans = []
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
        out |= {(i, a, b - a) for a, b in spans}
    return out


def firsts(rows, least):
    """Of each longest passage, the smallest id of the documents that share a run of it."""
    words = [(i, lower_words(t)) for i, t in {(i, t) for i, t in rows}]
    where = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in words:
        now = None
        for k in range(len(w) - least + 1):
            ids = where[tuple(w[k : k + least])]
            if len(ids) > 1:
                if not now or k > now[1]:
                    now = [k, 0]
                now[1] = k + least
                out[i, now[0]] = min(out.get((i, now[0]), i), *ids)
    return out


def found(df):
    return {(r["doc_id"], r["start_word"], r["n_words"]) for r in df.collect()}


def test_planted_passages_of_any_length_and_place(spark):
    rng = random.Random(5)
    passages = [prose(50 + k, n) for k, n in enumerate([49, 50, 51, 60, 90, 200])]
    rows = []
    for k in range(60):
        text = prose(1000 + k, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split(" ")
            a = rng.randrange(0, 10)
            text += " " + " ".join(p[a:]) + "\n" + prose(2000 + k, rng.randrange(0, 40))
        rows.append((k, text.upper() if k % 9 == 0 else text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, passages[4]), (103, passages[3] + " " + passages[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.repeated_passages(docs)
    assert found(got) == brute(rows, 50)
    text = dict(rows)
    for r in got.collect():
        words = lower_words(text[r["doc_id"]])
        assert lower_words(text[r["doc_id"]][r["start"] : r["end"]]) == words[r["start_word"] : r["start_word"] + r["n_words"]]
        assert r["first_doc_id"] <= r["doc_id"]


@pytest.mark.parametrize("most_held", [2, 100_000])
def test_partners_that_only_a_left_and_right_match_together_show(spark, most_held):
    """Few words, so that the neighbour with the longest match to the right is often not the one that completes a passage; a line in
    half of the documents, so that ranges of the sorted suffixes cut its group."""
    rng = random.Random(8)
    pieces = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    rows = [(k // 2 if k < 8 else k, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) + (" u v w x y z u x v y w z" if k % 2 else "") + f" e{k}") for k in range(160)]
    rows += [(200 + k, rows[k][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_passages(docs, 10, 2, 5, most_held)
    assert found(got) == brute(rows, 10)
    one_text = lambda m: {k: v for k, v in m.items() if k[0] >= 8}
    assert one_text({(r["doc_id"], r["start_word"]): r["first_doc_id"] for r in got.collect()}) == one_text(firsts(rows, 10))


def test_frequent_keys_are_met_apart(spark):
    rows = spark.createDataFrame([(k % 3 and 7, k % 5, k) for k in range(300)] + [(100 + k, 1, 0) for k in range(20)], "key long, name long, at long")
    want = sorted(map(tuple, rows.where("key < 100").select("key", "name", "at").collect()))
    for hot in (10, 150, 1000):
        assert sorted(map(tuple, suffix_dedup.shared_rows(rows, ["key"], "name", "name", hot).select("key", "name", "at").collect())) == want


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(suffix_dedup.repeated_passages(odd_docs)) == brute(rows, 50)
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


def test_minimisers_depend_on_content_only():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 22, 23, 24, 500):
        h = rng.integers(0, 30, n).astype(np.uint64)
        g = suffix_dedup.gram_hashes(h, 8)
        got = set(suffix_dedup.minimisers(h, 8, 16).tolist())
        low = (1 << 30) - 1
        key = [(int(x) & ~low, k) for k, x in enumerate(g)]
        assert got == {min(key[k : k + 16])[1] for k in range(len(g) - 15)}


def test_gram_hashes_tell_runs_apart():
    import numpy as np

    h = np.random.default_rng(2).integers(0, 4, 3000).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 35, 50):
        runs = {}
        for k, x in enumerate(suffix_dedup.gram_hashes(h, n).tolist()):
            assert runs.setdefault(x, tuple(h[k : k + n].tolist())) == tuple(h[k : k + n].tolist())
        assert len(runs) == len({tuple(h[k : k + n].tolist()) for k in range(len(h) - n + 1)})
    assert len(suffix_dedup.gram_hashes(h[:2], 5)) == 1 and len(suffix_dedup.gram_hashes(h[:0], 5)) == 0
