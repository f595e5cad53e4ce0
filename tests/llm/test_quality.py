import random
import zlib

import numpy as np

from graphloom.llm import quality

from .conftest import prose


def corpus(n):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        text = prose(k, rng.randrange(30, 150))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + "###" for w in t.split(" ")), lambda t: " ".join([t.split(" ")[0]] * 80)])(text)
        docs.append((k, text))
        if rng.random() < 0.5:
            labels.append((k, int(good)))
    return docs, labels


def test_held_out_accuracy_and_prior(spark):
    docs, labels = corpus(1500)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.score(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert 0.55 < got[0]["prior"] < 0.86  # a lower bound of 0.8


def test_held_out_labels_and_labels_of_others_do_not_matter(spark):
    docs, labels = corpus(400)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    told = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    turned = [(i, 1 - y) for i, y in labels if not zlib.crc32(str(i).encode()) % 5]
    a, b = (quality.score(table, spark.createDataFrame(x, "doc_id long, quality int")).toPandas().set_index("doc_id").score for x in (told, told + turned))
    assert np.allclose(a, b[a.index])


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 1, "x"), (11, 1, "x"), (16, 0, "x"), (None, 1, "x"), (14, None, "x")], "doc_id long, quality int, score string")
    got = quality.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.score(odd_docs, labels.where("false")).collect()} == {0.5}


def risk(w, x, positive, prior, ridge):
    """The non-negative risk with its ridge, in plain numpy, and a (sub)gradient."""
    g, s = x @ w, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    up, down = np.logaddexp(0, -g), np.logaddexp(0, g)
    negative = down.mean() - prior * down[positive].mean()
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-9
    grad = prior * ((s - 1)[positive] @ x[positive]) / positive.sum() + penalty * w
    if negative > 0:
        grad = grad + s @ x / len(x) - prior * (s[positive] @ x[positive]) / positive.sum()
    return prior * up[positive].mean() + max(0, negative) + 0.5 * w @ (penalty * w), grad


def test_fit_reaches_the_least_risk_that_plain_descent_finds(spark):
    docs, labels = corpus(600)
    good = {i for i, y in labels if y}
    x = np.stack([quality.ratios(t) for _, t in docs])
    positive = np.array([i in good for i, _ in docs])
    rows = spark.createDataFrame([(i, [float(v) for v in r], bool(p)) for (i, _), r, p in zip(docs, x, positive, strict=True)], "doc_id long, x array<float>, positive boolean")
    w, prior = quality.fit(rows)
    wide, ridge = quality.expand(x.astype(float)), max(1e-3, 1 / positive.sum())
    v = np.zeros(wide.shape[1])
    m, n, least = np.zeros_like(v), np.zeros_like(v), np.inf
    for k in range(1, 4000):
        now, grad = risk(v, wide, positive, prior, ridge)
        least = min(least, now)
        m, n = 0.9 * m + 0.1 * grad, 0.999 * n + 0.001 * grad * grad
        v = v - 0.02 * m / (1 - 0.9**k) / (np.sqrt(n / (1 - 0.999**k)) + 1e-8)
    assert risk(w, wide, positive, prior, ridge)[0] <= least + 0.02


def test_hats_partition_each_ratio():
    x = np.random.default_rng(1).random((50, quality.N_RATIOS))
    full = quality.expand(x)
    assert full.shape == (50, quality.SIZE) and (full[:, 1:] >= 0).all() and (full[:, 1:].reshape(50, quality.N_RATIOS, -1).sum(axis=2) <= 1 + 1e-9).all()
    assert quality.ratios(None).sum() == 0 and quality.ratios("").sum() == 0
