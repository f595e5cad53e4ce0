import math
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import katz, queries
from graphloom.llm.common import lower_words

from .conftest import prose


class Brute:
    """The model by its definition: dictionaries of counts and a recursive probability."""

    def __init__(self, rows, order=2, k=5):
        self.words = [[*lower_words(t), "</s>"] for _, t in rows]
        self.held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
        self.k, self.order = k, order
        self.counts = [Counter() for _ in range(order + 1)]
        for x, h in zip(self.words, self.held, strict=True):
            if not h:
                for history, w in self.events(x):
                    for m in range(1, order + 1):
                        self.counts[m][(*history[len(history) - m + 1 :], w)] += 1
        self.u = {g[0]: c for g, c in self.counts[1].items()}
        self.n = sum(self.u.values())
        of = lambda c: np.bincount(np.minimum(list(c.values()) or [0], k + 2), minlength=k + 3)
        self.d = [None, *(katz.good_turing(of(c), k) for c in self.counts[1:])]
        kept = sum(self.disc(c, 1) for c in self.u.values())
        self.bottom = self.n if self.n - kept > 1e-9 * max(1, self.n) else self.n + 1
        self.unknown = 1 - kept / self.bottom
        self.context = {}
        for m in range(2, order + 1):
            follow = defaultdict(list)
            for g, c in self.counts[m].items():
                follow[g[:-1]].append((g[-1], c))
            for h, seen in follow.items():
                total, used = sum(c for _, c in seen), sum(self.disc(c, m) for _, c in seen)
                extra = 1 if total - used <= 1e-9 * total else 0
                left = (total + extra - used) / (total + extra)
                self.context[h] = (total + extra, left / (1 - sum(self.prob(h[1:], w) for w, _ in seen)))

    def events(self, x):
        padded = ["<s>"] * (self.order - 1) + x
        return [(padded[i : i + self.order - 1], w) for i, w in enumerate(x)]

    def disc(self, c, m):
        return c * self.d[m][c] if c <= self.k else c

    def prob(self, h, w):
        h = tuple(h)
        if not h:
            return self.disc(self.u[w], 1) / self.bottom if w in self.u else self.unknown
        c = self.counts[len(h) + 1].get((*h, w), 0)
        if c:
            return self.disc(c, len(h) + 1) / self.context[h][0]
        return self.context.get(h, (0, 1.0))[1] * self.prob(h[1:], w)

    def score(self, x):
        return sum(math.log10(self.prob(h, w)) for h, w in self.events(x))

    def base(self, x):
        return sum(math.log10((self.u.get(w, 0) + 0.5) / (self.n + 0.5 * (len(self.u) + 1))) for w in x)


def same(rows, got, brute):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    for (i, _), x, h in zip(rows, brute.words, brute.held, strict=True):
        want = (h, len(x), sum(w in brute.u for w in x), brute.n)
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want and abs(r["score"] - brute.score(x)) < 1e-6 and abs(r["base_score"] - brute.base(x)) < 1e-6 for r in by[i]), i


@pytest.mark.parametrize("order, block", [(2, 14_000_000), (2, 3000), (3, 14_000_000), (3, 3000), (4, 9000)])
def test_scores_equal_brute_force(spark, order, block):
    rows = [(k, prose(k % 60, 20 + k % 90)) for k in range(200)]
    brute = Brute(rows, order)
    same(rows, katz.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_chars=block).collect(), brute)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_sum_to_one(order):
    brute = Brute([(k, prose(k % 60, 20 + k % 40)) for k in range(60)], order)
    contexts = list(brute.context)
    for h in [*contexts[:20], *contexts[-60:], ("unseen",) * (order - 1)]:
        assert abs(sum(brute.prob(h, w) for w in brute.u) + brute.prob(h, "never seen") - 1) < 1e-9


def test_order_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        katz.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), order=1)


def test_query_knows_bigrams_seen_once(spark, tmp_path):
    rows = [(k, prose(k % 60, 20 + k % 90)) for k in range(120)] + [(500, "seen once only")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    brute = Brute(rows)
    assert not brute.held[-1] and brute.d[2][1] < 1
    same(rows, queries.op4_katz_lm(spark, str(tmp_path)).collect(), brute)


def test_query_uses_trigrams(spark, tmp_path):
    rows = [(k, prose(k % 60, 20 + k % 90)) for k in range(120)] + [(500, "seen once only")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    brute = Brute(rows, 3)
    assert abs(brute.score(brute.words[-1]) - Brute(rows).score(brute.words[-1])) > 0.01
    same(rows, queries.op4_katz_lm(spark, str(tmp_path)).collect(), brute)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    same(rows, katz.score(odd_docs).collect(), Brute(rows, 3))
    assert katz.score(no_docs).count() == 0


def test_without_training_documents(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "a b") for i in held]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r["train_tokens"], r["n_known"], r["score"], r["base_score"]) == (0, 0, 0.0, 0.0) for r in got)


def test_packed_arrays():
    x, y = np.sort(np.random.default_rng(1).integers(0, 1 << 47, 1000)), np.random.default_rng(2).normal(size=1000)
    a, b = katz.unpack(katz.pack(katz.deltas(x), y), "if")
    assert (np.cumsum(a) == x).all() and (b == y).all()
    assert [len(v) for v in katz.unpack(katz.pack(np.empty(0, np.int64)), "i")] == [0]


def test_words_of_many_texts():
    texts = ["a b A", None, "", "  ", " x\ty\x0bz \r\n", "\u00c4\u00a0\u00e4 \x1c\u2003\u0085 \x00 \x1f", "b", "\u0130 K\u212a"] * 3
    for part in (texts, texts[2:4], texts[:1], []):
        sizes, number, words = katz.split_words(pa.array(part, pa.string()))
        want = [lower_words(t) for t in part]
        assert sizes.tolist() == [len(w) for w in want]
        assert [words[n] for n in number] == [w for x in want for w in x]
        assert sorted(words) == sorted({w for x in want for w in x})
        block = katz.Block(katz.index_block(list(range(len(part))), part, [False] * len(part)))
        assert block.words[block.token].tolist() == [h for x in want for h in (*map(katz.word_hash, x), katz.END)]


def test_no_python_call_for_each_word():
    calls = Counter()
    text = " ".join(f"w{i}" for i in range(20_000))
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        katz.index_block([1], [text], [False])
    finally:
        sys.setprofile(None)
    assert calls.total() < 2000, calls


def test_contexts_are_unpacked_once():
    common, first, second = np.array([2, 5, 8]), np.array([3, 3, 3, 9]), np.array([5, 7, 8, 2])
    of_context, of_gram = np.array([4, 4, 4, 6]), np.array([1, 0, 300, 2])
    blob = katz.pack_grams(first, second, np.array([2, 0, 3, 1]), [of_context], [of_gram])
    contexts, sizes, words, (by_context,), (by_gram,) = katz.unpack_grams(blob, 1, 1, common)
    assert [x.tolist() for x in (contexts, sizes, words, by_context, by_gram)] == [[3, 9], [3, 1], [5, 7, 8, 2], [4, 6], [1, 0, 300, 2]]


def blocks_with_words(*texts_and_held, order, buckets=4):
    """A model that knows the words, and each block's row with the answers about them."""
    rows = [(-1, n, "d", katz.index_block(list(range(len(texts))), texts, held)) for n, (texts, held) in enumerate(texts_and_held)]
    batch = pa.record_batch([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows])], names=["block", "blob"])
    sent = [r for b in katz._send_words(buckets)(iter([batch])) for r in b.to_pylist()]
    summed = [r for n in range(buckets) if (of := [tuple(r.values()) for r in sent if r["bucket"] == n]) for r in katz._sum_words(5)(katz._sent(of)).to_pylist()]
    s = sum(katz.unpack(r["blob"], "i")[0] for r in summed if r["kind"] == "S")
    model = katz.Model(katz.Unigrams(s[:8], int(s[8]), int(s[9]), 5), order, buckets, np.array([katz.END]))
    return model, [katz._sent([row, *(tuple(r.values()) for r in summed if r["block"] == row[1] and r["kind"] == "c1")]) for row in rows]


def test_only_contexts_that_blocks_share_are_sent():
    model, known = blocks_with_words((["a b c", "d e"], [False, False]), (["f g", "b x"], [False, True]), order=2)
    sent = [katz._send(model, 2)(t).to_pylist() for t in known]
    hashes = [sorted({int(h) for r in rows if r["kind"] == "p" for h in katz.unpack_grams(r["blob"], 2, 3, model.common)[0]}) for rows in sent]
    assert hashes == [sorted([katz.BEGIN, katz.word_hash(b"b")])] * 2  # the held-out text asks for b; x was never seen, others are one block's
    own = sum(katz.unpack(r["blob"], "i")[0] for rows in sent for r in rows if r["kind"] == "t")
    assert own.tolist()[:3] == [1, 6, 0]  # a b, c end, d e, e end, f g, g end; x end was not seen


def test_memory_of_a_block():
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(n).integers(0, 40_000, 400)) for n in range(500)]
    model, (known,) = blocks_with_words((texts, [n % 5 == 0 for n in range(500)]), order=3)
    model.d |= {2: model.d[1], 3: model.d[1]}
    model.split = {m: (np.empty(0, np.int64), np.empty((0, 5), np.int64), np.empty(0)) for m in (2, 3)}
    peaks = []
    for work in (katz._send(model, 2), katz._send(model, 3), lambda t: katz._evaluated(t, model)):
        tracemalloc.start()
        work(known)
        peaks.append(tracemalloc.get_traced_memory()[1] / (500 * 401))
        tracemalloc.stop()
    assert max(peaks) < 240, peaks  # bytes a token, of which there are about 1.5 million in a block


@pytest.mark.parametrize("bound", [1000, 1 << 62])
def test_sorted_places(bound):
    keys = np.random.default_rng(3).integers(0, 1000, 5000)
    assert (katz.sorted_places(keys, bound) == np.argsort(keys, kind="stable")).all()
