"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max WAND.

Every window of every document is a query. An item's weights are scaled so that it scores 1 against itself; all items
at or above ``threshold`` are retrieved, then question (all but the last sentence) and answer (the last sentence, or
the last third of a single one) must each be found in the window by ``overlap`` of their word pairs.

Windows are twice as long as the longest item of a block and overlap by half, so an item never lies across windows
only. The index is built for blocks of at most ``block_items`` items and ``block_bytes`` of text, which bounds what is
sent to the executors; a larger benchmark is searched block after block. Documents are only scanned: no shuffle but
for the item statistics.

Windows are first tested together: an item can only reach the threshold if the rare terms that the window shares with
it, with all of its frequent terms added as if they were there, sum up to it. Windows in which some item passes are then searched.

Defined results: null or empty texts and items match nothing; items of one word are matched on that word; repeated rows of
documents give repeated results, of items (equal id and text) one; a null id is kept as it is; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words

K1, B = 1.2, 0.75
SCHEMA = "doc_id long, text_hash long, item_id long, score double, question_overlap double, answer_overlap double, start_word long, n_words long"
_EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation at their ends; a word of punctuation only stays."""
    return [_EDGES.sub(b"", w) or w for w in lower_words(text)]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return terms_of(" ".join(parts[:-1])), terms_of(parts[-1])
    words = terms_of(text)
    cut = max(1, len(words) - max(1, len(words) // 3))
    return words[:cut], words[cut:]


class Index:
    """Posting lists of (item, weight) in item order, in blocks with their largest weight."""

    BLOCK = 64

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n_items: int, mean_length: float, threshold: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        lists: dict[bytes, list] = defaultdict(list)
        self.longest = 1
        self.most_frequent = np.zeros(len(items))
        self.rare: dict[bytes, tuple] = {}
        rare_up_to = max(3, n_items // 50)
        for d, (_, text) in enumerate(items):
            words = terms_of(text)
            self.longest = max(self.longest, len(words))
            weight = {}
            for w, tf in Counter(words).items():
                df = frequency[w]
                idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            total = sum(weight.values())
            for w, x in weight.items():
                lists[w].append((d, x / total))
                if frequency[w] > rare_up_to:
                    self.most_frequent[d] += x / total
        self.need = threshold - self.most_frequent - 1e-9
        #: Items that frequent terms alone could bring to the threshold are tried in every window.
        self.always = bool((self.need <= 0).any())
        self.postings = {}
        for w, posting in lists.items():
            docs, weights = [p[0] for p in posting], [p[1] for p in posting]
            tops = [max(weights[k : k + self.BLOCK]) for k in range(0, len(weights), self.BLOCK)]
            self.postings[w] = (docs, weights, tops, max(tops))
        self.vocabulary = list(self.postings)
        self.number = {w: k for k, w in enumerate(self.vocabulary)}
        self.numbers_of_raw: dict[bytes, int] = {}
        rare = [w for w in self.vocabulary if frequency[w] <= rare_up_to]
        counts = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for w in rare:
            counts[self.number[w]] = len(self.postings[w][0])
        self.rare_count = counts
        self.rare_start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = [w for w in self.vocabulary if counts[self.number[w]]]
        self.rare_items = np.array([d for w in order for d in self.postings[w][0]], dtype=np.int64)
        self.rare_weights = np.array([x for w in order for x in self.postings[w][1]])

    def numbers(self, raw: list[bytes]) -> np.ndarray:
        """Numbers of the terms of raw lower-case words; -1 for words that no item has."""
        known = self.numbers_of_raw
        try:
            return np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
        except KeyError:
            if len(known) > 400_000:
                known.clear()
            for w in raw:
                if w not in known:
                    known[w] = self.number.get(_EDGES.sub(b"", w) or w, -1)
            return np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))

    def possible(self, numbers: np.ndarray, stride: int, n_windows: int) -> np.ndarray:
        """Windows (of two strides) in which some item's bound reaches the threshold."""
        if self.always:
            return np.arange(n_windows)
        at = np.flatnonzero((numbers >= 0) & (self.rare_count[numbers] > 0))
        if not len(at):
            return at
        term = numbers[at]
        count = self.rare_count[term]
        ends = np.cumsum(count)
        flat = np.repeat(self.rare_start[term] - (ends - count), count) + np.arange(ends[-1])
        slot = np.repeat(at // stride, count)
        item, weight = self.rare_items[flat], self.rare_weights[flat]
        n = len(self.ids)
        # a window holds its own stride and the next; weights of the two add up
        key, inverse = np.unique(np.concatenate([slot, slot - 1]) * n + np.concatenate([item, item]), return_inverse=True)
        bound = np.bincount(inverse, np.concatenate([weight, weight]))
        hit = key[bound >= self.need[key % n]] // n
        return np.unique(hit[(hit >= 0) & (hit < n_windows)])

    def search(self, terms: set[bytes], threshold: float) -> list[tuple[int, float]]:
        """All items with a score of at least ``threshold``, by block-max WAND."""
        lists = [[self.postings[w], 0] for w in terms if w in self.postings]
        found = []
        while True:
            lists = [x for x in lists if x[1] < len(x[0][0])]
            lists.sort(key=lambda x: x[0][0][x[1]])
            bound, pivot = 0.0, -1
            for k, ((_, _, _, top), _) in enumerate(lists):
                bound += top
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            # the blocks that would hold the pivot: their maxima may rule it out, with all items up to the nearest block end
            bound, until = 0.0, len(self.ids)
            for x in lists[: pivot + 1]:
                docs, _, tops, _ = x[0]
                block = x[1] // self.BLOCK
                while block < len(tops) and docs[min((block + 1) * self.BLOCK, len(docs)) - 1] < item:
                    block += 1
                if block < len(tops):
                    bound += tops[block]
                    until = min(until, docs[min((block + 1) * self.BLOCK, len(docs)) - 1] + 1)
            if bound < threshold - 1e-9:
                if pivot + 1 < len(lists):
                    until = min(until, lists[pivot + 1][0][0][lists[pivot + 1][1]])
                self._advance(lists[: pivot + 1], max(until, item + 1))
            elif lists[0][0][0][lists[0][1]] == item:
                score = sum(x[0][1][x[1]] for x in lists[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                self._advance(lists[: pivot + 1], item + 1)
            else:
                self._advance(lists[:pivot], item)

    @staticmethod
    def _advance(lists: list, item: int) -> None:
        for x in lists:
            x[1] = bisect_left(x[0][0], item, x[1])

    def verified(self, item: int, words: list[bytes], overlap: float) -> tuple[float, float] | None:
        have = set(zip(words, words[1:], strict=False)) | {(w,) for w in words}
        shares = []
        for part in self.parts[item]:
            pairs = set(zip(part, part[1:], strict=False)) or {(w,) for w in part}
            shares.append(len(pairs & have) / len(pairs) if pairs else 1.0)
        return tuple(shares) if min(shares) >= overlap else None


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, block_items: int = 50_000, block_bytes: int = 32 << 20
) -> DataFrame:
    """Pairs of a document and an item that it holds, with the best window: score, overlaps, first word and length. An id and text_hash
    (xxhash64) together tell the document's row."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL AND text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms_of(t) for t in batch.column(0).to_pylist()]
            flat = Counter(w for x in words for w in set(x))
            yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.binary()), pa.array(list(flat.values()), pa.int64())], ["term", "df"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([sum(map(len, batch.column(0).to_pylist()))], pa.int64())], ["items", "words", "chars"])

    size = items.select("text").mapInArrow(lengths, "items long, words long, chars long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "words", "chars")]).first()
    if not size["items"]:
        return spark.createDataFrame([], SCHEMA)
    frequency = items.select("text").mapInArrow(tokens, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    blocks = max(-(-size["items"] // block_items), -(-4 * size["chars"] // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return reduce(DataFrame.unionAll, (_search_block(docs, dealt.where(F.col("block") == b), frequency, size, threshold, overlap) for b in range(blocks)))


def _search_block(docs: DataFrame, items: DataFrame, frequency: DataFrame, size, threshold: float, overlap: float) -> DataFrame:
    spark = docs.sparkSession
    rows = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"], r["item_id"]) for r in items.collect())
    words = {w for _, t, _ in rows for w in terms_of(t)}
    if frequency.count() <= 4 * len(words) + 1000:
        df = {bytes(r["term"]): r["df"] for r in frequency.collect()}
    else:
        mine = spark.createDataFrame([(bytearray(w),) for w in words], "term binary")
        df = {bytes(r["term"]): r["df"] for r in frequency.join(mine, "term", "left_semi").collect()}
    index = spark.sparkContext.broadcast(Index([(i, t) for _, t, i in rows], df, size["items"], size["words"] / size["items"], threshold)) if rows else None
    if index is None:
        return spark.createDataFrame([], SCHEMA)
    schema = pa.schema([(n.split()[0], pa.int64() if n.endswith("long") else pa.float64()) for n in SCHEMA.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        stride = ix.longest
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = lower_words(text.as_py())
                n_windows = max(1, -(-len(raw) // stride) - 1) if raw else 0
                best: dict[int, tuple] = {}
                numbers = ix.numbers(raw)
                for w in ix.possible(numbers, stride, n_windows):
                    a = int(w) * stride
                    found = ix.search({ix.vocabulary[k] for k in set(numbers[a : a + 2 * stride].tolist()) if k >= 0}, threshold)
                    if found:
                        words = [_EDGES.sub(b"", x) or x for x in raw[a : a + 2 * stride]]
                        for item, score in found:
                            shares = ix.verified(item, words, overlap)
                            if shares and (item not in best or score > best[item][0]):
                                best[item] = (score, *shares, a, len(words))
                for item, row in sorted(best.items()):
                    for c, v in zip(out, (doc, name, ix.ids[item], *row), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(scan, SCHEMA)
