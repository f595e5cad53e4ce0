"""Repeated passages across documents by a sparse suffix array.

Suffixes are kept only at minimiser positions: of each ``window`` neighbouring ``gram``-word hashes the smallest one's place,
which the words alone select, so equal passages keep equal suffixes. A passage of at least ``least`` words that starts at q holds the
whole first window of such hashes, and so a kept suffix at some p from q to q + window - 1, from which at least ``least`` - window + 1 equal
words follow.

1. *Retain.* Suffixes whose prefix of that length occurs in one text only cannot matter. They are dropped by a fingerprint of the
   prefix and partial aggregates (smallest and largest text of a fingerprint); equal words have equal fingerprints, so nothing is lost.
2. *Sort.* Each retained suffix becomes a row of ``least`` words to its right and window - 1 to its left. The rows are range-partitioned and sorted
   by these words: the suffix array. A frequent passage is cut into many ranges like any other.
3. *Compare and extend.* A task reads its range in order and compares neighbours word by word. Suffixes that share the whole prefix stand together; among them the
   common words to the right (from the order) and to the left (by classes of equal left words) tell each run of ``least`` words around a suffix
   that another document has too. All pairs of a left and a right length that add up to ``least`` are tried, since the neighbour with
   the longest match to the right need not be the one that completes ``least`` words.
4. *Borders.* The first and last group of suffixes of a range may go on in the next one, and a group of more than ``most_held`` is held in memory
   in parts. Of such groups, runs without partner in their part, and one of each run with partners, are compared once more by 128-bit
   fingerprints of their words.
5. Overlapping runs of a text merge to its longest passages. Every passage of at least ``least`` words that occurs in two documents is found in both, to the word.

Texts that are equal as a whole are one text throughout, and each copy is a repeated passage from its first to its last word. Joins by a
fingerprint take its frequent values apart (at most ``MOST_HOT`` of them, broadcast), so no task gets all rows of one.

Defined results: null, empty and shorter texts have no passages; a passage that only repeats within one document is not one; rows with
a null id are left out; repeated rows (equal id and text) are one document, and an id with several texts has the passages of each, none for what only
its own texts share; an empty table gives no rows; other columns are ignored. Words are compared with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, forget, gram_hashes, lower_words, stored

SCHEMA = "doc_id long, start_word long, n_words long, start long, end long, first_doc_id long"
CONTEXT = "right binary, left binary, name long, at int, start long, gaps binary, low long, high long, n int, end long"
#: What tasks find: stretches (name to first_doc_id); of open groups also runs (ka, kb), their classes within a part of the order, and sets of classes.
FOUND = "name long, low long, high long, at long, n long, start long, end long, first_doc_id long, ka long, kb long, class long, classes long"
STRETCH = ("name", "low", "high", "at", "n", "start", "end", "first_doc_id")
#: Values of a join key that are taken apart as frequent, at most.
MOST_HOT = 10_000


def minimisers(hashes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the smallest gram hash of each window (the leftmost of equal ones)."""
    g = gram_hashes(hashes, gram)
    if len(g) < window:
        return np.empty(0, np.int64)
    # places in the low bits, so that minima tell where they are and the leftmost of equal hashes wins; 30 bits for any text
    # that a row can hold
    low = np.uint64((1 << 30) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return np.unique(least & low).astype(np.int64)


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which words start and end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    if len(raw) != len(text):
        turns = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[turns]
    return turns[::2], turns[1::2]


def suffixes(texts: DataFrame, prefix: int, gram: int, window: int) -> DataFrame:
    """(key, name, at): a prefix hash for each kept suffix of ``texts`` (name, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            names, keys, places = [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = hashes.of(lower_words(value.as_py()))
                if len(h) < prefix + window - 1:
                    continue
                at = minimisers(h, gram, window)
                at = at[at + prefix <= len(h)]
                names.append(np.full(len(at), name, np.int64))
                keys.append(gram_hashes(h, prefix)[at].view(np.int64))
                places.append(at)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "name", "at"])

    return texts.select("name", "text").mapInArrow(task, "key long, name long, at int")


def shared_rows(rows: DataFrame, key: list[str], low: str, high: str, hot_rows: int = 50_000) -> DataFrame:
    """The stored ``rows`` whose key has different values of ``low`` and ``high``, with the smallest ``low`` as ``first``.

    Keys of more than ``hot_rows`` rows (and more than a ``MOST_HOT``-th of all) are met by a broadcast, others by a shuffled join.
    """
    sums = rows.groupBy(*key).agg(F.min(low).alias("first"), F.max(high).alias("last"), F.count(F.lit(1)).alias("members"))
    shared = stored(sums.where(F.col("first") < F.col("last")).drop("last"), "shared")
    limit = max(hot_rows, rows.count() // MOST_HOT)
    hot = shared.where(F.col("members") > limit).drop("members")
    cold = shared.where(F.col("members") <= limit).drop("members")
    if not hot.limit(1).count():
        return rows.join(cold.hint("merge"), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))


def contexts(texts: DataFrame, least: int, window: int) -> DataFrame:
    """The words around retained suffixes of ``texts`` (name, low, high, copied, places, text): a row for each, and for a copied text
    one without words for the whole of it."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CONTEXT.split(", "))])
    before = window - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for name, low, high, copied, places, value in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                text = value.as_py()
                words = lower_words(text)
                if len(words) < least:
                    continue
                starts, ends = _word_bounds(text)
                if copied:
                    rows.append((None, None, name, 0, int(starts[0]), None, low, high, len(words), int(ends[-1])))
                blank = starts[1:] - ends[:-1]
                for p in places or ():
                    a, b = max(0, p - before), min(len(words), p + least)
                    gaps = blank[a : b - 1]
                    packed = gaps.astype(np.uint8 if gaps.max() < 256 else np.uint32).tobytes()
                    rows.append((b" ".join(words[p:b]) + b" ", b" ".join(words[a:p][::-1]), name, p, int(starts[p]), packed, low, high, b - p, 0))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("name", "low", "high", "copied", "places", "text").mapInArrow(task, CONTEXT)


class Suffix:
    """A row of the suffix array: its words to the right and, from the nearest on, to the left. They are kept as bytes, an eighth of
    the memory of lists, and split when they are asked for."""

    __slots__ = ("right_words", "left_words", "name", "at", "start", "gaps", "low", "high")

    def __init__(self, right: bytes, left: bytes, name: int, at: int, start: int, gaps: bytes, low: int, high: int):
        self.right_words, self.left_words = right, left
        self.name, self.at, self.start, self.gaps, self.low, self.high = name, at, start, gaps, low, high

    @property
    def right(self) -> list[bytes]:
        return self.right_words[:-1].split(b" ")

    @property
    def left(self) -> list[bytes]:
        return self.left_words.split(b" ") if self.left_words else []

    def bounds(self, before: int, after: int) -> tuple[int, int]:
        """Code points at which the word ``before`` places to the left starts, and the last of ``after`` words to the right ends."""
        left, right = self.left, self.right
        n = len(left)
        gaps = np.frombuffer(self.gaps, np.uint8 if len(self.gaps) < n + len(right) else np.uint32).astype(np.int64)
        start = self.start - sum(map(_length, left[:before])) - int(gaps[n - before : n].sum())
        return start, self.start + sum(map(_length, right[:after])) + int(gaps[n : n + after - 1].sum())


def _length(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "surrogatepass"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 12)], [x.split()[0] for x in FOUND.split(", ")])


def compared(group: list[Suffix], is_open: np.ndarray, least: int, window: int, part: int) -> Iterator[tuple]:
    """Rows of FOUND for a part of the order: the longest stretch around each suffix that runs of other documents cover.

    Groups that are open may have members elsewhere. Of theirs, runs that no other document has here are told as stretches with a fingerprint. A run that
    several documents have here is told once, as a class; their stretches name the set of classes they come from, whose smallest document
    may be elsewhere.
    """
    m, before = len(group), window - 1
    numbers: dict[bytes, int] = {}
    number = lambda w: numbers.setdefault(w, len(numbers))
    right, left = np.full((m, least), -1, np.int32), np.full((m, before), -1, np.int32)
    has_right, has_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for i, s in enumerate(group):
        to_right, to_left = s.right, s.left
        has_right[i], has_left[i] = len(to_right), len(to_left)
        right[i, : len(to_right)] = [number(w) for w in to_right]
        left[i, : len(to_left)] = [number(w) for w in to_left]
    common = np.zeros(m, np.int64)
    common[1:] = np.cumprod(right[1:] == right[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    del right
    low, high = np.array([s.low for s in group]), np.array([s.high for s in group])
    farthest, nearest, first = np.full(m, -1), np.full(m, window), np.full(m, np.iinfo(np.int64).max)
    same_left = np.zeros(m, np.int64)
    classes, unit = np.full((m, window), -1, np.int64), 1 << 28
    for back in range(window):
        if back:
            same_left = np.unique(same_left * (len(numbers) + 1) + left[:, back - 1] + 1, return_inverse=True)[1]
        ahead = least - back
        key = np.cumsum(common < ahead) * m + same_left
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        sizes = np.diff(np.append(heads, m))
        lowest, highest, lead = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int64)
        lowest[order] = np.repeat(np.minimum.reduceat(low[order], heads), sizes)
        highest[order] = np.repeat(np.maximum.reduceat(high[order], heads), sizes)
        lead[order] = np.repeat(order[heads], sizes)
        whole = (has_right >= ahead) & (has_left >= back)
        hit = (lowest < highest) & whole
        farthest[hit] = back
        nearest[hit] = np.minimum(nearest[hit], back)
        first[hit] = np.minimum(first[hit], lowest[hit])
        classes[hit, back] = lead[hit]
        for i in np.flatnonzero(whole & is_open & ((lead == np.arange(m)) | ~hit)):
            s = group[i]
            name = xxhash.xxh128_intdigest(b" ".join(s.left[:back][::-1] + s.right[:ahead]))
            ka, kb = ((x ^ (1 << 63)) - (1 << 63) for x in (name >> 64, name & ((1 << 64) - 1)))
            if hit[i]:
                yield None, int(lowest[i]), int(highest[i]), None, None, None, None, None, ka, kb, part * unit + int(i) * window + back, None
            else:
                yield s.name, s.low, s.high, s.at - back, least, *s.bounds(back, ahead), None, ka, kb, None, None
    named: dict[bytes, int] = {}
    for i in np.flatnonzero(farthest >= 0):
        s, back, ahead, of = group[i], int(farthest[i]), least - int(nearest[i]), None
        if is_open[i]:
            held = classes[i].tobytes()
            if (of := named.get(held)) is None:
                of = named[held] = part * unit + int(i)
                for back_of, c in enumerate(classes[i].tolist()):
                    if c >= 0:
                        yield None, None, None, None, None, None, None, None, None, None, part * unit + c * window + back_of, of
        yield s.name, s.low, s.high, s.at - back, back + ahead, *s.bounds(back, ahead), None if is_open[i] else int(first[i]), None, None, None, of


def neighbours(sorted_contexts: DataFrame, least: int, window: int, most_held: int) -> DataFrame:
    """Rows of FOUND from sorted rows of CONTEXT. Open groups are the first and last of a range, and those of more than ``most_held`` rows."""
    prefix = least - window + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[Suffix] = []
        parts = count(TaskContext.get().partitionId() << 15)
        # where the last group starts in what is held, whether it began before, and the end of a first group that did
        last, cut, open_to = 0, True, 0
        words = None

        def flush(n: int, last_is_open: bool) -> Iterator[pa.RecordBatch]:
            """Compares the first ``n`` of what is held; the group that is cut there, if one is, is open."""
            is_open = np.zeros(n, bool)
            is_open[:open_to] = True
            if last_is_open:
                is_open[last:] = True
            rows = []
            for row in compared(held[:n], is_open, least, window, next(parts)) if n else ():
                rows.append(row)
                if len(rows) >= 20_000:
                    yield _found(rows)
                    rows = []
            yield _found(rows)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                s = Suffix(*row)
                if (head := row[0].split(b" ", prefix)[:prefix]) != words:
                    if cut:
                        open_to = len(held)  # the group that ends here began elsewhere
                    if len(held) >= 20_000:
                        yield from flush(len(held), False)
                        held.clear()
                        open_to = 0
                    last, cut = len(held), words is None
                    words = head
                held.append(s)
                if len(held) - last > most_held:
                    yield from flush(len(held), True)
                    held.clear()
                    last, cut, open_to = 0, True, 0
        if cut:
            open_to = len(held)
        yield from flush(len(held), True)

    return sorted_contexts.mapInArrow(task, FOUND)


def elsewhere(found: DataFrame) -> DataFrame:
    """The stretches of open groups, with the smallest document that has a run of theirs.

    A run comes once from each part of the order if several documents have it there, else once or as often as one document repeats it; a class and a set of
    classes belong to one part. So none of the three windows sees more rows of one key than there are parts, or than a part holds.
    """
    runs, of_class, of_set = (Window.partitionBy(*k) for k in (("ka", "kb"), ("class",), ("classes",)))
    met = found.where("ka IS NOT NULL").withColumns({"first_doc_id": F.min("low").over(runs), "last": F.max("high").over(runs)})
    alone = met.where("class IS NULL AND first_doc_id < last").select(*STRETCH)
    links = found.where("ka IS NULL AND class IS NOT NULL").select("class", "classes", F.lit(None).cast("long").alias("first"))
    told = met.where("class IS NOT NULL").select("class", F.lit(None).cast("long").alias("classes"), F.col("first_doc_id").alias("first"))
    sets = links.unionByName(told).withColumn("first", F.min("first").over(of_class)).where("classes IS NOT NULL").select("classes", "first")
    here = found.where("ka IS NULL AND class IS NULL").withColumn("first", F.lit(None).cast("long"))
    both = here.unionByName(sets, allowMissingColumns=True).withColumn("first_doc_id", F.min("first").over(of_set)).where("name IS NOT NULL")
    return alone.unionByName(both.select(*STRETCH))


def merged(runs: DataFrame) -> DataFrame:
    """Overlapping stretches (name, at, n, start, end, first_doc_id, low, copied) of a text become its longest passages."""
    names = ["name", "low", "copied", "at", "n", "start", "end", "first_doc_id"]
    schema = "name long, low long, copied boolean, at long, n long, start long, end long, first_doc_id long"
    types = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            out: list[list] = []
            for name, low, copied, at, n, start, end, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[:2] == [name, low] and at <= now[3] + now[4]:
                    now[4] = max(now[4], at + n - now[3])
                    now[6] = max(now[6], end)
                    now[7] = min(now[7], first)
                else:
                    if now:
                        out.append(now)
                    now = [name, low, copied, at, n, start, end, first]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now, types, strict=True)], names)

    ordered = runs.select(*names).repartition("name", "low").sortWithinPartitions("name", "low", "at")
    return ordered.mapInArrow(task, schema)


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = 8, window: int = 16, most_held: int = 100_000) -> DataFrame:
    """(doc_id, start_word, n_words, start, end, first_doc_id): each longest passage of at least ``least`` words that another
    document has too; start and end in code points, and the smallest id among the documents that share a part of it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    named = docs.withColumns({"name": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")})
    suffix = stored(suffixes(named, least - window + 1, gram, window), "suffixes")
    places = shared_rows(suffix, ["key"], "name", "name").groupBy("name").agg(F.collect_set("at").alias("places"))
    members = named.select("name", "more", "doc_id").distinct()
    classes = members.groupBy("name", "more").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    wanted = stored(classes.join(places, "name", "left").withColumn("copied", F.col("low") < F.col("high")).where("copied OR places IS NOT NULL"), "wanted")
    forget(suffix)
    # a class is told by its smallest document and its text's hash: of repeated rows one is read
    texts = named.select("name", "more", F.col("doc_id").alias("low"), "text").join(wanted, ["name", "more", "low"]).dropDuplicates(["name", "more", "low"])
    rows = stored(contexts(texts, least, window), "contexts", compression="zstd")
    array = rows.where("right IS NOT NULL").repartitionByRange("right", "left", "name", "at").sortWithinPartitions("right", "left", "name", "at")
    found = stored(neighbours(array, least, window, most_held), "found")
    opened = elsewhere(found.where("first_doc_id IS NULL").drop("first_doc_id"))
    whole = rows.where("right IS NULL").select("name", "low", "high", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "start", "end", F.col("low").alias("first_doc_id"))
    every = found.where("first_doc_id IS NOT NULL").select(*STRETCH).unionByName(opened).unionByName(whole)
    passages = stored(merged(every.withColumn("copied", F.col("low") < F.col("high"))), "passages")
    shown = [F.col("at").alias("start_word"), F.col("n").alias("n_words"), "start", "end", "first_doc_id"]
    copies = passages.where("copied").join(wanted.where("copied").select("name", "more", "low").join(members, ["name", "more"]), ["name", "low"])
    return passages.where("NOT copied").select(F.col("low").alias("doc_id"), *shown).unionByName(copies.select("doc_id", *shown))
