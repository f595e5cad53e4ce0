"""Katz backoff model of any order: Good-Turing discounted counts, exactly normalised backoff weights, partitioned tables.

    P(w | h) = d(c(h w)) c(h w) / c(h)      if the n-gram h w was seen in training
             = alpha(h) P(w | h')           otherwise, with h' = h without its first word
    P(w)     = d(c(w)) c(w) / N             for known words; what is left of 1 goes to one unknown word

alpha(h) is what the seen n-grams of h leave of 1, over what P(. | h') leaves of 1 outside their words, so each P(. | h) sums to 1 over
the known words and the unknown one; for a context never seen it is 1. Where discounting leaves nothing, 1 is added to the denominator.
Contexts at the start of a document are filled up with a begin mark. Discounts are estimated for each order.

Documents are dealt to blocks of bounded size, kept as word numbers. An order at a time, blocks send their n-grams, sorted and packed, to
buckets, which sum over blocks and answer each block with counts in the order in which it sent them. A context's count is that of an n-gram
of the order below, so a block knows beforehand which contexts no other block has (held-out documents are counted for that) or were never seen in training: it
evaluates those itself, and sends n-grams of shared contexts only. N-grams travel with the counts of their shorter n-gram, so buckets sum what alpha takes.
Buckets are dealt by context; contexts whose count exceeds a share of a bucket are dealt by context and word, and their sums, few for each
bucket, are added up in the driver, so no bucket depends on one context. A block then evaluates each token from the words upwards: the
n-gram's number, else the context's weight times the probability with the shorter context. Memory is bounded by block and bucket, disk by
one order's messages; every document counts and is scored.

Words are known by 48 bits of a 64-bit hash, longer contexts by 62; words that share them (one expected pair in 20 million words or so) are one word.

Defined results: null text is empty and scores its end alone; repeated rows count and are scored each; a null id is not held out;
without training documents all probability is the unknown word's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, lower_words, mix, stored

BEGIN, END = 1, 2
SENT = "bucket int, block int, kind string, blob binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])


# packing of arrays ------------------------------------------------------------------------------------------------

#: The narrowest type that holds a number of bytes.
_HOLDS = ["<u1", "<u1", "<u2", "<u4", "<u4", "<i8", "<i8", "<i8", "<i8"]


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as compressed bytes, each cut into planes of like bytes, as many as its largest number takes."""
    parts = []
    for a in arrays:
        if a.dtype.kind == "f" or len(a) and a.min() < 0:
            width, a = 8, a.astype("<f8" if a.dtype.kind == "f" else "<i8")
        else:
            width = (int(a.max(initial=0)).bit_length() + 7) // 8
            a = a.astype(_HOLDS[width])
        parts.append(len(a).to_bytes(8, "little") + bytes([width]))
        whole, planes = a.view(np.uint8), np.empty((width, len(a)), np.uint8)
        for i in range(width):  # several times faster than one transposed copy
            planes[i] = whole[i :: a.itemsize]
        parts.append(planes.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    out, at = [], 0
    for kind in kinds:
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        a = np.zeros(n, "<f8" if kind == "f" else _HOLDS[width])
        whole, planes = a.view(np.uint8), np.frombuffer(raw, np.uint8, width * n, at + 9).reshape(width, n)
        for i in range(width):
            whole[i :: a.itemsize] = planes[i]
        out.append(a.astype("<i8", copy=False) if kind == "i" else a)
        at += 9 + width * n
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def pack_grams(first: np.ndarray, second: np.ndarray, place: np.ndarray, of_context: list[np.ndarray], of_gram: list[np.ndarray]) -> bytes:
    """N-grams sorted by context: each context once, with how many n-grams it has; last words by their place among the common ones,
    counted from 1, else (place 0) in full."""
    heads = _heads(first)
    return pack(deltas(first[heads]), np.diff(heads, append=len(first)), *[x[heads] for x in of_context], place, second[place == 0], *of_gram)


def unpack_grams(blob: bytes, of_context: int, of_gram: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(contexts, how many n-grams each has, second, of_context, of_gram): second and of_gram as ``pack_grams`` took them, of_context once for each context."""
    steps, sizes, *rest = unpack(blob, "i" * (4 + of_context + of_gram))
    places, rare, *grams = rest[of_context:]
    second = common[np.maximum(places - 1, 0)]
    second[places == 0] = rare
    return np.cumsum(steps), sizes, second, rest[:of_context], grams


def _heads(first: np.ndarray) -> np.ndarray:
    """Places at which a context begins."""
    return np.flatnonzero(_begins(first))


def _begins(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: does another one begin here."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


# memory -----------------------------------------------------------------------------------------------------------


def _trim() -> None:
    """Gives memory that is free back to the system: workers stay alive between groups, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f``, after which free memory is given back."""

    def task(table: pa.Table) -> pa.Table:
        out = f(table)
        _trim()
        return out

    return task


# blocks -----------------------------------------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word) >> 16) | (1 << 47)  # never BEGIN or END


def word_hashes(words: np.ndarray) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(16)).astype(np.int64) | (1 << 47)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, as ``lower_words`` cuts them, but in one go: how many each text has, their numbers, and words by number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    number, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    empty = np.flatnonzero(words == b"")
    if len(empty):  # before and after blanks at the ends of a text
        kept = number != empty[0]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        number = number[kept]
        number[number > empty[0]] -= 1
        words = np.delete(words, empty)
    return sizes, number, words


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts that are longer by the word that follows."""
    return (mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)


def sorted_keys(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys (0 to ``bound``, exclusive) in their order, equal ones as they stand, and the sorted keys."""
    bits = len(keys).bit_length()
    if bound << bits >= 1 << 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    keys = keys << bits  # a plain sort of keys with their places is several times faster
    keys |= np.arange(len(keys))
    keys.sort()
    order = keys & ((1 << bits) - 1)
    keys >>= bits
    return order, keys


def sorted_places(keys: np.ndarray, bound: int) -> np.ndarray:
    """Places of keys (0 to ``bound``, exclusive) in their order, equal ones as they stand."""
    return sorted_keys(keys, bound)[0]


def distinct(a: np.ndarray, b: np.ndarray, of_a: int, of_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ``a`` (below ``of_a``) and ``b`` (below ``of_b``) without repeats, sorted: both, where each occurs first, and the pair at each place."""
    keys = a.astype(np.int64)
    keys *= of_b
    keys += b
    order, keys = sorted_keys(keys, of_a * of_b)
    new = _begins(keys)
    del keys
    at = order[new].astype(np.int32)
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return a[at], b[at], at, of


def index_block(ids: list[int | None], texts: pa.Array | list[str | None], held_out: list[bool]) -> bytes:
    """Documents as numbers of words: ids, held-out flags, sizes, sorted hashes of words, the places there of words as they first
    occur (the end's first), tokens."""
    sizes, number, words = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    hashes, rank = np.unique(np.append(END, word_hashes(words)), return_inverse=True)
    null = np.array([i is None for i in ids], bool)
    whole = np.array([0 if i is None else i for i in ids], np.int64)
    return pack(null, whole, np.array(held_out, bool), sizes + 1, deltas(hashes), rank, np.insert(number + 1, np.cumsum(sizes), 0))


class Block:
    """Some documents: words in the order of their hashes, tokens as ranks in it."""

    def __init__(self, blob: bytes):
        null, ids, held, self.sizes, steps, rank, number = unpack(blob, "iiiiiii")
        self.ids = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.held = held.astype(bool)
        self.words = np.cumsum(steps)
        self.token = rank.astype(np.int32)[number]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.held_at = np.flatnonzero(np.repeat(self.held, self.sizes)).astype(np.int32)

    def dealt_words(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        return _by_bucket(word_bucket(self.words, buckets), buckets)


def _counted(of: np.ndarray, held_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram occurs in training documents of the block, and in others."""
    held = np.bincount(of[held_at], minlength=size)
    return (np.bincount(of, minlength=size) - held).astype(np.int32), held.astype(np.int32)


class Words:
    """The words of a block as n-grams of length 1; ``count``, in training documents, and ``held``, in others, are set once they are known."""

    def __init__(self, block: Block):
        self.of, self.hash = block.token, block.words
        self.local, self.local_held = _counted(self.of, block.held_at, len(block.words))


class Level:
    """N-grams of one length of a block, sorted by context and word. Contexts are the n-grams of ``below``, and one more of begin marks only."""

    def __init__(self, block: Block, words: Words, below: Words | Level):
        self.below, self.words, begin = below, block.words, len(below.hash)
        self.context = np.empty(len(block.token), np.int32)
        self.context[1:] = below.of[:-1]
        self.context[block.starts] = begin
        self.owner, self.second, self.at, self.of = distinct(self.context, block.token, begin + 1, len(block.words))
        self.context_hash = np.append(below.hash, BEGIN)
        self.local, self.local_held = _counted(self.of, block.held_at, len(self.owner))
        end = np.searchsorted(block.words, END)
        self.total = np.append(below.count, words.count[end])
        elsewhere = np.append(below.count - below.local + below.held - below.local_held, words.count[end] + words.held[end] - len(block.sizes))
        self.shared = (self.total > 0) & (elsewhere > 0)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """Hashes of the n-grams; the highest order needs none."""
        return longer(self.context_hash[self.owner], self.words[self.second])

    def shorter(self, model: Model, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams, of the n-gram without its first word: the count, and what its discounted count is divided by."""
        at = self.at[which]
        count = self.below.count[self.below.of[at]]
        if isinstance(self.below, Words):
            return count, np.full(len(count), model.unigrams.denominator)
        return count, (self.below.total + self.below.extra)[self.below.context[at]]

    def dealt(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, where each begins in the n-grams of shared contexts, and those, by bucket sorted by the context's hash and the word."""
        at = np.flatnonzero(self.shared[self.owner])
        owner = self.owner[at]
        heads = _heads(owner)
        sizes = np.diff(heads, append=len(at))
        hashes, parts = self.context_hash[owner[heads]], model.parts(self.total[owner[heads]])
        rank = np.empty(len(heads), np.int64)
        rank[np.argsort(hashes)] = np.arange(len(heads))
        bucket, n = (hashes >> 5) % model.buckets, max(1, len(heads))
        keys = np.repeat(bucket * n + rank, sizes)
        wide = parts > 1  # few, so each n-gram's own bucket is worked out for theirs only
        if wide.any():
            apart = np.flatnonzero(np.repeat(wide, sizes))
            bucket, rank, parts = (np.repeat(x[wide], sizes[wide]) for x in (bucket, rank, parts))
            keys[apart] = (bucket + (self.words[self.second[at[apart]]] >> 9) % parts) % model.buckets * n + rank
        order, keys = sorted_keys(keys, model.buckets * n)
        cuts = np.searchsorted(keys, np.arange(model.buckets + 1) * n)
        filled = np.flatnonzero(np.diff(cuts))
        return filled, cuts[filled], at[order]

    def send(self, model: Model, m: int, number: int) -> Iterator[tuple]:
        """Messages to buckets, and numbers of n-grams by count of the contexts that no other block has."""
        buckets, cuts, at = self.dealt(model)
        count, divisor = self.shorter(model, at)
        owner, second, local = self.owner[at], self.second[at], self.local[at]
        held = self.local_held[at] if m < model.order else np.zeros_like(local)
        columns = [
            self.context_hash[owner], self.words[second], model.places(self.words)[second],
            (model.parts(self.total) > 1).astype(np.int8)[owner], divisor, local, held, np.where(local > 0, count, 0),
        ]
        for bucket, start, end in zip(buckets.tolist(), cuts, np.append(cuts, len(at))[1:], strict=True):
            first, word, place, split, below, *of_gram = (x[start:end] for x in columns)
            yield bucket, number, "p", pack_grams(first, word, place, [split, below], of_gram)
        own = self.local[~self.shared[self.owner]]
        yield number % model.buckets, number, "t", pack(np.bincount(np.minimum(own, model.k + 2), minlength=model.k + 3))

    def resolve(self, model: Model, m: int, answer: Callable[[int], bytes]) -> None:
        """Sets counts, and of contexts ``extra``, added to their counts, and ``weight``, log10 of alpha where a token needs it."""
        k, d, n = model.k, model.d[m], len(self.context_hash)
        lost = np.arange(1, k + 1) * (1 - d[1 : k + 1])
        self.count, self.held = self.local.astype(np.int64), self.local_held.astype(np.int64)
        left, p = np.zeros(n), np.zeros(n)
        buckets, cuts, at = self.dealt(model)
        if len(at):
            got = []
            for b in buckets.tolist():
                counts, held, *few, sums = unpack(answer(b), "i" * (k + 2) + "f")
                got.append((counts, held, sum(x * y for x, y in zip(few, lost, strict=True)), sums))
            counts, held, lefts, sums = (np.concatenate(x) for x in zip(*got, strict=True))
            self.count[at], self.held[at] = counts, held
            begins = _begins(self.owner[at])
            begins[cuts] = True
            heads = np.flatnonzero(begins)
            left[self.owner[at[heads]]] = lefts
            p[self.owner[at[heads[_asked(heads, counts)]]]] = sums
        known, few, sums = model.split[m]
        if len(known):
            shared = np.flatnonzero(self.shared)
            hashes = self.context_hash[shared]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[place] == hashes
            left[shared[found]], p[shared[found]] = (few * lost).sum(axis=1)[place[found]], sums[place[found]]
        own = np.flatnonzero(~self.shared[self.owner] & (self.count > 0))
        owner = self.owner[own]
        left += np.bincount(owner, np.concatenate([[0], lost, [0]])[np.minimum(self.count[own], k + 1)], n)
        below, divisor = self.shorter(model, own)
        p += np.bincount(owner, discounted(below, model.d[m - 1]) / divisor, n)
        self.extra = ((self.total > 0) & (left <= 1e-9 * self.total)).astype(np.int64)
        self.weight = np.zeros(n)
        need = np.zeros(n, bool)
        need[self.owner[self.count == 0]] = True
        need &= (self.total > 0) & (p < 1)
        self.weight[need] = np.log10((left + self.extra)[need] / (self.total + self.extra)[need] / (1 - p[need]))

    def evaluated(self, model: Model, m: int, logs: np.ndarray) -> np.ndarray:
        """log10 probabilities of the tokens, from those with the shorter context."""
        seen = np.full(len(self.count), np.nan)
        known = np.flatnonzero(self.count)
        seen[known] = np.log10(np.maximum(discounted(self.count[known], model.d[m]), 1e-300) / np.maximum(self.total + self.extra, 1)[self.owner[known]])
        out = seen[self.of]
        return np.where(np.isnan(out), self.weight[self.context] + logs, out)


def _asked(heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of contexts that begin at ``heads``: has one of their n-grams a count of 0, so that alpha is needed."""
    return np.minimum.reduceat(counts, heads) == 0


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> 7) % buckets


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order, ordered = sorted_keys(bucket, buckets)
    cuts = _heads(ordered)[1:]
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


def _packed_docs(docs: DataFrame, blocks: int, held_out_fold: int) -> DataFrame:
    """(bucket = -1, block, kind 'd', blob) rows of compressed documents; the same document always goes to the same block."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold("doc_id") == held_out_fold, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: Counter = Counter()

        def flush(which: list[int]) -> pa.RecordBatch:
            blobs = []
            for b in which:
                table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held.pop(b), strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)], ["doc_id", "text", "held_out"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_batch(table)
                blobs.append(zstandard.compress(sink.getvalue(), 1))
                del sizes[b]
            return pa.RecordBatch.from_arrays([pa.array([-1] * len(which), pa.int32()), pa.array(which, pa.int32()), pa.array(["d"] * len(which)), pa.array(blobs, pa.binary())], schema=_SENT)

        for batch in batches:
            for doc, text, out, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                value = text.as_py()
                held.setdefault(block, []).append((doc, value, out))
                sizes[block] += 100 + len(value or "")
                if sizes.total() > 48 << 20:
                    yield flush([b for b, _ in sizes.most_common(max(1, len(sizes) // 2))])
        if held:
            yield flush(sorted(held))
        _trim()

    return named.mapInArrow(task, SENT)


def _index(table: pa.Table) -> pa.Table:
    """The row (bucket = -1, block, kind 'd', blob) of a block."""
    parts = []
    for v in table.column("blob"):
        with pa.ipc.open_stream(zstandard.decompress(v.as_py())) as reader:
            parts.append(reader.read_all())
    ids, texts, held = pa.concat_tables(parts).combine_chunks().columns
    return _sent([(-1, table.column("block")[0].as_py(), "d", index_block(ids.to_pylist(), pa.concat_arrays(texts.chunks), held.to_pylist()))])


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), _SENT, strict=True)], schema=_SENT)


# training ---------------------------------------------------------------------------------------------------------


def good_turing(n_r: np.ndarray, k: int) -> np.ndarray:
    """Discounts d(0..k) from numbers of n-grams by count (n_r[r], up to k + 1); where the estimate is not within (0, 1), 1."""
    d = np.ones(k + 1)
    if n_r[1] > 0:
        common = (k + 1) * n_r[k + 1] / n_r[1]
        for r in range(1, k + 1):
            if n_r[r] > 0 and common < 1:
                estimate = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - common) / (1 - common)
                if 0 < estimate < 1:
                    d[r] = estimate
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.minimum(c, len(d) - 1)] if len(c) else c.astype(float)


class Unigrams:
    """Probabilities of known words by count, and of the unknown word."""

    def __init__(self, n_r: np.ndarray, tokens: int, types: int, k: int):
        self.n, self.v, self.k = tokens, types, k
        self.d = np.append(good_turing(n_r, k), 1.0)
        kept = tokens - sum(n_r[r] * r * (1 - self.d[r]) for r in range(1, k + 1))
        self.denominator = tokens if tokens - kept > 1e-9 * max(1, tokens) else tokens + 1
        self.unknown = 1 - kept / self.denominator

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.denominator, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


class Model:
    """What blocks and buckets know besides their rows: discounts ``d`` by order, and ``split``, by order, contexts dealt to several
    buckets with their numbers of n-grams by count up to ``k`` and sums of shorter probabilities."""

    def __init__(self, unigrams: Unigrams, order: int, buckets: int, common: np.ndarray):
        self.unigrams, self.order, self.buckets, self.common, self.k = unigrams, order, buckets, common, unigrams.k
        self.most = max(1, unigrams.n // (4 * buckets))
        self.d = {1: unigrams.d}
        self.split: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def places(self, words: np.ndarray) -> np.ndarray:
        """Of words, their places among the common ones, counted from 1; 0 for others."""
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[at] == words, at + 1, 0).astype(np.int32)

    def parts(self, total: np.ndarray) -> np.ndarray:
        """Buckets to which contexts of these counts are dealt."""
        return np.minimum(total // self.most + 1, self.buckets)


def _resolved(table: pa.Table, model: Model, order: int) -> tuple[Block, Iterator[Words | Level]]:
    """A block and its n-grams up to ``order``, from its row and the answers to it. What was made of a level before is not held."""
    kinds, places, blobs = table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("blob")
    of = {(x, b): i for i, (x, b) in enumerate(zip(kinds, places, strict=True))}
    block = Block(blobs[of["d", -1]].as_py())

    def levels() -> Iterator[Words | Level]:
        level = words = Words(block)
        words.count, words.held = np.zeros((2, len(block.words)), np.int64)
        for bucket, at in block.dealt_words(model.buckets):
            words.count[at], words.held[at] = unpack(blobs[of["c1", bucket]].as_py(), "ii")
        yield words
        for m in range(2, order + 1):
            level = Level(block, words, level)
            level.resolve(model, m, lambda bucket, m=m: blobs[of[f"c{m}", bucket]].as_py())
            level.below = None
            yield level

    return block, levels()


def _evaluated(table: pa.Table, model: Model) -> tuple[Block, Words, np.ndarray]:
    """A block, its words and log10 of its tokens' probabilities."""
    block, levels = _resolved(table, model, model.order)
    words = next(levels)
    with np.errstate(divide="ignore"):
        logs = np.log10(model.unigrams.p(words.count))[block.token]
    for m, level in enumerate(levels, 2):
        logs = level.evaluated(model, m, logs)
    return block, words, logs


def _send_words(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(blob.as_py())
                words = Words(block)
                rows = [(bucket, number, "w", pack(deltas(block.words[at]), words.local[at], words.local_held[at])) for bucket, at in block.dealt_words(buckets)]
                yield from _sent(rows).to_batches()

    return task


def _sum_words(k: int):
    """Sums a bucket's words over blocks: numbers of words by count, tokens and types; for each block, counts in its order."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got = [unpack(v.as_py(), "iii") for v in table.column("blob")]
        _, inverse = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
        c, held = (np.bincount(inverse, np.concatenate([g[i] for g in got])).astype(np.int64) for i in (1, 2))
        rows = [(bucket, -1, "S", pack(np.concatenate([np.bincount(np.minimum(c, k + 2), minlength=k + 3), [c.sum(), (c > 0).sum()]])))]
        for block, part in zip(table.column("block").to_pylist(), np.split(inverse, np.cumsum([len(g[0]) for g in got])[:-1]), strict=True):
            rows.append((bucket, block, "c1", pack(c[part], held[part])))
        return _sent(rows)

    return task


def _send(model: Model, m: int):
    def task(table: pa.Table) -> pa.Table:
        block, levels = _resolved(table, model, m - 1)
        words = below = next(levels)
        for level in levels:
            below = level
        return _sent(list(Level(block, words, below).send(model, m, table.column("block")[0].as_py())))

    return task


def _reduce(model: Model, m: int):
    """Sums a bucket over blocks: numbers of n-grams by count; sums of the contexts that are dealt to several buckets; for each block,
    counts in its order, of its contexts the numbers of n-grams by count up to k, and where alpha is needed sums of shorter probabilities."""
    k = model.k

    def grams(table: pa.Table, bucket: int) -> Iterator[tuple]:
        got = [unpack_grams(v.as_py(), 2, 3, model.common) for v in table.column("blob")]
        starts = [np.cumsum([0, *(len(g[i]) for g in got)]) for i in (0, 2)]
        names, sizes, second = (np.concatenate([g[i] for g in got]) for i in (0, 1, 2))
        split, divisor = (np.concatenate([g[3][i] for g in got]) for i in (0, 1))
        n, held, count = (np.concatenate([g[4][i] for g in got]) for i in (0, 1, 2))
        del got
        contexts, place = np.unique(names, return_inverse=True)
        words, word = np.unique(second, return_inverse=True)
        owner, _, _, of = distinct(np.repeat(place, sizes), word, len(contexts), len(words))
        c, c_held = (np.bincount(of, x, len(owner)).astype(np.int64) for x in (n, held))
        shorter = np.zeros(len(owner), np.int64)
        shorter[of[count > 0]] = count[count > 0]
        divisors = np.zeros(len(contexts), divisor.dtype)
        divisors[place] = divisor
        p = np.where(c > 0, discounted(shorter, model.d[m - 1]) / divisors[owner], 0)
        low = np.flatnonzero((c > 0) & (c <= k))
        few = np.bincount(owner[low] * (k + 1) + c[low], minlength=len(contexts) * (k + 1)).reshape(-1, k + 1).T[1:]
        sums = np.bincount(owner, p, len(contexts))
        yield bucket, -1, "T", pack(np.bincount(np.minimum(c, k + 2), minlength=k + 3))
        apart = np.flatnonzero(np.bincount(place, split, len(contexts)))
        if len(apart):
            yield bucket, -1, "H", pack(contexts[apart], *[x[apart] for x in few], sums[apart])
        for block, start, end, first, last in zip(table.column("block").to_pylist(), starts[1], starts[1][1:], starts[0], starts[0][1:], strict=False):
            part, asked = c[of[start:end]], place[first:last]
            heads = np.cumsum(sizes[first:last]) - sizes[first:last]
            yield bucket, block, f"c{m}", pack(part, c_held[of[start:end]], *[x[asked] for x in few], sums[asked[_asked(heads, part)]])

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if table.column("kind")[0].as_py() == "p":
            return _sent(list(grams(table, bucket)))
        return _sent([(bucket, -1, "T", pack(sum(unpack(v.as_py(), "i")[0] for v in table.column("blob"))))])

    return task


def _exchanged(known: DataFrame, model: Model, m: int, slices: int) -> list[DataFrame]:
    """Tables of what ``_reduce`` makes of the messages of all blocks. A slice of the blocks sends at a time, then a slice of the buckets is summed
    at a time and its messages deleted, so the shuffle files behind are those of a slice."""
    if slices == 1:
        sent = known.groupBy("block").applyInArrow(lean(_send(model, m)), SENT)
        return [stored(sent.groupBy("kind", "bucket").applyInArrow(lean(_reduce(model, m)), SENT), "grams", compression="none")]
    part = F.pmod(F.col("bucket"), F.lit(2 * slices)).alias("slice")
    sent = [
        stored(known.where(F.pmod(F.col("block"), F.lit(slices)) == i).groupBy("block").applyInArrow(lean(_send(model, m)), SENT).select("*", part), "sent", by="slice", compression="none")
        for i in range(slices)
    ]
    messages, out = functools.reduce(DataFrame.unionByName, sent), []
    for i in range(2 * slices):
        now = messages.where(F.col("slice") == i).drop("slice")
        out.append(stored(now.groupBy("kind", "bucket").applyInArrow(lean(_reduce(model, m)), SENT), "grams", compression="none"))
        for table in sent:
            forget(table, part=f"slice={i}")
    forget(*sent)
    return out


def _split(reduced: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts dealt to several buckets, sorted, with their sums over buckets. Their parts are about eight for each bucket at most."""
    rows = reduced.where(F.col("kind") == "H").select("bucket", "blob").collect()
    got = [unpack(r["blob"], "i" * (k + 1) + "f") for r in sorted(rows, key=lambda r: r["bucket"])]
    if not got:
        return np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty(0)
    names, *few, sums = (np.concatenate(x) for x in zip(*got, strict=True))
    known, owner = np.unique(names, return_inverse=True)
    return known, np.stack([np.bincount(owner, x, len(known)) for x in few], axis=1), np.bincount(owner, sums, len(known))


def _total(reduced: DataFrame, kind: str, size: int) -> np.ndarray:
    """The sum of small statistics over buckets."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += unpack(v.as_py(), "i")[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    rows = reduced.where(F.col("kind") == kind).select("blob").mapInArrow(task, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def frequent_words(docs: DataFrame, sample: int, common: int) -> np.ndarray:
    """The ``common`` most frequent words of a sample of texts (those of the smallest hashes), sorted. Only how words are written in
    messages depends on them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for v in batch.column(0):
                c.update(lower_words(v.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w, _ in c.most_common(common)], pa.int64())], ["word"])

    spread = docs.select(F.col("text").cast("string").alias("text")).orderBy(F.xxhash64("text", F.lit(5))).limit(sample)
    return np.unique(np.array([END, *[r["word"] for r in spread.mapInArrow(task, "word long").collect()]], np.int64))


# the operator -----------------------------------------------------------------------------------------------------


def score(
    docs: DataFrame, order: int = 3, held_out_fold: int = 1, k: int = 5, block_chars: int = 9_000_000, hot_sample: int = 2000, common: int = 32_768, slices: int = 3
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text), by n-grams of
    up to ``order`` (at least 2) words. The ``common`` most frequent words are found on ``hot_sample`` texts; messages travel in
    ``slices``, which bound the shuffle files behind them."""
    if order < 2:
        raise ValueError("a backoff model needs an order of at least 2")
    chars = docs.agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 50)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    buckets, slices = max(4, 2 * blocks), min(slices, blocks)
    common_words = frequent_words(docs, hot_sample, common)
    tables = [known := stored(_packed_docs(docs, blocks, held_out_fold).groupBy("block").applyInArrow(lean(_index), SENT), "blocks", compression="none")]
    sent = known.select("block", "blob").mapInArrow(_send_words(buckets), SENT)
    reduced = stored(sent.groupBy("bucket").applyInArrow(_sum_words(k), SENT), "words", compression="none")
    tables.append(reduced)
    s = _total(reduced, "S", k + 5)
    unigrams = Unigrams(s[: k + 3], int(s[k + 3]), int(s[k + 4]), k)
    model = Model(unigrams, order, buckets, common_words)
    known = known.unionByName(reduced.where(F.col("kind") == "c1"))
    for m in range(2, order + 1):
        made = _exchanged(known, model, m, slices if m > 2 else 1)
        tables += made
        reduced = functools.reduce(DataFrame.unionByName, made)
        model.d[m] = np.append(good_turing(_total(reduced, "T", k + 3), k), 1.0)
        model.split[m] = _split(reduced, k)
        known = known.unionByName(reduced.where(F.col("kind") == f"c{m}"))

    def evaluate(table: pa.Table) -> pa.Table:
        b, words, logs = _evaluated(table, model)
        known_tokens = words.count[b.token]
        add = lambda x: np.add.reduceat(x, b.starts) if len(x) else x
        cols = [b.ids, pa.array(b.held), pa.array(b.sizes), pa.array(add((known_tokens > 0).astype(np.int64))), pa.array(np.full(len(b.sizes), unigrams.n)), pa.array(add(unigrams.base(words.count)[b.token])), pa.array(add(logs))]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = [
        stored(
            known.where(F.pmod(F.col("block"), F.lit(slices)) == i).groupBy("block").applyInArrow(
                lean(evaluate), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
            ), "scored"
        )
        for i in range(slices)
    ]
    forget(*tables)
    return functools.reduce(DataFrame.unionByName, scored)
