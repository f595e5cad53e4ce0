"""Hierarchical multi-length packing of tokenised documents.

Documents go to the smallest context tier that holds them; longer ones are cut into full windows of the top tier and a
rest, which goes to its own tier. Each tier is packed best-fit, the gap at the end of a window is filled with whole
pieces of shorter tiers and at last with a cut of one, and windows are dealt to step groups of equal tokens. Packing
works inside each task on what it reads, in buffers of a bounded number of tokens: there is no shuffle, memory does not
grow with the input, and what a lost executor had done is done again from its input split alone.

Defined results: null or empty text is a document of the terminal id only; an id that repeats is packed once per row;
a null ``doc_id`` stays null; an empty table gives no rows; other columns of the input are ignored, so their names
cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (512, 1024, 2048, 4096)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
#: Chunks longer than this, and chunks beyond so many, are encoded anew each time: a task's cache stays bounded.
CHUNK_CHARS, CHUNKS = 40, 1_500_000


class ChunkIds(dict):
    """Ids of the space-free chunks of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins characters across it, so a text's ids are its chunks' ids in
    order; each chunk is encoded once and looked up afterwards. It also folds A-Z and cuts letters from what follows
    them, so a chunk with capitals or with a comma or full stop after a letter is made from what is known.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.encode_chunk = Tokenizer.from_file(tokenizer_path).encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if "<|" not in chunk:  # may hold a special token, which is matched before folding
            if chunk.isascii() and (low := chunk.lower()) != chunk:
                return self[low]
            if chunk[-1] in ",." and chunk[-2:-1].isalpha() and chunk[-2] < "\u0250":
                return self[chunk[:-1]] + self[chunk[-1]]
        out = np.array(self.encode_chunk(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CHUNKS and len(chunk) <= CHUNK_CHARS:
            self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))) if text else b""


@lru_cache(maxsize=1)
def _chunk_ids(tokenizer_path: str) -> ChunkIds:
    """One cache for all tasks of a Python worker."""
    return ChunkIds(tokenizer_path)


class Packer:
    """Packs the documents of one task; pieces are (row, start, length)."""

    def __init__(self, tiers: tuple[int, ...], first_sequence: int, group_tokens: int):
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.next_sequence = first_sequence
        self.group_tokens = group_tokens
        #: Of each tier: the step group that is being filled, and its tokens so far.
        self.groups = {t: [None, 0] for t in self.tiers}
        self.next_group = first_sequence

    def _close(self, pieces: list, tier: int) -> Iterator[tuple]:
        group = self.groups.setdefault(tier, [None, 0])
        if group[0] is None or group[1] + tier > self.group_tokens:
            group[0], group[1] = self.next_group, 0
            self.next_group += 1
        group[1] += tier
        offset = 0
        for row, start, length in pieces:
            yield row, start, length, self.next_sequence, offset, tier, group[0]
            offset += length
        self.next_sequence += 1

    def pack(self, sizes: list[int]) -> Iterator[tuple]:
        """All pieces of documents of these sizes: (row, start, length, sequence, offset, tier, step group)."""
        top, tiers = self.top, self.tiers
        pools: dict[int, list] = {t: [] for t in tiers}
        for row, n in enumerate(sizes):
            start = 0
            while n - start >= top:
                yield from self._close([(row, start, top)], top)
                start += top
            if n > start:
                left = n - start
                pools[next(t for t in tiers if left <= t)].append((left, row, start))
        for pool in pools.values():
            pool.sort()
        for at in range(len(tiers) - 1, -1, -1):
            tier, pool = tiers[at], pools[tiers[at]]
            lower = [pools[t] for t in tiers[at - 1 :: -1]] if at else []
            while pool and (sum(p[0] for p in pool[-2:]) >= tier or any(lower) or len(pool) > 2):
                window, gap = [], tier
                while gap:
                    best = next((b for b in self._fits(gap, pool, *lower)), None)
                    if best is not None:
                        length, row, start = best
                        window.append((row, start, length))
                        gap -= length
                        continue
                    donor = next((p for p in (*lower[::-1], pool) if p), None)
                    if donor is None:
                        break
                    length, row, start = donor.pop(0) if donor is not pool else pool.pop()
                    window.append((row, start, gap))
                    self._put(pools, length - gap, row, start + gap)
                    gap = 0
                if gap:
                    for row, start, length in window:  # not enough left to fill it: shorter windows below
                        self._put(pools, length, row, start)
                    break
                yield from self._close(window, tier)
        rest = sorted((p for pool in pools.values() for p in pool), reverse=True)
        yield from self._tail([(row, start, length) for length, row, start in rest])

    def _fits(self, gap: int, *pools: list) -> Iterator[tuple]:
        """The longest whole piece that fits, of the first tier that has one."""
        for pool in pools:
            k = bisect_right(pool, (gap, 1 << 62, 0))
            if k:
                yield pool.pop(k - 1)
                return

    def _put(self, pools: dict[int, list], length: int, row: int, start: int) -> None:
        if length:
            insort(pools[next(t for t in self.tiers if length <= t)], (length, row, start))

    def _tail(self, pieces: list[tuple]) -> Iterator[tuple]:
        """What is left of a buffer goes to windows of falling powers of two, each of them full."""
        left = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = min(1 << (left.bit_length() - 1), self.top)
            window, gap = [], size
            while gap:
                row, start, length = pieces.pop()
                window.append((row, start, min(length, gap)))
                if length > gap:
                    pieces.append((row, start + gap, length - gap))
                gap -= min(length, gap)
            left -= size
            yield from self._close(window, size)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 2,
    buffer_tokens: int = 2_000_000,
    group_sequences: int = 16,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text). ``tiers`` are powers of two; a step group holds at most
    ``group_sequences`` windows of the top tier, or as many tokens of a shorter one."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([(n.split()[0], pa.int32() if n.split()[1] == "int" else pa.int64()) for n in SCHEMA.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = _chunk_ids(tokenizer_path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 40, group_sequences * max(tiers))
        ids: list[bytes] = []
        keys: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in schema]
            for row, start, length, *where in packer.pack([len(x) // 4 for x in ids]):
                crc = zlib.crc32(memoryview(ids[row])[4 * start : 4 * (start + length)])
                for c, v in zip(cols, (keys[row], start, length, crc, len(ids[row]) // 4, *where), strict=True):
                    c.append(v)
            ids.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(ids_of.encode(text.as_py()) + end)
                keys.append(key)
                held += len(ids[-1]) // 4
                if held >= buffer_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, SCHEMA)
