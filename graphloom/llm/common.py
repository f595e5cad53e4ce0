"""Helpers that the training-data operators share: tables, scratch tables, folds, words and connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.lineage import forget, shared_dir, stored

__all__ = ["Forest", "WordHashes", "components", "fold", "forget", "gram_hashes", "lower_words", "mix", "shared_dir", "stored", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts))


def lower_words(text: str | None) -> list[bytes]:
    """Words (runs of characters but for 20 and 09-0D) in UTF-8 with A-Z lower-cased.

    On bytes, lower() and split() touch exactly A-Z and those six blanks; on str they would also fold and cut others.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, computed once for each; emptied when it grows large, so memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the well-known splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; with fewer words, of the whole run as one; without words, none.

    Hashes of runs of 1, 2, 4, ... words are made from each other, and those that add up to ``n`` are chained.
    """
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    starts = len(hashes) - n + 1
    out, done, span, runs = None, 0, 1, mix(hashes + _ODD)
    while True:
        if n & span:
            part = runs[done : done + starts]
            out = part if out is None else mix(out * _ODD + part)
            done += span
        if 2 * span > n:
            return out
        runs = mix(runs[:-span] * _ODD + runs[span:])
        span *= 2


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
