"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join. DataFrame functions only.

A list entry is a host and the start of a path. It fits a URL whose host is the entry's host or a subdomain of it and
whose path starts with the entry's path; the longest fitting entry decides. The candidate keys of a URL are its host
suffixes crossed with the starts of its path whose length some entry has. Keys that the Bloom filter lets pass are
joined exactly with the list, so false positives of the filter never reach the result.

The filter is a table of its blocks. Each key meets its own block by a join on the block's number, which Spark broadcasts where the
filter is small and shuffles where it is not, so a list of any length takes the same way.

Defined results: a null URL, or one without "://", has host and path empty and no rule; repeated rows are judged each;
entries with a null host or path are ignored; of entries that are listed twice with both verdicts "block" wins; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block (four 64-bit words), bits set for each key, bits of filter for each key.
BLOCK_WORDS, PROBES, BITS_PER_KEY = 4, 6, 16


def _fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Canonical host and path."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return _fold(F.regexp_extract(tail, r"^([^/?#]*)", 1)), F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)


def _bits(key: Column, blocks: Column) -> tuple[Column, list[tuple[Column, Column]]]:
    """The block of a key, and the word and mask of each of its bits."""
    where = F.pmod(F.xxhash64(key), blocks)
    pick = F.xxhash64(key, F.lit(1))
    out = []
    for k in range(PROBES):
        bit = F.shiftrightunsigned(pick, 8 * k).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1))
        out.append((F.floor(bit / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))))
    return where, out


def bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter of column ``key`` as a table (block, w0, w1, ...) of its blocks that are not empty, and its number of blocks."""
    blocks = 1 << max(0, (n_keys * BITS_PER_KEY // (64 * BLOCK_WORDS)).bit_length())
    where, bits = _bits(F.col("key"), F.lit(blocks))
    set_bits = keys.select(where.alias("block"), F.explode(F.array(*[F.struct(w.alias("word"), m.alias("mask")) for w, m in bits])).alias("b"))
    return set_bits.groupBy("block").agg(*[F.bit_or(F.when(F.col("b.word") == k, F.col("b.mask")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(BLOCK_WORDS)]), blocks


def judge_urls(
    pages: DataFrame, listed: DataFrame, keep: tuple[str, ...] = ("page_id",), default: str = "allow"
) -> DataFrame:
    """``keep`` columns of ``pages`` (url), with host, path, rule and verdict.

    ``listed``: (host, path, verdict); an entry of path "/" or "" holds for a whole site.
    """
    rules = (
        listed.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(_fold(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("key", F.concat_ws("\x00", "rule_host", "rule_path"))
    )
    stats = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    host, path = split_url(F.col("url"))
    seen = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not stats["n"]:
        return seen.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = seen.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    # no longer suffix than the longest listed host can be one, so a host of many labels has no more keys
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - stats["labels"] + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(stats["lengths"])])
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat_ws("\x00", h, p))))
    made, blocks = bloom(rules, stats["n"])
    where, bits = _bits(F.col("key"), F.lit(blocks))
    words = F.array(*[f"w{k}" for k in range(BLOCK_WORDS)])
    hit = F.lit(True)
    for word, mask in bits:
        hit = hit & (F.get(words, word).bitwiseAND(mask) != 0)
    possible = urls.select("host", "path", F.explode(keys).alias("key")).withColumn("block", where).join(made, "block").where(hit)
    best = (
        possible.select("host", "path", "key")
        .join(rules, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best"))
    )
    # rows without host have no rule: they need not meet in one task
    nothing = seen.where("host = ''").select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = seen.where("host <> ''").join(best, ["host", "path"], "left").select(
        *keep,
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
    return judged.unionAll(nothing)
