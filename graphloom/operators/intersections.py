"""Common elements of the lists of two vertices, for many pairs at once, without a shuffled row for each candidate.

Vertices are cut into blocks of neighbouring ids. A list stays in its vertex's block and travels once to each block where it has partners; there the
pairs are met by a hash join and compared as arrays. So lists move as often as they have blocks of partners: about once where ids that are near belong
together, and as often as there are blocks at most. A block holds about ``BLOCK`` elements, so there are as many as the lists need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import IN_PLACE, parts, stored

#: Elements of all lists of a block, and rows that a task brings together to lists.
BLOCK, ROWS = 16_000_000, 4_000_000

#: Lists are made of rows that are sorted once.
SORTED = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


def lists_of(rows: DataFrame, n_rows: int) -> DataFrame:
    """(id, list): the sorted distinct ``nbr`` of each id of ``rows`` (id, nbr), of which there are about ``n_rows``; stored."""
    n = parts(rows.sparkSession, n_rows, ROWS)
    sets = rows.repartition(n, "id").sortWithinPartitions("id", "nbr").groupBy("id").agg(F.collect_list("nbr").alias("list"))
    return stored(sets.select("id", F.array_distinct("list").alias("list")), "lists", settings=SORTED)


class Blocks:
    """The cut of ``lists`` (id, list): ``n`` blocks of about equal numbers of elements, and ``of(id)``, a key that is dealt to the block's partition."""

    def __init__(self, lists: DataFrame):
        spark = lists.sparkSession
        total = lists.agg(F.sum(F.size("list"))).first()[0] or 0
        self.n = n = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK))
        weighed = lists.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.size("list") / 64))))
        at = F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n) if n > 1 else F.array().cast("array<bigint>")
        self.borders = sorted(set(weighed.agg(at).first()[0] or []))
        keys = spark.range(64 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()
        self.keys = [k for _, k in sorted(map(tuple, keys))]
        self.keys += [-1 - k for k in range(n - len(self.keys))]

    def of(self, x: Column) -> Column:
        return self._between(x, 0, len(self.borders))

    def _between(self, x: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(self.keys[low]).cast("bigint")
        mid = (low + high) // 2
        return F.when(x < self.borders[mid], self._between(x, low, mid)).otherwise(self._between(x, mid + 1, high))


def closed(lists: DataFrame, rising: bool = False) -> DataFrame:
    """(id, nbr, common): for each element ``nbr`` of each list what the lists of ``id`` and ``nbr`` share, where they share any. To be stored by ``run``.
    ``rising``: lists hold larger ids than their own, so that only what stands behind ``nbr`` can be shared."""
    blocks = Blocks(lists)
    several = lists.where(F.size("list") > 1)
    to = several.select("id", "list", F.posexplode("list").alias("place", "nbr")).withColumn("block", blocks.of(F.col("nbr")))
    new = (F.col("place") == 0) | (F.col("block") != blocks.of(F.get("list", F.col("place") - 1)))
    sent = to.where(new).select("block", "id", "list").repartition(blocks.n, "block")
    pairs = sent.select("block", "id", "list", F.posexplode("list").alias("place", "nbr")).where(blocks.of(F.col("nbr")) == F.col("block"))
    if rising:
        pairs = pairs.where(F.col("place") < F.size("list") - 1)
    both = pairs.join(_home(lists, blocks), ["block", "nbr"])
    # a set is made of the second array of the two, so that is the shorter one
    rest = F.slice("list", F.col("place") + 2, F.size("list")) if rising else F.col("list")
    return both.select("id", "nbr", F.array_intersect("theirs", rest).alias("common")).where(F.size("common") > 0)


def counted(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``common``, the number of elements that the lists of a and b share. To be stored by ``run``."""
    blocks = Blocks(lists)
    n = parts(lists.sparkSession, pairs.count(), ROWS)
    rest = [c for c in pairs.columns if c != "a"]
    groups = pairs.withColumn("block", blocks.of(F.col("b"))).repartition(n, "a").groupBy("a", "block").agg(F.collect_list(F.struct(*rest)).alias("partners"))
    sent = groups.join(lists.repartition(n, "id").withColumnRenamed("id", "a"), "a", "left").repartition(blocks.n, "block")
    each = sent.select("block", "a", "list", F.explode("partners").alias("to")).select("block", "a", "list", "to.*")
    both = each.join(_home(lists, blocks).withColumnRenamed("nbr", "b"), ["block", "b"], "left")
    return both.withColumn("common", F.coalesce(F.size(F.array_intersect("list", "theirs")), F.lit(0)).cast("bigint")).select(*pairs.columns, F.greatest("common", F.lit(0)).alias("common"))


def _home(lists: DataFrame, blocks: Blocks) -> DataFrame:
    return lists.select(blocks.of(F.col("id")).alias("block"), F.col("id").alias("nbr"), F.col("list").alias("theirs")).repartition(blocks.n, "block").hint("shuffle_hash")


def run(df: DataFrame, label: str) -> DataFrame:
    """``df``, made of ``closed`` or ``counted``, stored."""
    return stored(df, label, settings=IN_PLACE | SORTED)
