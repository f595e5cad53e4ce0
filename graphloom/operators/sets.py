"""Sets of vertex ids and largest rows by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def except_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def symmetric_difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in one of the sets only."""
    sides = a.select("id").distinct().unionAll(b.select("id").distinct())
    return sides.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")


def top_k(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; cut to k in the map tasks before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def all_true(flags: DataFrame, column: str) -> DataFrame:
    """(done): whether a flag holds for all rows; true without rows."""
    return flags.agg(F.coalesce(F.bool_and(column), F.lit(True)).alias("done"))


def fold(partials: Iterable, merge: Callable):
    """Left fold of a few results on the driver; null without results."""
    out = None
    for k, x in enumerate(partials):
        out = x if k == 0 else merge(out, x)
    return out


def for_each_partition(df: DataFrame, action: Callable[[Iterable], None]) -> None:
    """Runs an action with side effects over the rows of each partition."""
    df.foreachPartition(action)
