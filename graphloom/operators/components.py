"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import forget, stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node with an edge.

    Rounds of large-star and small-star over an edge table that is written after each round. Stars shrink by a
    constant factor or better, so a few rounds are enough even for long chains; nothing but a row of two numbers comes
    to the driver. Hubs are met by partial minima and by joins that adaptive execution splits.
    """
    now = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            break
        was = mark
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to u's minimum; read from the smaller end u of each edge
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .where("w <> m")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("e"))
        nxt = stored(small.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), label)
        forget(now)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
