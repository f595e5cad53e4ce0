"""Seeded sampling of neighbors and vertices: uniform or weighted, one or k without replacement.

All randomness is ``uniform(seed, ...)`` of the keys of a row, so results do not depend on the plan and can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..plans.lineage import parts


def with_index(rows: DataFrame, key: str = "id", order: str = "nbr") -> DataFrame:
    """Adds the place ``k`` (from 0) of each neighbor in its vertex's sorted list, and the list's length ``n``."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))


def with_cumulative(rows: DataFrame, weight: str = "weight", key: str = "id", order: str = "nbr") -> DataFrame:
    """Adds the running sum ``cum`` of the weights in neighbor order, and their ``total``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cum", F.sum(weight).over(w)).withColumn("total", F.sum(weight).over(Window.partitionBy(key)))


def with_cells(rows: DataFrame, weight: str = "weight", key: str = "id", order: str = "nbr") -> DataFrame:
    """The running sums of ``with_cumulative``, once for each ``cell`` that they meet: [0, 1) is cut into as many cells as the list has neighbors (``n``), so a
    draw u reads the rows of cell floor(u n), two of them on average, however long the list is. A list of n neighbors has at most 2 n rows."""
    of = Window.partitionBy(key)
    cum = with_cumulative(rows.where(F.col(weight) > 0), weight, key, order).withColumn("n", F.count(F.lit(1)).over(of))
    # a little wider than the sums say, so that rounding moves no draw out of its row's cells
    at = lambda x, more: F.least(F.greatest(F.floor(x / F.col("total") * F.col("n") + more), F.lit(0)), F.col("n") - 1)
    return cum.withColumn("cell", F.explode(F.sequence(at(F.col("cum") - F.col(weight), -1e-6), at(F.col("cum"), 1e-6))))


def one_uniform(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """(id, nbr): one neighbor of each vertex of ``rows`` (id, nbr), that with the smallest uniform; repeated rows count once. Partial minima in the map tasks leave a
    row of each vertex to move, also for hubs; uniform and neighbor are one number, so that they are hashed and nothing is sorted."""
    u = uniform(seed, "one", F.col(key), F.col("nbr"))
    high, low = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(19,0)")
    both = ((u * float(1 << 52)).cast("bigint").cast("decimal(16,0)") * high + (F.col("nbr").cast("decimal(19,0)") + low)).cast("decimal(38,0)")
    least = rows.groupBy(key).agg(F.min(both).alias("__least"))
    return least.select(key, (F.pmod("__least", high) - low).cast("bigint").alias("nbr"))


#: Into so many parts a list is dealt before it is cut.
LIST_PARTS = 4


def k_uniform(rows: DataFrame, k: int, seed: int, key: str = "id", n_rows: int = 0) -> DataFrame:
    """(id, nbr): k neighbors without replacement, or all of a shorter list. ``rows`` are distinct; with their number ``n_rows`` they need not be, and tasks stay small."""
    if n_rows:
        part = F.pmod(F.hash("nbr"), F.lit(LIST_PARTS))
        rows = rows.select(key, "nbr", part.alias("__part")).repartition(parts(rows.sparkSession, n_rows), key, "__part").distinct()
    u = uniform(seed, "k", F.col(key), F.col("nbr"))
    return _top(rows.withColumn("__u", u), k, [F.col("__u"), F.col("nbr")], key).select(key, "nbr")


def one_weighted(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """(id, nbr): one neighbor with probability in proportion to ``weight``: that with the largest ln(u) / weight, by partial maxima."""
    score = F.ln(uniform(seed, "one", F.col(key), F.col("nbr"))) / F.col("weight")
    return rows.where("weight > 0").groupBy(key).agg(F.max_by("nbr", F.struct(score.alias("s"), (-F.col("nbr")).alias("n"))).alias("nbr"))


def k_weighted(rows: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """(id, nbr): k neighbors without replacement, those with the largest ln(u) / weight."""
    score = F.ln(uniform(seed, "k", F.col(key), F.col("nbr"))) / F.col("weight")
    return _top(rows.where("weight > 0").withColumn("__u", score), k, [F.col("__u").desc(), F.col("nbr")], key).select(key, "nbr")


def _top(rows: DataFrame, k: int, order: list[Column], key: str) -> DataFrame:
    """Spark cuts each group to k in the map tasks already, so a hub's rows are not all brought together."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__rank") <= k)


def one_of_type(rows: DataFrame, kind: int, seed: int, strict: bool = False) -> DataFrame:
    """(id, nbr): one neighbor of a type; with ``strict`` a vertex without such neighbors raises."""
    return _of_type(rows, kind, strict, lambda r: one_uniform(r, seed))


def k_of_type(rows: DataFrame, kind: int, k: int, seed: int, weighted: bool = False, strict: bool = False, n_rows: int = 0) -> DataFrame:
    """(id, nbr): k neighbors of a type without replacement, uniformly or by ``weight``; all of a shorter list. ``n_rows`` as for ``k_uniform``."""
    return _of_type(rows, kind, strict, lambda r: k_weighted(r, k, seed) if weighted else k_uniform(r, k, seed, n_rows=n_rows))


def _of_type(rows: DataFrame, kind: int, strict: bool, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    chosen = pick(rows.where(F.col("nbr_type") == kind))
    if not strict:
        return chosen
    every = rows.select("id").distinct().join(chosen, "id", "left")
    gone = F.raise_error(F.lit(f"a vertex has no neighbor of type {kind}")).cast("long")
    return every.withColumn("nbr", F.when(F.col("nbr").isNull(), gone).otherwise(F.col("nbr")))


def vertices(g_vertices: DataFrame, k: int, seed: int) -> DataFrame:
    """k vertices, uniformly: those with the smallest uniforms."""
    u = uniform(seed, "vertex", F.col("id"))
    return g_vertices.select("id").withColumn("__u", u).orderBy("__u", "id").limit(k).select("id")
