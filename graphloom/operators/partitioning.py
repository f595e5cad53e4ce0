"""Edge partition strategies as expressions over src and dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform, wrapped_abs, wrapped_product

#: Multiplier that spreads ids (a fixed value).
MIXING_PRIME = 1125899906842597


def edge_partition_1d(n: int) -> Column:
    """By source."""
    return F.pmod(wrapped_abs(wrapped_product(F.col("src"), MIXING_PRIME)), F.lit(n)).cast("int")


def edge_partition_2d(n: int) -> Column:
    """By source and target in a square grid: a vertex meets at most 2 sqrt(n) partitions."""
    side = int(-(-(n**0.5) // 1))
    at = lambda c, m: F.pmod(wrapped_abs(wrapped_product(F.col(c), MIXING_PRIME)), m)
    if n == side * side:
        return F.pmod(at("src", F.lit(side)) * side + at("dst", F.lit(side)), F.lit(n)).cast("int")
    rows = (n + side - 1) // side
    last = n - rows * (side - 1)
    col = at("src", F.lit(n)) / rows
    col = F.floor(col).cast("int")
    row = at("dst", F.when(col < side - 1, F.lit(rows)).otherwise(F.lit(last)))
    return (col * rows + row).cast("int")


def random_vertex_cut(n: int) -> Column:
    """All edges from one vertex to another together."""
    return F.floor(uniform("cut", F.col("src"), F.col("dst")) * n).cast("int")


def canonical_random_vertex_cut(n: int) -> Column:
    """All edges between two vertices together, whatever their direction."""
    return F.floor(uniform("cut", F.least("src", "dst"), F.greatest("src", "dst")) * n).cast("int")


STRATEGIES = {
    "EdgePartition1D": edge_partition_1d,
    "EdgePartition2D": edge_partition_2d,
    "RandomVertexCut": random_vertex_cut,
    "CanonicalRandomVertexCut": canonical_random_vertex_cut,
}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"no partition strategy {name}: one of {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def partition_by(edges: DataFrame, name: str, n: int) -> DataFrame:
    """Edges with their partition number ``pid``, and brought to it: edges of one number stand together, in several tasks of bounded size where they are many."""
    return edges.withColumn("pid", strategy(name)(n)).hint("rebalance", n, F.col("pid"))


def by_id_range(vertices: DataFrame, n: int) -> DataFrame:
    """Vertices in ``n`` partitions of neighbouring ids, of about equal size."""
    return vertices.repartitionByRange(n, "id")


def id_range_partition(n: int, low: int, high: int) -> Column:
    """The number of the range of ``id`` when [low, high] is cut into ``n`` ranges of equal width."""
    width = -(-(high - low + 1) // n)
    return F.floor((F.col("id") - low) / F.lit(width)).cast("int")
