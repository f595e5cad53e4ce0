"""Degrees, sums of edge attributes, merged parallel edges and global statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EdgeDirection, PropertyGraph, directed


def degrees(edges: DataFrame, direction: EdgeDirection = EdgeDirection.BOTH) -> DataFrame:
    """(id, degree); parallel edges count each, vertices without edges in the direction have no row."""
    return directed(edges, direction).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_values(edges: DataFrame, value: str, direction: EdgeDirection = EdgeDirection.BOTH) -> DataFrame:
    """(id, total): the sum of an edge attribute by vertex."""
    return directed(edges, direction, [value]).groupBy("id").agg(F.sum(value).alias("total"))


def bias_init(edges: DataFrame, value: str) -> DataFrame:
    """(id, bias, norm): mean of the attribute at the vertex less the global mean, and 1 / sqrt(number)."""
    mean = edges.agg(F.avg(value).alias("mean"))
    per = directed(edges, EdgeDirection.BOTH, [value]).groupBy("id").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select("id", (F.col("s") / F.col("n") - mean.scalar()).alias("bias"), (1 / F.sqrt("n")).alias("norm"))


def group_edges(g: PropertyGraph, **merge: Column) -> PropertyGraph:
    """One edge for each (src, dst), with merged attributes: aggregates over the attributes of parallel edges."""
    return g.with_edges(g.edges.groupBy("src", "dst").agg(*[c.alias(n) for n, c in merge.items()]))


def num_vertices(g: PropertyGraph) -> int:
    return g.vertices.count()


def num_edges(g: PropertyGraph) -> int:
    return g.edges.count()


def vertex_id_range(edges: DataFrame) -> DataFrame:
    """(min_id, max_id) in one pass."""
    return edges.agg(F.min(F.least("src", "dst")).alias("min_id"), F.max(F.greatest("src", "dst")).alias("max_id"))


def active_count(g: PropertyGraph) -> int:
    return g.vertices.where("active").count()


def keyed_merge(rows: DataFrame, key: str, value: str, merge: Callable[[Column | str], Column] = F.sum) -> DataFrame:
    """Upsert-aggregate of (key, value) rows."""
    return rows.groupBy(key).agg(merge(value).alias(value))
