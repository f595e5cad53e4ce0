"""Maps, filters and views of graphs. Functions passed in return Columns, so that Catalyst sees through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EdgeActiveness, PropertyGraph, Triplet, endpoints

VertexMap = Callable[[Column], Column]


def map_vertices(g: PropertyGraph, **new: Column) -> PropertyGraph:
    """New vertex attributes from expressions over the vertex columns; the old attributes go."""
    return g.with_vertices(g.vertices.select("id", *[c.alias(n) for n, c in new.items()]))


def map_edges(g: PropertyGraph, **new: Column) -> PropertyGraph:
    """New edge attributes from expressions over the edge columns."""
    return g.with_edges(g.edges.select("src", "dst", *[c.alias(n) for n, c in new.items()]))


def map_triplets(g: PropertyGraph, **new: Callable[[Triplet], Column]) -> PropertyGraph:
    """New edge attributes from the edge and the current attributes of both ends; ends that no function uses are not joined."""
    t, built = g.over_triplets(*new.values())
    return g.with_edges(t.select("src", "dst", *[c.alias(n) for n, c in zip(new, built, strict=True)]))


def reverse(g: PropertyGraph) -> PropertyGraph:
    return g.with_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *g.edge_attributes))


def without_vertex_attributes(g: PropertyGraph, kind: str | None = None) -> PropertyGraph:
    """Only ids, or ids and a null ``attr`` of a type."""
    kept = g.vertices.select("id")
    return g.with_vertices(kept.withColumn("attr", F.lit(None).cast(kind)) if kind else kept)


def subgraph(
    g: PropertyGraph,
    vertex: Callable[[Column], Column] | None = None,
    edge: Callable[[Triplet], Column] | None = None,
    keep_isolated: bool = False,
) -> PropertyGraph:
    """Edges that satisfy ``edge`` and whose ends both satisfy ``vertex`` (over the struct of vertex columns).

    Vertices are the ends of kept edges; with ``keep_isolated`` all that satisfy ``vertex``. Vertex predicates run before the
    join, on the vertices.
    """
    whole = F.struct(*g.vertices.columns)
    good = g.vertices.where(vertex(whole)) if vertex else g.vertices
    edges = g.edges
    if vertex:
        for end in ("src", "dst"):
            edges = edges.join(good.select(F.col("id").alias(end)), end, "left_semi")
    kept = PropertyGraph(good, edges.select(*g.edges.columns))
    if edge:
        t, (condition,) = kept.over_triplets(edge)
        kept = kept.with_edges(t.where(condition).select("src", "dst", *[F.col("edge")[c].alias(c) for c in g.edge_attributes]))
    return kept if keep_isolated else kept.with_vertices(good.join(endpoints(kept.edges), "id", "left_semi"))


def is_active(kind: EdgeActiveness, src: Column, dst: Column) -> Column:
    """Whether an edge takes part, given the flags of its ends."""
    return {
        EdgeActiveness.NEITHER: F.lit(True),
        EdgeActiveness.SRC_ONLY: src,
        EdgeActiveness.DST_ONLY: dst,
        EdgeActiveness.BOTH: src & dst,
        EdgeActiveness.EITHER: src | dst,
    }[kind]


def with_active_set(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Flags ``active`` on the vertices of a set of ids."""
    found = ids.select("id").distinct().withColumn("active", F.lit(True))
    return g.with_vertices(g.vertices.drop("active").join(found, "id", "left").withColumn("active", F.coalesce("active", F.lit(False))))


def sorted_positions(g: PropertyGraph, order: str) -> DataFrame:
    """Edges in the order that clusters them: ``out`` by (src, dst), ``in`` by (dst, src), ``both`` by the end of smaller degree.

    The order within each cluster is a position; sorting is by cluster, so no task orders all edges.
    """
    from .degrees import degrees

    if order == "out":
        keys = [F.col("src"), F.col("dst")]
        edges = g.edges
    elif order == "in":
        keys = [F.col("dst"), F.col("src")]
        edges = g.edges
    elif order == "both":
        d = degrees(g.edges)
        edges = g.edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
        src_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
        keys = [F.when(src_first, F.col("src")).otherwise(F.col("dst")), F.when(src_first, F.col("dst")).otherwise(F.col("src"))]
    else:
        raise ValueError("order is 'out', 'in' or 'both'")
    from pyspark.sql import Window

    w = Window.partitionBy("cluster").orderBy("other", "src")
    return edges.withColumn("cluster", keys[0]).withColumn("other", keys[1]).withColumn("position", F.row_number().over(w)).select("src", "dst", "cluster", "position")


def sorted_within_partitions(edges: DataFrame, order: str = "out") -> DataFrame:
    return edges.sortWithinPartitions(*(("src", "dst") if order == "out" else ("dst", "src")))
