"""Adjacency: plain, weighted, typed and typed weighted neighbor lists, membership and common neighbors.

The long forms (a row per neighbor) scale to any hub; the array forms hold a vertex's list in one row. Typed edges have
``src_type`` and ``dst_type``; weighted ones ``weight``. Where an order of edges is given, of parallel edges the first
weight stays; else the smallest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import merge_sorted, merge_weighted
from ..model import EdgeDirection, PropertyGraph, directed
from ..plans.lineage import dealt, forget, stored
from . import intersections

OUT = EdgeDirection.OUT


def typed_ends(edges: DataFrame, direction: EdgeDirection, weighted: bool = False) -> DataFrame:
    """(id, type, nbr, nbr_type[, weight]), a row for each edge and end."""
    more = ["weight"] if weighted else []
    along = edges.select(F.col("src").alias("id"), F.col("src_type").alias("type"), F.col("dst").alias("nbr"), F.col("dst_type").alias("nbr_type"), *more)
    against = edges.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"), F.col("src").alias("nbr"), F.col("src_type").alias("nbr_type"), *more)
    if direction is EdgeDirection.OUT:
        return along
    if direction is EdgeDirection.IN:
        return against
    if direction is EdgeDirection.BOTH:
        return along.unionAll(against)
    raise ValueError("EITHER has no neighbors: use IN, OUT or BOTH")


def plain_rows(edges: DataFrame, direction: EdgeDirection = OUT, n_edges: int = 0) -> DataFrame:
    """(id, nbr), distinct; tasks stay small if the number of edges is given."""
    return dealt(directed(edges, direction), n_edges * (2 if direction is EdgeDirection.BOTH else 1), "id", "nbr").distinct()


def weighted_rows(edges: DataFrame, direction: EdgeDirection = OUT, order: str | None = None) -> DataFrame:
    """(id, nbr, weight), one row per neighbor."""
    columns = ["weight", order] if order else ["weight"]
    pick = F.min_by("weight", order) if order else F.min("weight")
    return directed(edges, direction, columns).groupBy("id", "nbr").agg(pick.alias("weight"))


def typed_rows(edges: DataFrame, direction: EdgeDirection = OUT) -> DataFrame:
    """(id, type, nbr_type, nbr), distinct."""
    return typed_ends(edges, direction).groupBy("id", "nbr_type", "nbr").agg(F.min("type").alias("type")).select("id", "type", "nbr_type", "nbr")


def typed_weighted_rows(edges: DataFrame, direction: EdgeDirection = OUT) -> DataFrame:
    """(id, type, nbr_type, nbr, weight), one row per neighbor and type."""
    return typed_ends(edges, direction, True).groupBy("id", "nbr_type", "nbr").agg(F.min("type").alias("type"), F.min("weight").alias("weight")).select("id", "type", "nbr_type", "nbr", "weight")


def plain(edges: DataFrame, direction: EdgeDirection = OUT) -> DataFrame:
    """(id, neighbors): sorted array of distinct ids."""
    return directed(edges, direction).groupBy("id").agg(F.array_sort(F.collect_set("nbr")).alias("neighbors"))


def weighted(edges: DataFrame, direction: EdgeDirection = OUT, order: str | None = None) -> DataFrame:
    """(id, neighbors): array of (nbr, weight), sorted by neighbor."""
    return weighted_rows(edges, direction, order).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nbr", "weight"))).alias("neighbors"))


def typed(edges: DataFrame, direction: EdgeDirection = OUT) -> DataFrame:
    """(id, type, neighbors): map from type to the sorted array of neighbors of that type."""
    lists = typed_rows(edges, direction).groupBy("id", "nbr_type").agg(F.min("type").alias("type"), F.array_sort(F.collect_list("nbr")).alias("list"))
    return _maps(lists)


def typed_weighted(edges: DataFrame, direction: EdgeDirection = OUT) -> DataFrame:
    """(id, type, neighbors): map from type to the array of (nbr, weight), sorted by neighbor."""
    lists = typed_weighted_rows(edges, direction).groupBy("id", "nbr_type").agg(F.min("type").alias("type"), F.array_sort(F.collect_list(F.struct("nbr", "weight"))).alias("list"))
    return _maps(lists)


def _maps(lists: DataFrame) -> DataFrame:
    return lists.groupBy("id").agg(F.min("type").alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("nbr_type", "list")))).alias("neighbors"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two adjacency tables (id, neighbors)."""
    return _merged(a, b, merge_sorted)


def merge_weighted_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two weighted adjacency tables; of a neighbor in both the weight of ``a`` stays."""
    return _merged(a, b, merge_weighted)


def merge_typed_tables(a: DataFrame, b: DataFrame, weighted: bool = False) -> DataFrame:
    """Union of two typed adjacency tables (id, type, neighbors), list by list of a type. A vertex whose type differs raises."""
    lists = merge_weighted if weighted else merge_sorted
    maps = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.map_zip_with(x, y, lambda _, p, q: lists(p, q)))
    other = b.select("id", F.col("type").alias("__type"), F.col("neighbors").alias("__more"))
    wrong = F.raise_error(F.concat(F.lit("two types of vertex "), F.col("id").cast("string"))).cast(a.schema["type"].dataType)
    kind = F.when(F.col("type") != F.col("__type"), wrong).otherwise(F.coalesce("type", "__type"))
    return a.join(other, "id", "full").select("id", kind.alias("type"), maps(F.col("neighbors"), F.col("__more")).alias("neighbors"))


def _merged(a: DataFrame, b: DataFrame, lists: Callable[[Column, Column], Column]) -> DataFrame:
    other = b.select("id", F.col("neighbors").alias("__more"))
    return a.join(other, "id", "full").select("id", lists(F.col("neighbors"), F.col("__more")).alias("neighbors"))


def has_neighbor(neighbors: Column, x: Column) -> Column:
    """Membership in an array of neighbors."""
    return F.array_contains(neighbors, x)


def has_typed_neighbor(neighbors: Column, kind: Column, x: Column) -> Column:
    """Membership in a typed map; a missing type raises."""
    return F.array_contains(neighbors_of_type(neighbors, kind), x)


def neighbors_of_type(neighbors: Column, kind: Column) -> Column:
    return F.coalesce(F.try_element_at(neighbors, kind), F.raise_error(F.concat(F.lit("no neighbors of type "), kind.cast("string"))))


def pairs_in(edges: DataFrame, pairs: DataFrame, direction: EdgeDirection = OUT, n_edges: int = 0) -> DataFrame:
    """Adds ``found`` to (id, nbr) pairs: membership by a join, for lists of any size."""
    rows = plain_rows(edges, direction, n_edges).withColumn("__hit", F.lit(True))
    return pairs.join(rows, ["id", "nbr"], "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


#: A list with more neighbors than this is not held in one row.
LONG = 10_000


def common_neighbors(edges: DataFrame, pairs: DataFrame, direction: EdgeDirection = EdgeDirection.BOTH, long: int = LONG) -> DataFrame:
    """(a, b, ..., common): number of shared neighbors of given pairs of vertices, a row for each pair; other columns of ``pairs`` stay.

    Lists meet as arrays in blocks of vertices; pairs with a vertex of more than ``long`` (parallel) edges look up each neighbor of the other end, or of the
    one with fewer, by a join."""
    rows = directed(edges, direction)
    degree = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = stored(degree.where(F.col("n") > long), "hubs")
    if hubs.isEmpty():
        lists = intersections.lists_of(rows, edges.count() * (2 if direction is EdgeDirection.BOTH else 1))
        found = intersections.run(intersections.counted(lists, pairs), "common")
        forget(hubs, lists)
        return found
    lists = intersections.lists_of(rows.join(F.broadcast(hubs.select("id")), "id", "left_anti"), edges.count())
    of = lambda end: F.broadcast(hubs.select(F.col("id").alias(end), F.col("n").alias(f"__{end}")))
    marked = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    large = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    found = intersections.run(intersections.counted(lists, marked.where(~large).select(*pairs.columns)), "common")
    # 0 for ends that are no hubs: they have fewer neighbors
    turned = F.coalesce("__a", F.lit(0)) > F.coalesce("__b", F.lit(0))
    both = marked.where(large).select("a", "b", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("t")).distinct()
    plain = rows.distinct()
    one = both.join(plain.select(F.col("id").alias("s"), F.col("nbr").alias("x")), "s")
    hit = one.join(plain.select(F.col("id").alias("t"), F.col("nbr").alias("x")), ["t", "x"])
    counts = hit.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    rest = marked.where(large).select(*pairs.columns).join(counts, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    forget(lists)
    return found.unionByName(rest.select(*found.columns))


def with_adjacency(g: PropertyGraph, direction: EdgeDirection = OUT, slot: str = "slot_neighbor") -> PropertyGraph:
    """Each vertex with its whole adjacency as a column; null without neighbors in the direction."""
    return g.with_vertices(g.vertices.join(plain(g.edges, direction).withColumnRenamed("neighbors", slot), "id", "left"))
