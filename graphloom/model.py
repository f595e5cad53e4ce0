"""The property graph: a vertex table (id, ...) and an edge table (src, dst, ...), both immutable DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EdgeDirection(Enum):
    IN = "in"
    OUT = "out"
    EITHER = "either"
    BOTH = "both"


class EdgeActiveness(Enum):
    NEITHER = "neither"
    SRC_ONLY = "src_only"
    DST_ONLY = "dst_only"
    BOTH = "both"
    EITHER = "either"


@dataclass
class Triplet:
    """What functions over triplets get: ids, and structs with the columns of both vertices and of the edge.

    Which ends a function touches is recorded while it builds its expression, so that unused ends are never joined.
    """

    touched: set[str] = field(default_factory=set)

    @property
    def src_id(self) -> Column:
        return F.col("src")

    @property
    def dst_id(self) -> Column:
        return F.col("dst")

    @property
    def src(self) -> Column:
        self.touched.add("src")
        return F.col("src_vertex")

    @property
    def dst(self) -> Column:
        self.touched.add("dst")
        return F.col("dst_vertex")

    @property
    def edge(self) -> Column:
        return F.col("edge")


class PropertyGraph:
    """``vertices`` with unique non-null ``id``; ``edges`` with ``src`` and ``dst``; other columns are attributes."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    @classmethod
    def from_edges(cls, edges: DataFrame, keep_self_loops: bool = False) -> PropertyGraph:
        """Self loops go, parallel edges stay, and the vertices are the ends of the edges."""
        kept = edges.where("src IS NOT NULL AND dst IS NOT NULL")
        kept = kept if keep_self_loops else kept.where("src <> dst")
        return cls(endpoints(kept), kept)

    def with_vertices(self, vertices: DataFrame) -> PropertyGraph:
        return PropertyGraph(vertices, self.edges)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices, edges)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PropertyGraph:
        """Keeps both tables with the executors once they are computed; a lost executor's part is computed again."""
        return PropertyGraph(self.vertices.persist(level), self.edges.persist(level))

    def unpersist(self) -> PropertyGraph:
        return PropertyGraph(self.vertices.unpersist(), self.edges.unpersist())

    def repartition(self, n: int) -> PropertyGraph:
        """Vertices by id and edges by source, in ``n`` partitions."""
        return PropertyGraph(self.vertices.repartition(n, "id"), self.edges.repartition(n, "src"))

    @property
    def edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def triplets(self, ends: Sequence[str] = ("src", "dst")) -> DataFrame:
        """(src, dst, edge, src_vertex, dst_vertex): edges joined with the ends that are asked for."""
        out = self.edges.select("src", "dst", _struct(self.edge_attributes).alias("edge"))
        everything = _struct(self.vertices.columns)
        for end in ("src", "dst"):
            if end in ends:
                out = out.join(self.vertices.select(F.col("id").alias(end), everything.alias(f"{end}_vertex")), end)
        return out.select("src", "dst", "edge", *[f"{e}_vertex" for e in ("src", "dst") if e in ends])

    def over_triplets(self, *functions: Callable[[Triplet], Column]) -> tuple[DataFrame, list[Column]]:
        """The triplets that these functions need, and their expressions."""
        t = Triplet()
        built = [f(t) for f in functions]
        return self.triplets(sorted(t.touched)), built


def _struct(columns: Sequence[str]) -> Column:
    return F.struct(*columns) if columns else F.struct(F.lit(None).cast("int").alias("none"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def directed(edges: DataFrame, direction: EdgeDirection, columns: Sequence[str] = ()) -> DataFrame:
    """(id, nbr, ...) as seen from each vertex: along edges, against them, or both (parallel and reciprocal edges count each)."""
    along = edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), *columns)
    against = edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), *columns)
    if direction is EdgeDirection.OUT:
        return along
    if direction is EdgeDirection.IN:
        return against
    if direction is EdgeDirection.BOTH:
        ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"))))
        return edges.select(ends.alias("e"), *columns).select("e.id", "e.nbr", *columns)
    raise ValueError(f"direction {direction.value} has no neighbors: use IN, OUT or BOTH")
