"""Text sinks for edges and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str) -> None:
    """One edge per line: src, dst and attributes, tab-separated."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    edges.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("src", "dst", *rest)]).alias("value")).write.text(path)


def write_walks(walks: DataFrame, path: str) -> None:
    """One walk (start, walk, path) per line: vertex ids joined by spaces."""
    walks.select(F.array_join(F.transform("path", lambda v: v.cast("string")), " ").alias("value")).write.text(path)
