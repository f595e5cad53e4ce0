"""Edge lists from text, CSV and DataFrames, untyped or typed, weighted or not, and labels of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EdgeDirection, PropertyGraph
from ..operators import neighbors

#: Types that an edge attribute can be parsed as.
ATTRIBUTE_TYPES = ("long", "float", "int", "double", "boolean", "char", "byte", "short")


def _fields(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    """Blank lines and lines starting with # are skipped; the rest is split at white space."""
    lines = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")
    lines = lines.repartition(partitions) if partitions and partitions > 0 else lines
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f"), "value")


def _attribute(text: Column, kind: str) -> Column:
    if kind not in ATTRIBUTE_TYPES:
        raise ValueError(f"edge attribute type {kind}: one of {', '.join(ATTRIBUTE_TYPES)} is needed")
    if kind == "char":
        return F.substring(text, 1, 1)
    return text.cast({"long": "bigint", "byte": "tinyint", "short": "smallint"}.get(kind, kind))


def default_attribute(kind: str) -> Column:
    """The attribute of an edge for which the file has none: 1 of the type."""
    return {"boolean": F.lit(True), "char": F.lit("1")}.get(kind, F.lit(1).cast(_type(kind)))


def _type(kind: str) -> str:
    return {"long": "bigint", "byte": "tinyint", "short": "smallint", "char": "string"}.get(kind, kind)


def _arity(low: int, high: int) -> Column:
    """Raises on lines with too few or too many fields, else true."""
    n = F.size("f")
    return (
        F.when(n < low, F.raise_error(F.concat(F.lit("too few fields in line: "), "value")).cast("boolean"))
        .when(n > high, F.raise_error(F.concat(F.lit("too many fields in line: "), "value")).cast("boolean"))
        .otherwise(F.lit(True))
    )


def oriented(edges: DataFrame, mode: str | None) -> DataFrame:
    """Canonical orientation. ``drop``: only edges with src > dst, turned round. ``flip``: all, smaller end first. Types turn
    with their vertices."""
    if not mode:
        return edges
    swap = F.col("src") > F.col("dst")
    turned = {"src": F.when(swap, F.col("dst")).otherwise(F.col("src")), "dst": F.when(swap, F.col("src")).otherwise(F.col("dst"))}
    if "src_type" in edges.columns:
        turned |= {"src_type": F.when(swap, F.col("dst_type")).otherwise(F.col("src_type")), "dst_type": F.when(swap, F.col("src_type")).otherwise(F.col("dst_type"))}
    if mode == "drop":
        edges = edges.where(swap)
    elif mode != "flip":
        raise ValueError("canonical orientation is 'drop' or 'flip'")
    return edges.withColumns(turned)


def edges_from_text(spark: SparkSession, path: str, attribute: str = "long", canonical: str | None = None, partitions: int | None = None) -> DataFrame:
    """(src, dst, attr) from lines "src dst [attr]"; the number of fields may vary by line. Self loops are dropped."""
    f = _fields(spark, path, partitions).where(_arity(2, 3))
    attr = F.when(F.size("f") == 3, _attribute(F.get("f", F.lit(2)), attribute)).otherwise(default_attribute(attribute))
    edges = f.select(F.get("f", F.lit(0)).cast("bigint").alias("src"), F.get("f", F.lit(1)).cast("bigint").alias("dst"), attr.alias("attr"))
    return oriented(edges.where("src <> dst"), canonical)


def graph_from_text(spark: SparkSession, path: str, attribute: str = "long", canonical: str | None = None, partitions: int | None = None) -> PropertyGraph:
    return PropertyGraph.from_edges(edges_from_text(spark, path, attribute, canonical, partitions))


def has_types(spark: SparkSession, path: str, lines: int = 5) -> bool:
    """Whether a text edge list has types, by the number of fields in its first lines."""
    found = _fields(spark, path, None).select(F.size("f").alias("n")).limit(lines).collect()
    return bool(found) and all(r["n"] >= 4 for r in found)


def any_edges_from_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """``typed_edges_from_text`` or ``edges_from_text``, whichever the first lines call for."""
    return (typed_edges_from_text if has_types(spark, path) else edges_from_text)(spark, path, **options)


def edges_from_csv(spark: SparkSession, path: str, attribute: str = "double", partitions: int | None = None) -> DataFrame:
    """(src, dst, attr) from CSV without header, all edges of a source in one partition."""
    edges = spark.read.schema(f"src bigint, dst bigint, attr {_type(attribute)}").csv(path).where("src <> dst")
    n = partitions if partitions and partitions > 0 else spark.sparkContext.defaultParallelism
    return edges.repartition(n, "src")


def typed_edges_from_text(spark: SparkSession, path: str, canonical: str | None = None, partitions: int | None = None) -> DataFrame:
    """(src, src_type, dst, dst_type, weight) from lines "src srcType dst dstType [weight]"; weight 1 where there is none."""
    f = _fields(spark, path, partitions).where(_arity(4, 5))
    at = lambda k, t: F.get("f", F.lit(k)).cast(t)
    edges = f.select(
        at(0, "bigint").alias("src"), at(1, "smallint").alias("src_type"), at(2, "bigint").alias("dst"), at(3, "smallint").alias("dst_type"), F.coalesce(at(4, "float"), F.lit(1.0).cast("float")).alias("weight")
    )
    return oriented(edges.where("src <> dst"), canonical)


def edges_from_pairs(df: DataFrame, canonical: str | None = None) -> DataFrame:
    """(src, dst[, weight][, types]) from the first two or three columns of a DataFrame, or from named ones."""
    if "src" not in df.columns:
        names = ["src", "dst", "weight"][: len(df.columns)]
        df = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=False)])
    return oriented(df.where("src <> dst"), canonical)


def graph_with_adjacency(edges: DataFrame, kind: str = "plain", direction: EdgeDirection = EdgeDirection.OUT, slot: str = "attr") -> PropertyGraph:
    """A graph whose vertices carry their adjacency in column ``slot``: plain, weighted, typed or typed_weighted.

    The kind follows the argument, not what the edges have: weighted on edges without weight takes 1, plain drops weights.
    """
    if kind in ("weighted", "typed_weighted") and "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.col("attr").cast("double") if "attr" in edges.columns else F.lit(1.0))
    g = PropertyGraph.from_edges(edges)
    build = {"plain": neighbors.plain, "weighted": neighbors.weighted, "typed": neighbors.typed, "typed_weighted": neighbors.typed_weighted}[kind]
    return g.with_vertices(g.vertices.join(build(g.edges, direction).withColumnRenamed("neighbors", slot), "id", "left"))


def attach_labels(vertices: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """Labels (id, label) beside the vertices; null where a vertex has none."""
    return vertices.join(labels.select("id", F.col("label").cast("float").alias(name)), "id", "left")
