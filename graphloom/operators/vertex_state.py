"""Joining values into vertices: attributes, named slots, labels and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..model import PropertyGraph
from ..plans.lineage import cut

SLOT = "slot_"


def join_vertices(g: PropertyGraph, other: DataFrame, attr: str, update: Callable[[Column, Column], Column], value: str = "value", strict: bool = False) -> PropertyGraph:
    """``attr`` becomes ``update(attr, value)`` where ``other`` (id, value; unique ids) has the vertex, and stays elsewhere.

    ``strict`` raises for ids of ``other`` that are no vertices."""
    if strict:
        unknown = other.join(g.vertices, "id", "left_anti").select("id").first()
        if unknown:
            raise KeyError(f"{unknown['id']} is no vertex")
    side = other.select("id", F.col(value).alias("__value"), F.lit(True).alias("__hit"))
    return g.with_vertices(g.vertices.join(side, "id", "left").withColumn(attr, F.when(F.col("__hit"), update(F.col(attr), F.col("__value"))).otherwise(F.col(attr))).drop("__value", "__hit"))


def create_slot(g: PropertyGraph, name: str, kind: str) -> PropertyGraph:
    if SLOT + name in g.vertices.columns:
        raise ValueError(f"slot {name} exists")
    return g.with_vertices(g.vertices.withColumn(SLOT + name, F.lit(None).cast(kind)))


def update_slot(g: PropertyGraph, name: str, other: DataFrame, update: Callable[[Column, Column], Column], value: str = "value") -> PropertyGraph:
    """Upsert: ``update(old or null, value)`` where ``other`` has the vertex."""
    if SLOT + name not in g.vertices.columns:
        g = create_slot(g, name, dict(other.dtypes)[value])
    return join_vertices(g, other, SLOT + name, update, value)


def get_slot(g: PropertyGraph, name: str) -> DataFrame:
    """(id, value) of the vertices that have a value."""
    return g.vertices.where(F.col(SLOT + name).isNotNull()).select("id", F.col(SLOT + name).alias("value"))


def remove_slot(g: PropertyGraph, name: str) -> PropertyGraph:
    return g.with_vertices(g.vertices.drop(SLOT + name))


def checkpoint(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(cut(g.vertices), cut(g.edges))


def split_training(labelled: DataFrame, ratio: float = 0.8, seed: int = 7) -> DataFrame:
    """Adds ``split``: "train" or "test", by a seeded uniform of the id; rows without label get null."""
    return labelled.withColumn("split", F.when(F.col("label").isNotNull(), F.when(uniform(seed, "split", F.col("id")) < ratio, "train").otherwise("test")))
