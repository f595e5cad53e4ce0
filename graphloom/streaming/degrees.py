"""Degrees of an unbounded edge stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EdgeDirection, directed


def running_degrees(edges: DataFrame, direction: EdgeDirection = EdgeDirection.BOTH) -> DataFrame:
    """(id, degree) over a stream of (src, dst): for output modes ``update`` and ``complete``. Self loops are dropped."""
    return directed(edges.where("src <> dst"), direction).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def windowed_degrees(edges: DataFrame, time: str, window: str, lateness: str, direction: EdgeDirection = EdgeDirection.BOTH) -> DataFrame:
    """(window, id, degree) of edges by event time; state older than ``lateness`` is given up, so it stays bounded."""
    rows = directed(edges.where("src <> dst").withWatermark(time, lateness), direction, [time])
    return rows.groupBy(F.window(time, window), "id").agg(F.count(F.lit(1)).alias("degree"))
