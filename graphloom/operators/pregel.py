"""Bulk-synchronous iteration: every superstep is a plan of joins and one aggregate over the last step's vertices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EdgeActiveness, EdgeDirection, PropertyGraph
from ..plans.lineage import bucketed, cut
from .messages import Send, aggregate_messages

#: Which edges send, by the direction in which activity spreads.
ACTIVENESS = {
    EdgeDirection.BOTH: EdgeActiveness.BOTH,
    EdgeDirection.EITHER: EdgeActiveness.EITHER,
    EdgeDirection.OUT: EdgeActiveness.SRC_ONLY,
    EdgeDirection.IN: EdgeActiveness.DST_ONLY,
}


def pregel(
    g: PropertyGraph,
    initial_message: Column | None,
    program: Callable[[Column, Column], Column],
    sends: Sequence[Send],
    merge: Callable[[Column | str], Column] = F.sum,
    active: Callable[[Column, Column], Column] | None = None,
    max_iterations: int = 20,
    active_direction: EdgeDirection | None = EdgeDirection.EITHER,
    attr: str = "attr",
) -> PropertyGraph:
    """Runs ``program(attr, message)`` over the vertices, then rounds of messages, at most ``max_iterations`` + 1 of them.

    A vertex with a message for which ``active(attr, message)`` fails keeps its attribute; one without message gets
    ``program(attr, null)`` and is inactive. It ends when no vertex is active. ``active_direction`` None lets all edges send
    in each round. ``initial_message`` None skips the first program. The vertices are used several times in a round, so their lineage is
    cut after each: plans neither grow nor are parts computed twice.
    """
    if max_iterations < 1:
        raise ValueError("max_iterations must be positive")
    holds = active or (lambda a, m: F.lit(True))
    a = F.col(attr)
    v = g.vertices
    if initial_message is not None:
        v = v.withColumn("__m", initial_message)
        v = v.withColumn("active", holds(a, F.col("__m"))).withColumn(attr, F.when(F.col("active"), program(a, F.col("__m"))).otherwise(a)).drop("__m")
    else:
        v = v.withColumn("active", F.lit(True))
    edges = bucketed(g.edges, "src")
    v = cut(v)
    gate = EdgeActiveness.NEITHER if active_direction is None else ACTIVENESS[active_direction]
    for _ in range(max_iterations + 1):
        # the side of the vertices is hashed, so that edges are not sorted in each round
        got = aggregate_messages(PropertyGraph(v.hint("shuffle_hash"), edges), sends, merge, gate)
        both = v.join(got, "id", "left")
        m = F.col("msg")
        on = F.when(m.isNotNull(), F.coalesce(holds(a, m), F.lit(False))).otherwise(F.lit(False))
        both = both.withColumn("active", on)
        v = cut(both.withColumn(attr, F.when(m.isNull() | F.col("active"), program(a, m)).otherwise(a)).drop("msg"))
        if not v.where("active").limit(1).count():
            break
    return PropertyGraph(v, g.edges)
