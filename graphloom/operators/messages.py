"""Messages along edges: each triplet sends expressions to its ends, which merge what they get."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EdgeActiveness, PropertyGraph, Triplet
from .transform import is_active


class Send(NamedTuple):
    """To ``src`` or ``dst``; the message, and a condition under which it is sent."""

    to: str
    message: Callable[[Triplet], Column]
    when: Callable[[Triplet], Column] | None = None


def aggregate_messages(
    g: PropertyGraph, sends: Sequence[Send], merge: Callable[[Column | str], Column] = F.sum, activeness: EdgeActiveness = EdgeActiveness.NEITHER
) -> DataFrame:
    """(id, msg) for vertices that got a message. ``merge`` is an aggregate, partly done before the shuffle.

    Ends that no message, condition or activeness refers to are not joined. With an activeness other than NEITHER the
    vertices need a boolean column ``active``.
    """
    for s in sends:
        if s.to not in ("src", "dst"):
            raise ValueError("a message goes to 'src' or 'dst' of its edge")
    gated = {
        EdgeActiveness.NEITHER: (),
        EdgeActiveness.SRC_ONLY: ("src",),
        EdgeActiveness.DST_ONLY: ("dst",),
    }.get(activeness, ("src", "dst"))
    t = Triplet(set(gated))
    built = [(s.to, s.message(t), s.when(t) if s.when else None) for s in sends]
    rows = g.triplets(sorted(t.touched))
    if gated:
        flag = lambda end: F.coalesce(F.col(f"{end}_vertex")["active"], F.lit(False)) if end in gated else F.lit(True)
        rows = rows.where(is_active(activeness, flag("src"), flag("dst")))
    if len(built) == 1:
        to, message, when = built[0]
        sent = (rows.where(when) if when is not None else rows).select(F.col(to).alias("id"), message.alias("msg"))
    else:
        out = F.array(*[F.struct((F.when(when, F.col(to)) if when is not None else F.col(to)).alias("id"), message.alias("msg")) for to, message, when in built])
        sent = rows.select(F.explode(out).alias("m")).select("m.id", "m.msg").where("id IS NOT NULL")
    return sent.where("msg IS NOT NULL").groupBy("id").agg(merge("msg").alias("msg"))
