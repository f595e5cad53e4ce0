"""Graph algorithms: PageRank, SVD++, components, shortest paths, triangles, neighbor means."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..model import EdgeDirection, PropertyGraph, directed, endpoints
from ..plans.lineage import bucketed, cut, forget, stored
from . import components, degrees, intersections, sampling
from .messages import Send
from .pregel import pregel


def pagerank(
    edges: DataFrame, rounds: int = 101, reset: float = 0.15, init: float = 1.0, freeze: float = 1e-6, checkpoint_every: int = 10
) -> DataFrame:
    """(id, rank): undirected PageRank of lazy walks. Each edge carries rank / degree both ways; a vertex keeps ``reset`` of its
    rank and takes the rest from its messages, unless that would move it by less than ``freeze``. Mass is conserved but for the frozen.

    One join and one aggregate a round. The neighbor table holds the shares (1 / degree) and a row from each vertex to itself, which
    brings its own rank to the aggregate; it is bucketed by vertex once, so only messages move, after partial sums.
    """
    # edges are read once; a vertex's row to itself stands beside its first neighbor
    w = Window.partitionBy("id")
    placed = directed(edges, EdgeDirection.BOTH).withColumn("degree", F.count(F.lit(1)).over(w)).withColumn("first", F.row_number().over(w.orderBy("nbr")) == 1)
    share = F.struct("nbr", (1.0 / F.col("degree")).alias("share"))
    own = F.struct(F.col("id").alias("nbr"), F.lit(None).cast("double").alias("share"))
    table = bucketed(placed.select("id", F.explode(F.when(F.col("first"), F.array(share, own)).otherwise(F.array(share))).alias("to")).select("id", "to.*"), "id")
    ranks = table.where("share IS NULL").select("id", F.lit(float(init)).alias("rank"))
    for k in range(1, rounds + 1):
        # ranks are hashed, so that the table is not sorted again
        got = table.join(ranks.hint("shuffle_hash"), "id").groupBy(F.col("nbr").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("msg"), F.max(F.when(F.col("share").isNull(), F.col("rank"))).alias("rank"))
        move = (1 - reset) * (F.col("msg") - F.col("rank"))
        new = F.when(F.col("msg").isNull(), reset * F.col("rank")).when(F.abs(move) < freeze, F.col("rank")).otherwise(reset * F.col("rank") + (1 - reset) * F.col("msg"))
        ranks = got.select("id", new.alias("rank"))
        if k % checkpoint_every == 0 and k < rounds:
            ranks = cut(ranks)
    return ranks


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component; vertices are the ends of edges, self loops included."""
    found = components.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return endpoints(edges).join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def min_labels(g: PropertyGraph, max_iterations: int) -> DataFrame:
    """(id, label): the smallest id within ``max_iterations`` + 1 hops, by message passing."""
    start = g.with_vertices(g.vertices.select("id", F.col("id").alias("attr")))
    sends = [Send("dst", lambda t: t.src["attr"]), Send("src", lambda t: t.dst["attr"])]
    out = pregel(start, None, lambda a, m: F.least(a, F.coalesce(m, a)), sends, F.min, active=lambda a, m: m < a, max_iterations=max_iterations)
    return out.vertices.select("id", F.col("attr").alias("label"))


def shortest_paths(g: PropertyGraph, source: int, max_iterations: int, weight: str | None = None) -> DataFrame:
    """(id, distance) along edges from ``source``; null where it is not reached within ``max_iterations`` + 1 hops."""
    start = g.with_vertices(g.vertices.select("id", F.when(F.col("id") == source, F.lit(0.0)).alias("attr")))
    length = (lambda t: t.edge[weight].cast("double")) if weight else (lambda t: F.lit(1.0))
    sends = [Send("dst", lambda t: t.src["attr"] + length(t), lambda t: t.src["attr"].isNotNull())]
    out = pregel(
        start, None, lambda a, m: F.least(a, m), sends, F.min, active=lambda a, m: a.isNull() | (m < a), max_iterations=max_iterations, active_direction=EdgeDirection.OUT
    )
    return out.vertices.select("id", F.col("attr").alias("distance"))


#: A vertex with more neighbors than this, and than the root of all edges, is heavy.
HEAVY = 1000


def _ordered(edges: DataFrame) -> DataFrame:
    """(src, dst), smaller end first; stored. Loops, parallel edges and null ends stay."""
    ends = F.col("src") > F.col("dst")
    return stored(edges.select(F.when(ends, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(ends, F.col("src")).otherwise(F.col("dst")).alias("dst")), "edges")


def _out_lists(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(id, list): each edge of the simple undirected graph at one end; and whether all stand at their smaller id.

    Edges point from light vertices to heavy ones, else from the smaller id. There are few heavy vertices, so all lists are short: about
    the root of the edges at most, or HEAVY.
    """
    n = edges.count()
    simple = edges.where("src <> dst")
    most = max(HEAVY, math.isqrt(2 * n))
    # at most 2 n / most of them, which is not above the root of 2 n
    heavy = stored(degrees.degrees(simple).where(F.col("degree") > most).select("id"), "heavy")
    mark = lambda end: F.broadcast(heavy.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_heavy")))
    both = simple.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    turned = F.col("src_heavy").isNotNull() & F.col("dst_heavy").isNull()
    out = both.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("id"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("nbr"))
    lists, none = intersections.lists_of(out, n), heavy.isEmpty()
    forget(heavy)
    return lists, none


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle of the simple undirected graph once.

    Each edge stands at one end, in lists that are never longer than about the root of all edges; a triangle is a vertex in both lists of an edge.
    Wedges are compared in place and never moved.
    """
    ordered = _ordered(edges)
    lists, rising = _out_lists(ordered)
    found = intersections.run(intersections.closed(lists, rising).select(F.col("id").alias("a"), F.col("nbr").alias("b"), F.explode("common").alias("c")), "triangles")
    forget(ordered, lists)
    return found


def triangle_count(edges: DataFrame) -> DataFrame:
    ordered = _ordered(edges)
    lists, rising = _out_lists(ordered)
    n = intersections.run(intersections.closed(lists, rising).agg(F.coalesce(F.sum(F.size("common")), F.lit(0)).alias("triangles")), "triangles")
    forget(ordered, lists)
    return n


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """(id, triangles); 0 for vertices in none."""
    ordered = _ordered(edges)
    lists, rising = _out_lists(ordered)
    size = F.size("common").cast("bigint")
    ends = F.array(F.struct("id", size.alias("n")), F.struct(F.col("nbr").alias("id"), size.alias("n")))
    each = F.concat(ends, F.transform("common", lambda c: F.struct(c.alias("id"), F.lit(1).cast("bigint").alias("n"))))
    n = intersections.run(intersections.closed(lists, rising).select(F.explode(each).alias("e")).groupBy("e.id").agg(F.sum("e.n").alias("triangles")), "triangles")
    forget(lists)
    return endpoints(ordered).join(n, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def neighbor_mean(rows: DataFrame, values: DataFrame, k: int, seed: int, n_rows: int = 0) -> DataFrame:
    """(id, mean): the mean of ``value`` over at most k sampled neighbors; rows (id, nbr), values (id, value). ``n_rows`` as for ``sampling.k_uniform``."""
    picked = sampling.k_uniform(rows, k, seed, n_rows=n_rows)
    return picked.join(values.select(F.col("id").alias("nbr"), "value"), "nbr").groupBy("id").agg(F.avg("value").alias("mean"))


@dataclass(frozen=True)
class SvdConf:
    rank: int = 10
    max_iterations: int = 2
    min_value: float = 0.0
    max_value: float = 5.0
    gamma1: float = 0.007
    gamma2: float = 0.007
    gamma6: float = 0.005
    gamma7: float = 0.015
    seed: int = 1


@dataclass(frozen=True)
class SvdModel:
    """``factors``: (id, v1, v2, v3, v4); ``errors``: (id, error), squared errors by item before the last update; ``mean``: of all ratings."""

    factors: DataFrame
    errors: DataFrame
    mean: float


def svd_plus_plus(edges: DataFrame, rating: str = "rating", conf: SvdConf = SvdConf()) -> SvdModel:
    """SVD++ over user -> item edges. Factors are plain double columns, so both phases are joins and sums inside generated code."""
    if conf.max_iterations <= 0:
        raise ValueError(f"at least one iteration is needed, not {conf.max_iterations}")
    if conf.max_value <= conf.min_value:
        raise ValueError(f"the largest rating {conf.max_value} must be above the smallest {conf.min_value}")
    r = range(conf.rank)
    # lies by user and by item: each phase reads what it joins in place
    ratings = bucketed(edges.select("src", "dst", F.col(rating).cast("double").alias("rating")), "src")
    by_item = bucketed(ratings, "dst")
    mean = ratings.agg(F.avg("rating")).first()[0] or 0.0
    start = [uniform(conf.seed, f"v{v}", F.col("id"), k).alias(f"v{v}_{k}") for v in (1, 2) for k in r]
    vertices = cut(degrees.bias_init(ratings, "rating").select("id", *start, F.col("bias").alias("v3"), F.col("norm").alias("v4")))
    user = [F.col("id").alias("src"), *[F.col(f"v2_{k}").alias(f"z{k}") for k in r], F.col("v3").alias("bu"), F.col("v4").alias("nu")]
    item = [F.col("id").alias("dst"), *[F.col(f"v1_{k}").alias(f"q{k}") for k in r], *[F.col(f"v2_{k}").alias(f"y{k}") for k in r], F.col("v3").alias("bi")]
    for _ in range(conf.max_iterations):
        # phase 1: users take the sum of their items' implicit factors
        sums = by_item.join(vertices.select(F.col("id").alias("dst"), *[f"v2_{k}" for k in r]), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(f"v2_{k}").alias(f"s{k}") for k in r])
        took = F.col("s0").isNotNull()
        vertices = vertices.join(sums, "id", "left").withColumns({f"v2_{k}": F.when(took, F.col(f"v1_{k}") + F.col("v4") * F.col(f"s{k}")).otherwise(F.col(f"v2_{k}")) for k in r}).drop(*[f"s{k}" for k in r])
        vertices = cut(vertices)
        # phase 2: gradients of both ends of each rating
        both = ratings.join(vertices.select(*user), "src").join(vertices.select(*item), "dst")
        dot = sum((F.col(f"q{k}") * F.col(f"z{k}") for k in r), F.lit(0.0))
        guess = F.least(F.greatest(F.lit(mean) + F.col("bu") + F.col("bi") + dot, F.lit(float(conf.min_value))), F.lit(float(conf.max_value)))
        both = both.withColumn("err", F.col("rating") - guess)
        g2, g7 = conf.gamma2, conf.gamma7
        implicit = [(g2 * (F.col("err") * F.col("nu") * F.col(f"q{k}") - g7 * F.col(f"y{k}"))).alias(f"y{k}") for k in r]
        # a user's own factors do not travel with each rating: their share is taken from the number of ratings, after the sums
        of_user = F.struct(F.col("src").alias("id"), *[(g2 * F.col("err") * F.col(f"q{k}")).alias(f"x{k}") for k in r], *implicit, (conf.gamma1 * (F.col("err") - conf.gamma6 * F.col("bu"))).alias("b"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("e"))
        of_item = F.struct(F.col("dst").alias("id"), *[(g2 * (F.col("err") * F.col(f"z{k}") - g7 * F.col(f"q{k}"))).alias(f"x{k}") for k in r], *implicit, (conf.gamma1 * (F.col("err") - conf.gamma6 * F.col("bi"))).alias("b"), F.lit(0).alias("n"), (F.col("err") * F.col("err")).alias("e"))
        moves = both.select(F.explode(F.array(of_user, of_item)).alias("m")).select("m.*").groupBy("id").agg(*[F.sum(f"{x}{k}").alias(f"d{x}{k}") for x in "xy" for k in r], F.sum("b").alias("db"), F.sum("n").alias("n"), F.sum("e").alias("error"))
        new = {f"v1_{k}": F.col(f"v1_{k}") + F.coalesce(F.col(f"dx{k}") - g2 * g7 * F.col("n") * F.col(f"v1_{k}"), F.lit(0.0)) for k in r} | {f"v2_{k}": F.col(f"v2_{k}") + F.coalesce(f"dy{k}", F.lit(0.0)) for k in r} | {"v3": F.col("v3") + F.coalesce("db", F.lit(0.0))}
        vertices = cut(vertices.join(moves, "id", "left").withColumns(new).select("id", *[f"v{v}_{k}" for v in (1, 2) for k in r], "v3", "v4", "error"))
        errors = vertices.where("error IS NOT NULL").select("id", "error")
        factors = vertices
        vertices = vertices.drop("error")
    forget(by_item, ratings)
    factors = factors.select("id", *[F.array(*[f"v{v}_{k}" for k in r]).alias(f"v{v}") for v in (1, 2)], "v3", F.coalesce("error", "v4").alias("v4"))
    return SvdModel(factors, errors, mean)
