"""The query catalog of the graph operators over the relational test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import EdgeActiveness, EdgeDirection, PropertyGraph, directed, endpoints
from ..operators import algorithms, degrees, messages, neighbors, partitioning, sampling, sets, transform, vertex_state, walks
from ..operators.messages import Send
from ..sources import loaders, sinks, tables
from .lineage import dealt, shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
IN, OUT, BOTH = EdgeDirection.IN, EdgeDirection.OUT, EdgeDirection.BOTH

#: Parameters that the SQL in oracle.py repeats.
SEED = 7
ROUNDS = 5
WALK_LENGTH = 5
#: Rounds of an iteration that ends by itself.
UNBOUNDED = (1 << 31) - 2


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _ps(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph.from_edges(tables.part_supplier(spark, d))


def _multi(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph.from_edges(tables.part_supplier_rows(spark, d).select("src", "dst", "weight"))


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame) -> str:
    path = _new_path(spark, "edges")
    lines.write.text(path)
    return path


# sources ---------------------------------------------------------------------------------------------------------


@query
def edges_text_parse(spark, d):
    e = tables.part_supplier(spark, d)
    lines = e.select(F.when(F.col("weight") % 2 == 0, F.concat_ws(" ", "src", "dst")).otherwise(F.concat_ws("\t", "src", "dst", "weight")).alias("value"))
    extra = spark.createDataFrame([("# comment",), ("",), ("16 16 3",)], "value string")
    return loaders.edges_from_text(spark, _written(spark, lines.unionAll(extra)))


@query
def edges_csv_parse(spark, d):
    e = tables.part_supplier(spark, d)
    return loaders.edges_from_csv(spark, _written(spark, e.select(F.concat_ws(",", "src", "dst", "weight").alias("value"))))


@query
def typed_edges_parse(spark, d):
    e = tables.typed(spark, d)
    lines = e.select(F.concat_ws(" ", "src", "src_type", "dst", "dst_type", F.when(F.col("src_type") > 0, F.col("weight"))).alias("value"))
    return loaders.typed_edges_from_text(spark, _written(spark, lines)).withColumn("weight", F.col("weight").cast("double"))


@query
def edge_text_sink(spark, d):
    path = _new_path(spark, "sink")
    sinks.write_edges(tables.part_supplier(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def edges_drop_self_loops(spark, d):
    e = tables.part_supplier(spark, d).select("src", F.when(F.col("weight") % 7 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return PropertyGraph.from_edges(e).edges


@query
def canonical_orientation(spark, d):
    return loaders.edges_from_pairs(tables.part_supplier(spark, d), canonical="drop")


@query
def canonical_flip(spark, d):
    return loaders.edges_from_pairs(tables.typed(spark, d), canonical="flip")


@query
def weighted_pairs(spark, d):
    return loaders.edges_from_pairs(tables.user_events(spark, d).toDF("a", "b", "c"))


@query
def vertices_from_edges(spark, d):
    return _ps(spark, d).vertices


@query
def graph_counts(spark, d):
    g = _multi(spark, d)
    return g.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).withColumn("n_edges", g.edges.agg(F.count(F.lit(1))).scalar())


@query
def min_max_vertex(spark, d):
    return degrees.vertex_id_range(tables.part_supplier(spark, d))


@query
def adjacency_attribute(spark, d):
    g = loaders.graph_with_adjacency(tables.part_supplier(spark, d).select("src", "dst"), "weighted", OUT, "adj")
    return g.vertices.select("id", F.explode("adj").alias("a")).select("id", "a.nbr", "a.weight")


# projections and filters -----------------------------------------------------------------------------------------


@query
def map_vertices(spark, d):
    return transform.map_vertices(_ps(spark, d), kind=F.pmod("id", F.lit(8)), key=F.floor(F.col("id") / 8)).vertices


@query
def map_edges(spark, d):
    return transform.map_edges(_ps(spark, d), double_weight=F.col("weight") * 2).edges


@query
def map_triplets(spark, d):
    g = _ps(spark, d)
    g = g.with_vertices(g.vertices.withColumn("x", F.pmod("id", F.lit(10))))
    return transform.map_triplets(g, score=lambda t: t.src["x"] * 100 + t.dst["x"] * 10 + t.edge["weight"] % 10).edges


@query
def map_triplets_src_only(spark, d):
    g = _ps(spark, d)
    g = g.with_vertices(g.vertices.withColumn("x", F.pmod("id", F.lit(10))))
    return transform.map_triplets(g, score=lambda t: t.src["x"] + t.dst_id).edges


@query
def reverse_edges(spark, d):
    return transform.reverse(_ps(spark, d)).edges


@query
def triplets_view(spark, d):
    g = _ps(spark, d)
    g = g.with_vertices(g.vertices.withColumn("x", F.pmod("id", F.lit(10))))
    return g.triplets().select("src", "dst", F.col("edge.weight").alias("weight"), F.col("src_vertex.x").alias("src_x"), F.col("dst_vertex.x").alias("dst_x"))


@query
def without_vertex_attributes(spark, d):
    return transform.without_vertex_attributes(_ps(spark, d), "bigint").vertices


def _sub(spark, d, **options):
    return transform.subgraph(_ps(spark, d), lambda v: v["id"] % 3 != 0, lambda t: (t.edge["weight"] > 20) & (t.src_id > t.dst_id), **options)


@query
def subgraph_edges(spark, d):
    return _sub(spark, d).edges


@query
def subgraph_vertices(spark, d):
    return _sub(spark, d).vertices


@query
def subgraph_keep_isolated(spark, d):
    return _sub(spark, d, keep_isolated=True).vertices


@query
def active_edges(spark, d):
    g = _ps(spark, d)
    g = transform.with_active_set(g, g.vertices.where("id % 4 = 1"))
    t = g.triplets()
    flags = [transform.is_active(k, F.col("src_vertex.active"), F.col("dst_vertex.active")).cast("int").alias(k.value) for k in EdgeActiveness]
    return t.select("src", "dst", *flags)


# joins and vertex state ------------------------------------------------------------------------------------------


def _keyed(spark, d):
    return degrees.degrees(tables.part_supplier(spark, d), OUT).where("id % 3 = 0").select("id", F.col("degree").alias("value"))


@query
def join_vertices(spark, d):
    g = transform.map_vertices(_ps(spark, d), attr=F.pmod("id", F.lit(100)))
    return vertex_state.join_vertices(g, _keyed(spark, d), "attr", lambda a, u: a + 1000 * u).vertices


@query
def update_slots(spark, d):
    g = vertex_state.create_slot(_ps(spark, d), "deg", "bigint")
    add = lambda old, u: F.coalesce(old, F.lit(0)) + u
    g = vertex_state.update_slot(vertex_state.update_slot(g, "deg", _keyed(spark, d), add), "deg", _keyed(spark, d).where("id % 2 = 0"), add)
    return g.vertices


@query
def get_slot(spark, d):
    return vertex_state.get_slot(vertex_state.update_slot(_ps(spark, d), "deg", _keyed(spark, d), lambda old, u: u), "deg")


@query
def remove_slot(spark, d):
    g = vertex_state.update_slot(vertex_state.create_slot(_ps(spark, d), "other", "string"), "deg", _keyed(spark, d), lambda old, u: u)
    return vertex_state.remove_slot(vertex_state.remove_slot(g, "other"), "other").vertices


@query
def checkpointed_graph(spark, d):
    g = vertex_state.checkpoint(transform.map_vertices(_ps(spark, d), attr=F.pmod("id", F.lit(10))))
    return g.triplets(["src"]).groupBy("src_vertex.attr").agg(F.count(F.lit(1)).alias("n_edges"))


@query
def active_count(spark, d):
    g = _ps(spark, d)
    g = transform.with_active_set(g, g.vertices.where("id % 4 = 1"))
    return spark.createDataFrame([(degrees.active_count(g),)], "n bigint")


@query
def graph_from_text(spark, d):
    lines = tables.part_supplier(spark, d).select(F.concat_ws(" ", "src", "dst", "weight").alias("value"))
    return loaders.graph_from_text(spark, _written(spark, lines)).vertices


@query
def attach_labels(spark, d):
    labels = tables.table(spark, d, "part").select(tables.vertex("p_partkey", tables.PART).alias("id"), F.col("p_size").alias("label")).where("label <= 25")
    return loaders.attach_labels(_ps(spark, d).vertices, labels).withColumn("label", F.col("label").cast("double"))


@query
def train_test_split(spark, d):
    labelled = _ps(spark, d).vertices.withColumn("label", F.when(F.col("id") % 8 == 2, F.col("id") % 5))
    return vertex_state.split_training(labelled, 0.7, SEED)


# aggregations ----------------------------------------------------------------------------------------------------


def _degree(direction):
    return lambda spark, d: degrees.degrees(tables.part_supplier_rows(spark, d), direction)


def _values(direction):
    return lambda spark, d: degrees.edge_values(tables.part_supplier_rows(spark, d), "weight", direction)


for _n, _dir in (("out", OUT), ("in", IN), ("both", BOTH)):
    QUERIES[f"degree_{_n}"] = _degree(_dir)
    QUERIES[f"values_{_n}"] = _values(_dir)


@query
def edge_mean(spark, d):
    return tables.ratings(spark, d).agg(F.avg("rating").alias("mean"))


@query
def svd_bias_init(spark, d):
    return degrees.bias_init(tables.ratings(spark, d), "rating").select("id", F.round("bias", 6).alias("bias"), F.round("norm", 6).alias("norm"))


@query
def group_edges_sum(spark, d):
    return degrees.group_edges(_multi(spark, d), weight=F.sum("weight")).edges


@query
def group_edges_max(spark, d):
    return degrees.group_edges(_multi(spark, d), weight=F.max("weight"), n=F.count(F.lit(1))).edges


@query
def keyed_merge(spark, d):
    return degrees.keyed_merge(tables.part_supplier_rows(spark, d), "src", "weight", F.max)


@query
def aggregate_messages_sum(spark, d):
    g = _ps(spark, d)
    g = g.with_vertices(g.vertices.withColumn("x", F.pmod("id", F.lit(10))))
    return messages.aggregate_messages(g, [Send("dst", lambda t: t.src["x"] * t.edge["weight"]), Send("src", lambda t: t.dst["x"])], F.sum)


@query
def aggregate_messages_max(spark, d):
    return messages.aggregate_messages(_ps(spark, d), [Send("dst", lambda t: t.edge["weight"], lambda t: t.src_id % 2 == 0), Send("src", lambda t: -t.edge["weight"])], F.max)


@query
def aggregate_messages_src_only(spark, d):
    g = _ps(spark, d)
    g = transform.with_active_set(g, g.vertices.where("id % 5 < 2"))
    return messages.aggregate_messages(g, [Send("dst", lambda t: t.edge["weight"])], F.sum, EdgeActiveness.SRC_ONLY)


# neighbors -------------------------------------------------------------------------------------------------------


def _positions(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("neighbors").alias("pos", "nbr"))


@query
def neighbors_out(spark, d):
    return _positions(neighbors.plain(tables.part_supplier_rows(spark, d), OUT))


@query
def neighbors_in(spark, d):
    return _positions(neighbors.plain(tables.part_supplier_rows(spark, d), IN))


@query
def neighbors_both(spark, d):
    return _positions(neighbors.plain(tables.part_supplier_rows(spark, d), BOTH))


@query
def neighbors_weighted(spark, d):
    return _positions(neighbors.weighted(tables.part_supplier_rows(spark, d), OUT)).select("id", "pos", "nbr.nbr", "nbr.weight")


@query
def neighbors_typed(spark, d):
    lists = neighbors.typed(tables.typed(spark, d), BOTH).select("id", "type", F.explode("neighbors").alias("nbr_type", "list"))
    return lists.select("id", "type", "nbr_type", F.posexplode("list").alias("pos", "nbr"))


@query
def neighbors_typed_weighted(spark, d):
    lists = neighbors.typed_weighted(tables.typed(spark, d), OUT).select("id", "type", F.explode("neighbors").alias("nbr_type", "list"))
    return lists.select("id", "type", "nbr_type", F.posexplode("list").alias("pos", "e")).select("id", "type", "nbr_type", "pos", "e.nbr", "e.weight")


@query
def neighbors_merge(spark, d):
    e = tables.part_supplier(spark, d)
    return _positions(neighbors.merge(neighbors.plain(e.where("weight % 2 = 0")), neighbors.plain(e.where("weight % 3 = 0"))))


@query
def neighbors_merge_weighted(spark, d):
    e = tables.user_events(spark, d)
    more = e.withColumn("weight", F.col("weight") + 100)
    return _positions(neighbors.merge_weighted_tables(neighbors.weighted(e.where("weight % 2 = 0")), neighbors.weighted(more))).select("id", "pos", "nbr.nbr", "nbr.weight")


@query
def neighbors_merge_typed(spark, d):
    e = tables.typed(spark, d)
    both = neighbors.merge_typed_tables(neighbors.typed(e.where("src % 3 <> 0"), BOTH), neighbors.typed(e.where("src % 2 = 0"), BOTH))
    return _typed_positions(both).select("id", "type", "nbr_type", "pos", "nbr")


@query
def neighbors_merge_typed_weighted(spark, d):
    e = tables.typed(spark, d)
    more = e.withColumn("weight", F.col("weight") + 10)
    both = neighbors.merge_typed_tables(neighbors.typed_weighted(e.where("src % 3 <> 0")), neighbors.typed_weighted(more), weighted=True)
    return _typed_positions(both).select("id", "type", "nbr_type", "pos", "nbr.nbr", "nbr.weight")


def _typed_positions(df: DataFrame) -> DataFrame:
    lists = df.select("id", "type", F.explode("neighbors").alias("nbr_type", "list"))
    return lists.select("id", "type", "nbr_type", F.posexplode("list").alias("pos", "nbr"))


@query
def adjacency_slot(spark, d):
    """Adjacency of a text file's graph, as a slot."""
    e = tables.part_supplier(spark, d)
    g = loaders.graph_from_text(spark, _written(spark, e.select(F.concat_ws(" ", "src", "dst").alias("value"))))
    return neighbors.with_adjacency(g, BOTH).vertices.select("id", F.posexplode("slot_neighbor").alias("pos", "nbr"))


@query
def adjacency_typed(spark, d):
    """Typed weighted adjacency of a typed text file's graph, as a vertex attribute."""
    lines = tables.typed(spark, d).select(F.concat_ws(" ", "src", "src_type", "dst", "dst_type", "weight").alias("value"))
    e = loaders.any_edges_from_text(spark, _written(spark, lines)).withColumn("weight", F.col("weight").cast("double"))
    g = loaders.graph_with_adjacency(e, "typed_weighted", OUT, "adj")
    lists = g.vertices.select("id", F.explode("adj").alias("nbr_type", "list"))
    return lists.select("id", "nbr_type", F.posexplode("list").alias("pos", "e")).select("id", "nbr_type", "pos", "e.nbr", "e.weight")


@query
def has_typed_neighbor(spark, d):
    """Of customers and suppliers, which all have a nation: whether they are of nation 0."""
    t = neighbors.typed(tables.typed(spark, d), OUT).where(F.col("type").isin(tables.CUSTOMER, tables.SUPPLIER))
    return t.select("id", neighbors.has_typed_neighbor(F.col("neighbors"), F.lit(tables.NATION).cast("short"), F.lit(4)).cast("int").alias("found"))


@query
def has_neighbor(spark, d):
    e = tables.part_supplier(spark, d)
    return neighbors.plain(e).select("id", neighbors.has_neighbor(F.col("neighbors"), F.lit(9)).cast("int").alias("found"))


@query
def has_neighbor_pairs(spark, d):
    e = tables.part_supplier_rows(spark, d)
    n = e.count()
    pairs = dealt(e.select(F.col("src").alias("id"), (F.col("dst") + 8).alias("nbr")), n, "id", "nbr").distinct()
    return neighbors.pairs_in(e, pairs, n_edges=n).withColumn("found", F.col("found").cast("int"))


@query
def common_neighbors(spark, d):
    e = stored(tables.copurchased(spark, d), "copurchased")
    return neighbors.common_neighbors(e, e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# sampling --------------------------------------------------------------------------------------------------------


@query
def sample_one_uniform(spark, d):
    return sampling.one_uniform(directed(tables.part_supplier_rows(spark, d), BOTH), SEED)


@query
def sample_k_uniform(spark, d):
    e = tables.part_supplier_rows(spark, d)
    return sampling.k_uniform(directed(e, BOTH), 3, SEED, n_rows=2 * e.count())


@query
def sample_one_weighted(spark, d):
    return sampling.one_weighted(tables.user_events(spark, d).select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight"), SEED)


@query
def sample_k_weighted(spark, d):
    return sampling.k_weighted(tables.part_supplier(spark, d).select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight"), 3, SEED)


@query
def sample_one_typed(spark, d):
    return sampling.one_of_type(neighbors.typed_ends(tables.typed(spark, d), BOTH), tables.CUSTOMER, SEED)


@query
def sample_k_typed(spark, d):
    e = tables.typed(spark, d)
    return sampling.k_of_type(neighbors.typed_ends(e, BOTH), tables.CUSTOMER, 3, SEED, n_rows=2 * e.count())


@query
def sample_k_typed_weighted(spark, d):
    return sampling.k_of_type(neighbors.typed_weighted_rows(tables.typed(spark, d), BOTH), tables.CUSTOMER, 3, SEED, weighted=True)


@query
def sample_vertices_k(spark, d):
    return sampling.vertices(_ps(spark, d).vertices, 50, SEED)


# partitioning and order ------------------------------------------------------------------------------------------


@query
def partition_1d(spark, d):
    return tables.part_supplier(spark, d).select("src", "dst", partitioning.edge_partition_1d(7).alias("pid"))


@query
def partition_2d(spark, d):
    e = tables.part_supplier(spark, d)
    return e.select("src", "dst", partitioning.edge_partition_2d(9).alias("pid9"), partitioning.edge_partition_2d(7).alias("pid7"))


@query
def partition_random(spark, d):
    return partitioning.partition_by(tables.part_supplier(spark, d), "RandomVertexCut", 8).select("src", "dst", "pid")


@query
def partition_canonical(spark, d):
    return partitioning.partition_by(tables.part_supplier(spark, d), "CanonicalRandomVertexCut", 8).select("src", "dst", "pid")


@query
def partition_id_range(spark, d):
    v = _ps(spark, d).vertices
    ends = degrees.vertex_id_range(tables.part_supplier(spark, d)).first()
    return v.select("id", partitioning.id_range_partition(7, ends["min_id"], ends["max_id"]).alias("pid"))


def _sorted(order):
    return lambda spark, d: transform.sorted_positions(PropertyGraph.from_edges(tables.part_supplier(spark, d).select("src", "dst")), order)


for _n in ("out", "in", "both"):
    QUERIES[f"sorted_positions_{_n}"] = _sorted(_n)


# functions -------------------------------------------------------------------------------------------------------


@query
def array_set_functions(spark, d):
    e = tables.part_supplier(spark, d)
    a = neighbors.plain(e.where("weight % 2 = 0")).withColumnRenamed("neighbors", "a")
    b = neighbors.plain(e.where("weight % 3 = 0")).withColumnRenamed("neighbors", "b")
    x, y = F.col("a"), F.col("b")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return a.join(b, "id").select(
        "id", text(scalar.merge_sorted(x, y)).alias("both"), text(scalar.set_difference(x, y)).alias("minus"), text(scalar.set_intersection(x, y)).alias("shared"),
        text(scalar.head(x, 2)).alias("head"), text(scalar.last(x, 2)).alias("last"),
    )


@query
def pack_attributes(spark, d):
    e = tables.typed(spark, d).withColumn("packed", scalar.pack_shorts_and_int(F.col("src_type"), F.col("dst_type"), -F.col("weight")))
    a, b, c = scalar.unpack_shorts_and_int(F.col("packed"))
    return e.select("src", "dst", a.cast("int").alias("a"), b.cast("int").alias("b"), c.alias("c"))


@query
def vector_functions(spark, d):
    v = tables.part_supplier(spark, d).groupBy("src").agg(F.array_sort(F.collect_list(F.col("weight").cast("double"))).alias("v"))
    x = F.col("v")
    return v.select("src", scalar.dot(x, x).alias("dot"), F.array_max(scalar.axpy(F.lit(2.0), x, x)).alias("axpy"), F.array_min(scalar.scale(F.lit(-1.0), x)).alias("scale"))


@query
def map_functions(spark, d):
    e = tables.user_events(spark, d)

    def as_map(rows):
        return rows.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))

    both = as_map(e).join(as_map(e.where("weight % 2 = 0")).withColumnRenamed("m", "o"), "src")
    merged = scalar.map_merge(F.col("m"), F.col("o"), lambda a, b: a + b)
    return both.select("src", F.explode(merged).alias("dst", "weight"))


@query
def map_updates(spark, d):
    """The value of a key or a default, the union in which the right side stays, and a map without a key."""
    e = tables.user_events(spark, d)

    def as_map(rows):
        return rows.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))

    both = as_map(e).join(as_map(e.where("weight % 2 = 0").withColumn("weight", -F.col("weight"))).withColumnRenamed("m", "o"), "src")
    low = F.array_min(F.map_keys("m"))
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return both.select(
        "src", scalar.map_get(F.col("m"), low, F.lit(-1)).alias("lowest"), scalar.map_get(F.col("m"), F.lit(-5), F.lit(-1)).cast("int").alias("missing"),
        size(scalar.map_update(F.col("m"), F.col("o"))).alias("updated"), size(scalar.map_remove(F.col("m"), low)).alias("rest"),
    )


def _id_sets(spark, d):
    v = _ps(spark, d).vertices
    return v.where("id % 3 = 0"), v.where("id % 2 = 0")


@query
def id_union(spark, d):
    return sets.union_ids(*_id_sets(spark, d))


@query
def id_intersection(spark, d):
    return sets.intersect_ids(*_id_sets(spark, d))


@query
def id_difference(spark, d):
    return sets.except_ids(*_id_sets(spark, d))


@query
def id_symmetric_difference(spark, d):
    return sets.symmetric_difference_ids(*_id_sets(spark, d))


@query
def top_edges_by_vertex(spark, d):
    return sets.top_k(tables.part_supplier(spark, d), "src", 2, F.col("weight").desc(), F.col("dst"))


# iteration and algorithms ----------------------------------------------------------------------------------------


@query
def pagerank_fixed(spark, d):
    return algorithms.pagerank(tables.part_supplier(spark, d).select("src", "dst"), ROUNDS, freeze=0.0).select("id", F.round("rank", 6).alias("rank"))


@query
def pagerank_gated(spark, d):
    return algorithms.pagerank(tables.part_supplier(spark, d).select("src", "dst"), ROUNDS, freeze=0.001).select("id", F.round("rank", 6).alias("rank"))


@query
def pregel_min_label(spark, d):
    return algorithms.min_labels(PropertyGraph.from_edges(tables.typed(spark, d).select("src", "dst")), 3)


@query
def pregel_sssp(spark, d):
    g = PropertyGraph.from_edges(stored(tables.copurchased(spark, d), "copurchased"))
    return algorithms.shortest_paths(g, 10, UNBOUNDED)


@query
def connected_components(spark, d):
    return algorithms.connected_components(tables.typed(spark, d).select("src", "dst"))


@query
def triangle_count(spark, d):
    return algorithms.triangle_count(tables.copurchased(spark, d))


@query
def triangle_per_vertex(spark, d):
    return algorithms.triangles_per_vertex(tables.copurchased(spark, d))


def _text(df: DataFrame) -> DataFrame:
    return df.select("start", "walk", F.array_join(F.transform("path", lambda v: v.cast("string")), " ").alias("path"))


@query
def deepwalk(spark, d):
    return _text(walks.deepwalk(tables.part_supplier_rows(spark, d).select("src", "dst"), WALK_LENGTH, SEED, walks_per_vertex=2))


@query
def deepwalk_weighted(spark, d):
    return _text(walks.deepwalk(tables.user_events(spark, d), WALK_LENGTH, SEED, weighted=True))


@query
def node2vec(spark, d):
    return _text(walks.node2vec(tables.typed(spark, d).select("src", "dst"), WALK_LENGTH, 0.5, 0.8, SEED))


@query
def metapath_walk(spark, d):
    return _text(walks.metapath(tables.typed(spark, d), [tables.CUSTOMER, tables.NATION], WALK_LENGTH, SEED))


@query
def walk_text_sink(spark, d):
    path = _new_path(spark, "walks")
    sinks.write_walks(walks.deepwalk(tables.part_supplier_rows(spark, d).select("src", "dst"), 3, SEED), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


SVD = algorithms.SvdConf(rank=2, max_iterations=2, min_value=0.0, max_value=5.0, seed=SEED)


@query
def svdpp_factors(spark, d):
    f = algorithms.svd_plus_plus(tables.ratings(spark, d), "rating", SVD).factors
    return f.select("id", F.posexplode("v1").alias("k", "v1"), "v2", "v3").select("id", "k", F.round("v1", 6).alias("v1"), F.round(F.get("v2", F.col("k")), 6).alias("v2"), F.round("v3", 6).alias("v3"))


@query
def svdpp_error(spark, d):
    return algorithms.svd_plus_plus(tables.ratings(spark, d), "rating", SVD).errors.select("id", F.round("error", 6).alias("error"))


@query
def neighbor_mean_sampled(spark, d):
    e = tables.part_supplier_rows(spark, d)
    values = endpoints(e).select("id", F.pmod("id", F.lit(100)).cast("double").alias("value"))
    return algorithms.neighbor_mean(directed(e, BOTH), values, 4, SEED, n_rows=2 * e.count()).select("id", F.round("mean", 6).alias("mean"))
