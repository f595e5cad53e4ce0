import random

import pytest
from graphloom.functions import scalar
from graphloom.model import EdgeActiveness, EdgeDirection, PropertyGraph
from graphloom.operators import algorithms, degrees, messages, neighbors, partitioning, pregel, sampling, transform, vertex_state, walks
from graphloom.operators.messages import Send
from graphloom.sources import arguments, loaders, sinks
from pyspark.sql import functions as F

BOTH, IN, OUT, EITHER = EdgeDirection.BOTH, EdgeDirection.IN, EdgeDirection.OUT, EdgeDirection.EITHER


def edges(spark, rows, extra=""):
    return spark.createDataFrame(rows, "src long, dst long" + (f", {extra}" if extra else ""))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def written(tmp_path, text):
    path = tmp_path / "in.txt"
    path.write_text(text)
    return str(path)


@pytest.fixture
def triangle(spark):
    return PropertyGraph.from_edges(edges(spark, [(1, 2), (2, 3), (3, 1)]))


@pytest.fixture
def loop_dup(spark):
    return PropertyGraph.from_edges(edges(spark, [(1, 1, 9.0), (1, 2, 1.0), (1, 2, 2.0), (2, 1, 4.0)], "w double"))


# sources ---------------------------------------------------------------------------------------------------------


def test_text_with_comments_and_mixed_arity(spark, tmp_path):
    path = written(tmp_path, "# c\n\n1 2\n2\t3 0.5\n4 4 1\n")
    assert rows(loaders.edges_from_text(spark, path, "double")) == [(1, 2, 1.0), (2, 3, 0.5)]
    assert loaders.graph_from_text(spark, path, "double").vertices.count() == 3


@pytest.mark.parametrize(("kind", "text", "want"), [("long", "7", 7), ("boolean", "true", True), ("char", "xy", "x"), ("short", "3", 3), ("byte", "3", 3), ("float", "0.5", 0.5), ("int", "3", 3)])
def test_attribute_types(spark, tmp_path, kind, text, want):
    got = rows(loaders.edges_from_text(spark, written(tmp_path, f"1 2 {text}\n1 3\n"), kind))
    assert got[0] == (1, 2, want)
    assert got[1][2] in (1, True, "1")


@pytest.mark.parametrize(("text", "message"), [("7\n", "too few fields"), ("1 2 3 4\n", "too many fields")])
def test_bad_lines_raise(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        loaders.edges_from_text(spark, written(tmp_path, text)).collect()


def test_typed_text(spark, tmp_path):
    path = written(tmp_path, "1 0 2 1\n2 1 3 0 0.5\n3 0 1 1\n")
    assert rows(loaders.typed_edges_from_text(spark, path)) == [(1, 0, 2, 1, 1.0), (2, 1, 3, 0, 0.5), (3, 0, 1, 1, 1.0)]
    assert rows(loaders.typed_edges_from_text(spark, path, "drop")) == [(1, 1, 3, 0, 1.0)]
    assert (1, 1, 3, 0, 1.0) in rows(loaders.typed_edges_from_text(spark, path, "flip"))


def test_csv_keeps_sources_together(spark, tmp_path):
    path = written(tmp_path, "1,7,5.0\n1,9,1.0\n2,7,5.0\n")
    e = loaders.edges_from_csv(spark, path)
    assert rows(e)[0] == (1, 7, 5.0)
    assert e.withColumn("p", F.spark_partition_id()).groupBy("src").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] == 1


def test_orientation(spark):
    e = edges(spark, [(1, 2), (5, 3), (4, 4)])
    assert rows(loaders.edges_from_pairs(e, "drop")) == [(3, 5)]
    assert rows(loaders.edges_from_pairs(e, "flip")) == [(1, 2), (3, 5)]
    with pytest.raises(ValueError):
        loaders.edges_from_pairs(e, "no")


def test_adjacency_kinds(spark):
    e = spark.createDataFrame([(1, 0, 2, 1), (1, 0, 3, 0)], "src long, src_type int, dst long, dst_type int")
    for kind in ("plain", "weighted", "typed", "typed_weighted"):
        g = loaders.graph_with_adjacency(e, kind, slot="adj")
        assert g.vertices.where("adj IS NOT NULL").count() == 1 and g.vertices.count() == 3


def test_sinks_and_arguments(spark, tmp_path, triangle):
    sinks.write_edges(triangle.edges, str(tmp_path / "e"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "e")).collect()) == ["1\t2", "2\t3", "3\t1"]
    sinks.write_walks(walks.deepwalk(triangle.edges, 3, 1), str(tmp_path / "w"))
    assert all(len(r[0].split(" ")) == 3 for r in spark.read.text(str(tmp_path / "w")).collect())
    assert arguments.parse(["input:a:b", "x:", "y:Nan", "z", "n: 3"]) == {"input": "a:b", "n": "3"}


# transforms ------------------------------------------------------------------------------------------------------


def test_self_loops_go_and_parallel_edges_stay(loop_dup):
    assert loop_dup.edges.count() == 3
    assert rows(degrees.group_edges(loop_dup, w=F.sum("w")).edges) == [(1, 2, 3.0), (2, 1, 4.0)]
    assert rows(degrees.degrees(loop_dup.edges)) == [(1, 3), (2, 3)]


def test_reverse_twice_is_identity(loop_dup):
    assert rows(transform.reverse(transform.reverse(loop_dup)).edges) == rows(loop_dup.edges)
    assert rows(transform.reverse(loop_dup).edges) != rows(loop_dup.edges)


def test_unused_ends_are_not_joined(triangle):
    g = triangle.with_vertices(triangle.vertices.withColumn("x", F.col("id") * 2))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(transform.map_triplets(g, y=lambda t: t.src_id + t.dst_id).edges) == 0
    assert joins(transform.map_triplets(g, y=lambda t: t.dst["x"]).edges) == 1
    assert rows(transform.map_triplets(g, y=lambda t: t.src["x"] - t.dst["x"]).edges) == [(1, 2, -2), (2, 3, -2), (3, 1, 4)]


def test_subgraph_rules(spark):
    g = PropertyGraph.from_edges(edges(spark, [(1, 2, 5), (2, 3, 1), (4, 5, 9)], "w int"))
    sub = transform.subgraph(g, lambda v: v["id"] != 4, lambda t: t.edge["w"] > 2)
    assert rows(sub.edges) == [(1, 2, 5)] and rows(sub.vertices) == [(1,), (2,)]
    assert rows(transform.subgraph(g, lambda v: v["id"] != 4, lambda t: t.edge["w"] > 2, keep_isolated=True).vertices) == [(1,), (2,), (3,), (5,)]
    assert rows(transform.subgraph(g).edges) == rows(g.edges)


def test_activeness_table():
    for kind, want in ((EdgeActiveness.NEITHER, "1111"), (EdgeActiveness.SRC_ONLY, "0011"), (EdgeActiveness.DST_ONLY, "0101"), (EdgeActiveness.BOTH, "0001"), (EdgeActiveness.EITHER, "0111")):
        from pyspark.sql import SparkSession

        df = SparkSession.getActiveSession().createDataFrame([(False, False), (False, True), (True, False), (True, True)], "s boolean, d boolean")
        assert "".join(str(int(r[0])) for r in df.coalesce(1).select(transform.is_active(kind, F.col("s"), F.col("d"))).collect()) == want


def test_slots(triangle, spark):
    g = vertex_state.create_slot(triangle, "n", "long")
    with pytest.raises(ValueError):
        vertex_state.create_slot(g, "n", "long")
    other = spark.createDataFrame([(1, 5), (2, 6)], "id long, value long")
    g = vertex_state.update_slot(vertex_state.update_slot(g, "n", other, lambda o, u: F.coalesce(o, F.lit(0)) + u), "n", other.where("id = 1"), lambda o, u: o + u)
    assert rows(vertex_state.get_slot(g, "n")) == [(1, 10), (2, 6)]
    assert vertex_state.remove_slot(vertex_state.remove_slot(g, "n"), "n").vertices.columns == ["id"]
    with pytest.raises(KeyError):
        vertex_state.join_vertices(g, spark.createDataFrame([(99, 1)], "id long, value long"), "slot_n", lambda a, u: u, strict=True)


def test_split_honors_ratio(spark):
    df = spark.range(4000).withColumn("label", F.lit(1))
    n = vertex_state.split_training(df, 0.3).where("split = 'train'").count()
    assert 1050 < n < 1350


# aggregation -----------------------------------------------------------------------------------------------------


def test_degree_sums_to_twice_the_edges(spark):
    rng = random.Random(1)
    e = edges(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]).where("src <> dst")
    assert degrees.degrees(e).agg(F.sum("degree")).first()[0] == 2 * e.count()
    with pytest.raises(ValueError):
        degrees.degrees(e, EITHER)


def test_messages_are_gated(triangle):
    g = transform.with_active_set(triangle, triangle.vertices.where("id = 1"))
    send = [Send("dst", lambda t: t.src_id)]
    assert rows(messages.aggregate_messages(g, send, F.sum, EdgeActiveness.SRC_ONLY)) == [(2, 1)]
    assert rows(messages.aggregate_messages(g, send, F.sum, EdgeActiveness.DST_ONLY)) == [(1, 3)]
    assert rows(messages.aggregate_messages(g, send, F.sum)) == [(1, 3), (2, 1), (3, 2)]
    with pytest.raises(ValueError):
        messages.aggregate_messages(g, [Send("both", lambda t: t.src_id)])


def test_neighbors(spark):
    e = edges(spark, [(1, 2, 0.7), (1, 2, 0.5), (1, 3, 1.0), (2, 1, 2.0)], "weight double").withColumn("n", F.monotonically_increasing_id())
    assert rows(neighbors.plain(e, BOTH)) == [(1, [2, 3]), (2, [1]), (3, [1])]
    assert [(r["id"], [tuple(x) for x in r["neighbors"]]) for r in neighbors.weighted(e, OUT, order="n").orderBy("id").collect()] == [(1, [(2, 0.7), (3, 1.0)]), (2, [(1, 2.0)])]
    a, b = (spark.createDataFrame(x, "id long, neighbors array<long>") for x in ([(1, [1, 2]), (2, None)], [(1, [2, 5]), (3, [7])]))
    assert rows(neighbors.merge(a, b))[::2] == [(1, [1, 2, 5]), (3, [7])]


def test_missing_type_raises(spark):
    e = spark.createDataFrame([(1, 0, 2, 1)], "src long, src_type int, dst long, dst_type int")
    t = neighbors.typed(e)
    assert t.select(neighbors.has_typed_neighbor(F.col("neighbors"), F.lit(1), F.lit(2))).first()[0]
    with pytest.raises(Exception, match="no neighbors of type 7"):
        t.select(neighbors.has_typed_neighbor(F.col("neighbors"), F.lit(7), F.lit(2))).collect()


# sampling and walks ----------------------------------------------------------------------------------------------


def test_samples_are_neighbors_and_seeded(spark):
    rng = random.Random(2)
    e = edges(spark, list({(rng.randrange(30), rng.randrange(30)) for _ in range(200)}))
    r = neighbors.plain_rows(e)
    have = set(map(tuple, r.collect()))
    one, again, k = (set(map(tuple, x.collect())) for x in (sampling.one_uniform(r, 1), sampling.one_uniform(r, 1), sampling.k_uniform(r, 2, 1)))
    assert one == again and one <= have and k <= have and len({i for i, _ in one}) == len(one) == r.select("id").distinct().count()
    assert all(sum(1 for i, _ in k if i == v) == min(2, sum(1 for i, _ in have if i == v)) for v in range(30))


def test_weighted_sampling_follows_weights(spark):
    r = spark.range(4000).crossJoin(spark.createDataFrame([(1, 1), (2, 3)], "nbr long, weight int"))
    n = sampling.one_weighted(r, 5).where("nbr = 2").count()
    assert 2850 < n < 3150
    assert abs(sampling.k_weighted(r, 1, 5).where("nbr = 2").count() - 3000) < 150


def test_cells_hold_each_draw(spark):
    """The row that the running sums give for a draw is among those of the draw's cell, and cells are short."""
    rng = random.Random(4)
    lists = {i: {n: rng.choice([1e-6, 0.3, 1.0, 50.0]) for n in range(1 + 7 * i)} for i in range(12)}
    r = spark.createDataFrame([(i, n, w) for i, x in lists.items() for n, w in x.items()], "id long, nbr long, weight double")
    cells = [t.asDict() for t in sampling.with_cells(r).collect()]
    for i, x in lists.items():
        mine, total = [c for c in cells if c["id"] == i], sum(x.values())
        assert len(mine) <= 2 * len(x) + 2
        for u in [k / 997 for k in range(997)]:
            hit = [c["nbr"] for c in mine if c["cell"] == int(u * len(x)) and c["cum"] > u * c["total"] and c["cum"] - c["weight"] <= u * c["total"]]
            cum, want = 0.0, None
            for n, w in sorted(x.items()):
                want = n if cum <= u * total < cum + w else want
                cum += w
            assert hit == [want] or abs(sum(hit) - want) <= 1


def test_node2vec_follows_the_second_order_weights(spark):
    """From 1 over 0: back to 1 weighs 1/p, 2 and 3 (adjacent to 1) 1, the others 1/q; the shares agree with few tries and with many."""
    e = edges(spark, [(0, k) for k in range(1, 8)] + [(1, 2), (1, 3)])
    for tries in (1, 6):
        paths = [r["path"] for r in walks.node2vec(e, 3, 0.5, 4.0, 5, walks_per_vertex=3000, tries=tries).where("start = 1").collect()]
        third = [p[2] for p in paths if p[1] == 0]
        total = 2 + 2 * 1 + 4 * 0.25
        for v, w in ((1, 2), (2, 1), (3, 1), (7, 0.25)):
            assert abs(third.count(v) / len(third) - w / total) < 0.06


def test_typed_samples_and_merges(spark):
    e = spark.createDataFrame([(1, 0, 10 + k, k % 2, float(k + 1)) for k in range(6)] + [(2, 0, 10, 0, 9.0)], "src long, src_type int, dst long, dst_type int, weight double")
    r = neighbors.typed_weighted_rows(e)
    got = sampling.k_of_type(r, 1, 2, 3).collect()
    assert len({x["nbr"] for x in got}) == 2 and all(x["id"] == 1 and x["nbr"] in (11, 13, 15) for x in got)
    assert sampling.k_of_type(r, 0, 9, 3, weighted=True).count() == 4
    with pytest.raises(Exception, match="no neighbor of type 1"):
        sampling.k_of_type(r, 1, 2, 3, strict=True).collect()
    a, b = neighbors.typed_weighted(e.where("dst < 13")), neighbors.typed_weighted(e.withColumn("weight", F.lit(0.5)))
    both = {x["id"]: x["neighbors"] for x in neighbors.merge_typed_tables(a, b, weighted=True).collect()}
    assert [tuple(x) for x in both[1][0]] == [(10, 1.0), (12, 3.0), (14, 0.5)] and [tuple(x) for x in both[1][1]] == [(11, 2.0), (13, 0.5), (15, 0.5)]
    with pytest.raises(Exception, match="two types of vertex 1"):
        neighbors.merge_typed_tables(a, b.withColumn("type", F.lit(5)), weighted=True).collect()


def test_sniffed_text_persistence_and_ranges(spark, tmp_path):
    (tmp_path / "plain").write_text("# x\n1 2\n2 3 4\n")
    (tmp_path / "typed").write_text("1 0 2 1\n2 1 3 0 0.5\n")
    assert loaders.any_edges_from_text(spark, str(tmp_path / "plain")).columns == ["src", "dst", "attr"]
    assert "src_type" in loaders.any_edges_from_text(spark, str(tmp_path / "typed")).columns
    g = PropertyGraph.from_edges(edges(spark, [(k, k + 1) for k in range(20)])).persist()
    assert g.edges.is_cached and not g.unpersist().edges.is_cached and g.repartition(3).vertices.rdd.getNumPartitions() <= 3
    parts = partitioning.by_id_range(g.vertices, 4).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:], strict=False))


def test_walks_follow_edges(spark):
    rng = random.Random(3)
    pairs = list({(rng.randrange(25), rng.randrange(25)) for _ in range(60)} - {(i, i) for i in range(25)})
    e = edges(spark, pairs)
    both = set(pairs) | {(b, a) for a, b in pairs}
    for got in (walks.deepwalk(e, 7, 1), walks.node2vec(e, 5, 0.5, 2.0, 1), walks.deepwalk(e.withColumn("weight", F.lit(1)), 4, 1, weighted=True)):
        paths = [r["path"] for r in got.collect()]
        assert all((a, b) in both for p in paths for a, b in zip(p, p[1:], strict=False))
        assert len({len(p) for p in paths}) == 1
    dead = walks.deepwalk(edges(spark, [(1, 2), (2, 3)]), 6, 1, direction=OUT)
    assert {tuple(r["path"]) for r in dead.collect()} == {(1, 2, 3), (2, 3), (3,)}


def test_node2vec_prefers_to_return_with_small_p(spark):
    e = edges(spark, [(0, i) for i in range(1, 8)])
    back = lambda p: sum(r["path"][0] == r["path"][2] for r in walks.node2vec(e, 3, p, 1.0, 3, walks_per_vertex=30).where("start <> 0").collect())
    assert back(0.01) > 190 > back(1.0)


def test_metapath_types(spark):
    e = spark.createDataFrame([(1, 0, 12, 1), (2, 0, 12, 1), (12, 1, 30, 2)], "src long, src_type int, dst long, dst_type int")
    got = walks.metapath(e, [0, 1], 5, 1).where("start IN (1, 2)").collect()
    assert all(len(r["path"]) == 5 and all(v < 10 if k % 2 == 0 else v == 12 for k, v in enumerate(r["path"])) for r in got)
    with pytest.raises(Exception, match="no neighbor of type 7"):
        walks.metapath(e, [0, 7], 3, 1, strict=True).collect()


# iteration and algorithms ----------------------------------------------------------------------------------------


def test_pagerank_on_a_triangle_is_uniform_and_conserves_mass(spark, triangle):
    assert all(abs(r["rank"] - 1) < 1e-12 for r in algorithms.pagerank(triangle.edges, 12).collect())
    rng = random.Random(4)
    e = edges(spark, list({(rng.randrange(50), rng.randrange(50)) for _ in range(150)} - {(i, i) for i in range(50)}))
    got = algorithms.pagerank(e, 13, freeze=0.0)
    assert abs(got.agg(F.sum("rank")).first()[0] - got.count()) < 1e-6


def test_pregel_rounds_and_halting(spark):
    chain = PropertyGraph.from_edges(edges(spark, [(k, k + 1) for k in range(10)]))
    assert {r["id"]: r["label"] for r in algorithms.min_labels(chain, 3).collect()} == {k: max(0, k - 4) for k in range(11)}
    assert {r["label"] for r in algorithms.min_labels(chain, 30).collect()} == {0}
    got = {r["id"]: r["distance"] for r in algorithms.shortest_paths(chain, 2, 4).collect()}
    assert got == {k: (float(k - 2) if 2 <= k <= 7 else None) for k in range(11)}
    with pytest.raises(ValueError):
        pregel.pregel(chain, None, lambda a, m: a, [], max_iterations=0)


def test_pregel_passes_null_to_vertices_without_message(spark):
    g = PropertyGraph.from_edges(edges(spark, [(1, 2)]))
    g = g.with_vertices(g.vertices.withColumn("attr", F.lit(0)))
    out = pregel.pregel(g, F.lit(5), lambda a, m: F.coalesce(a + m, F.lit(-1)), [Send("dst", lambda t: F.lit(1))], F.sum, max_iterations=1, active_direction=None)
    assert {r["id"]: r["attr"] for r in out.vertices.collect()} == {1: -1, 2: 7}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (2000, 2000)]
    up = {v: v for p in pairs for v in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert {r["id"]: r["component"] for r in algorithms.connected_components(edges(spark, pairs)).collect()} == {v: find(v) for v in up}


def test_triangles_equal_brute_force(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(120)]
    near = {v: {b for a, b in pairs if a == v and b != v} | {a for a, b in pairs if b == v and a != v} for v in range(25)}
    want = sum(1 for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c)
    e = edges(spark, pairs)
    assert algorithms.triangle_count(e).first()[0] == want
    assert algorithms.triangles_per_vertex(e).agg(F.sum("triangles")).first()[0] == 3 * want


RATINGS = [(u, 7 + 2 * i, 5.0 if (u <= 2) == (i < 2) else 1.0) for u in (1, 2, 3, 4) for i in range(4)]


def test_svd_plus_plus_fits_ratings(spark):
    e = edges(spark, RATINGS, "rating double")
    conf = algorithms.SvdConf(rank=10, max_iterations=2, min_value=0.0, max_value=5.0)
    model = algorithms.svd_plus_plus(e, "rating", conf)
    assert model.errors.agg(F.sum("error")).first()[0] / len(RATINGS) <= 8.0
    longer = algorithms.svd_plus_plus(e, "rating", algorithms.SvdConf(rank=3, max_iterations=12, gamma1=0.02, gamma2=0.02))
    assert longer.errors.agg(F.sum("error")).first()[0] < model.errors.agg(F.sum("error")).first()[0]
    for bad in ({"max_iterations": 0}, {"max_value": 0.0}):
        with pytest.raises(ValueError):
            algorithms.svd_plus_plus(e, "rating", algorithms.SvdConf(**bad))


# partitioning and functions --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", partitioning.STRATEGIES)
@pytest.mark.parametrize("n", [1, 4, 7])
def test_partitions_are_in_range(spark, name, n):
    e = edges(spark, [(a, b) for a in (-(1 << 63), -7, 0, 5, 100000, (1 << 63) - 1) for b in (1, 2, 99)])
    pids = {r["pid"] for r in partitioning.partition_by(e, name, n).collect()}
    assert pids <= set(range(n))
    with pytest.raises(ValueError):
        partitioning.strategy("Other")


def test_canonical_cut_ignores_direction(spark):
    e = edges(spark, [(3, 8), (8, 3)])
    assert len({r["pid"] for r in partitioning.partition_by(e, "CanonicalRandomVertexCut", 64).collect()}) == 1


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalar.uniform(42, "walk", 7, 3)) == 0.11591496102294596
    assert value(scalar.wrapped_product(F.lit(100000).cast("long"), partitioning.MIXING_PRIME)) == 1909526242002390304
    packed = scalar.pack_shorts_and_int(F.lit(-3), F.lit(7), F.lit(-9))
    assert [value(x) for x in scalar.unpack_shorts_and_int(packed)] == [-3, 7, -9]
    a = F.array(*map(F.lit, (3, 1, 2)))
    assert (value(scalar.last(a, 2)), value(scalar.last(a, 9)), value(scalar.last(a, 0)), value(scalar.head(a, 2))) == ([1, 2], [3, 1, 2], [], [3, 1])
    m = F.create_map(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    assert value(scalar.map_update(m, F.create_map(F.lit(3), F.lit(9)))) == {1: 2, 3: 9}
    assert value(scalar.map_get(m, F.lit(8), F.lit(0))) == 0 and value(scalar.map_remove(m, F.lit(1))) == {3: 4}
    left = F.array(F.struct(F.lit(1).alias("nbr"), F.lit(0.5).alias("w")))
    right = F.array(F.struct(F.lit(1).alias("nbr"), F.lit(9.0).alias("w")), F.struct(F.lit(0).alias("nbr"), F.lit(2.0).alias("w")))
    assert [tuple(x) for x in value(scalar.merge_weighted(left, right))] == [(0, 2.0), (1, 0.5)]


def test_sets_and_folds(spark):
    from graphloom.operators import sets

    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2, 2, 3], [3, 4]))
    assert [rows(f(a, b)) for f in (sets.union_ids, sets.intersect_ids, sets.except_ids, sets.symmetric_difference_ids)] == [[(1,), (2,), (3,), (4,)], [(3,)], [(1,), (2,)], [(1,), (2,), (4,)]]
    assert sets.all_true(a.withColumn("x", F.col("id") > 0), "x").first()[0] and sets.all_true(a.where("false").withColumn("x", F.lit(False)), "x").first()[0]
    assert sets.fold([1, 2, 3], lambda x, y: x - y) == -4 and sets.fold([], max) is None
    sets.for_each_partition(a, lambda r: list(r))


# pairs of lists --------------------------------------------------------------------------------------------------


def test_lists_of_pairs_meet_without_rows_for_candidates(spark):
    """Neither triangles nor common neighbors shuffle a row for each wedge: of a graph whose wedges are hundreds for each edge, a few rows for each edge move."""
    rng = random.Random(8)
    pairs = list({(min(p), max(p)) for p in ((rng.randrange(300), rng.randrange(300)) for _ in range(9000)) if p[0] != p[1]})
    near = {v: set() for v in range(300)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    e = edges(spark, pairs).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for f, want in (
        (lambda: rows(neighbors.common_neighbors(e, e.toDF("a", "b"))), sorted(((a, b, len(near[a] & near[b])) for a, b in pairs), key=repr)),
        (lambda: algorithms.triangle_count(e).first()[0], sum(len(near[a] & near[b]) for a, b in pairs) // 3),
        (lambda: rows(algorithms.triangles_per_vertex(e)), sorted(((v, sum(len(near[v] & near[b]) for b in near[v]) // 2) for v in near), key=repr)),
    ):
        assert most_rows(spark, "shuffle records written", lambda f=f, want=want: _equal(f(), want)) < 4 * len(pairs)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _equal(got, want):
    assert got == want


def most_rows(spark, metric, run):
    """The largest ``metric`` of any plan node of the queries that ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, most = store.executionsCount(), 0
    run()
    for k in range(before, store.executionsCount()):
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for i in range(nodes.size()):
            for j in range(nodes.apply(i).metrics().size()):
                m = nodes.apply(i).metrics().apply(j)
                if m.name() == metric and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    assert most
    return most


def test_common_neighbors_of_any_pairs(spark):
    """Repeated pairs, ends without edges, null ends, other columns, hubs on either side, and lists over many blocks."""
    rng = random.Random(9)
    links = [(0, k) for k in range(1, 60)] + [(1, k) for k in range(2, 50, 3)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(150)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    asked = [(rng.randrange(64), rng.randrange(64), str(k)) for k in range(400)] + [(0, 1, "x"), (0, 1, "x"), (1, 0, "y"), (None, 1, "n"), (1, None, "m"), (99, 98, "z"), (0, 0, "self")]
    want = sorted(((a, b, t, len(near.get(a, set()) & near.get(b, set()))) for a, b, t in asked), key=repr)
    p = spark.createDataFrame(asked, "a long, b long, t string")
    for long in (10_000, 20):
        assert rows(neighbors.common_neighbors(edges(spark, links), p, long=long).select("a", "b", "t", "common")) == want


def test_triangles_with_heavy_vertices(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "HEAVY", 3)
    rng = random.Random(10)
    pairs = [(90, k) for k in range(60)] + [(5, k) for k in range(60)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(7, 7)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {tuple(sorted((a, b, c))) for a in near for b in near[a] for c in near[a] & near[b]}
    got = [tuple(sorted(r)) for r in algorithms.triangles(edges(spark, pairs)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert algorithms.triangle_count(edges(spark, pairs)).first()[0] == len(want)
    assert algorithms.triangle_count(edges(spark, [(1, 1)])).first()[0] == 0
    per = {r["id"]: r["triangles"] for r in algorithms.triangles_per_vertex(edges(spark, [*pairs, (500, 500)])).collect()}
    assert per == {v: sum(v in t for t in want) for v in [*near, 500]}


def test_node2vec_does_not_read_a_hub_for_each_walk(spark):
    """Walks of which no draw is accepted find their neighbor without a row for each neighbor of the hub."""
    e = edges(spark, [(0, k) for k in range(1, 501)])
    assert most_rows(spark, "number of output rows", lambda: walks.node2vec(e, 3, 0.5, 0.8, 3, tries=1).collect()) < 6000


@pytest.mark.parametrize("direction", [BOTH, OUT])
def test_node2vec_equals_brute_force(spark, direction):
    import hashlib

    rng = random.Random(11)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(50)] + [(0, k) for k in range(1, 14)] + [(3, 3), (20, 3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        if direction is BOTH:
            near.setdefault(b, set()).add(a)
    u = lambda *key: int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52
    p, q = 0.25, 0.5
    weigh = lambda prev, x: 4.0 if x == prev else 1.0 if x in near.get(prev, ()) else 2.0

    def walk(start, tries):
        path, prev, cur = [start], None, start
        for at in range(1, 6):
            if not (options := sorted(near.get(cur, ()))):
                break
            nxt = None
            for t in range(1 if prev is None else tries):
                x = options[int(u(9, "node2vec", start, 0, at, t) * len(options))]
                if nxt is None and (prev is None or u(9, "accept", start, 0, at, t) * 4.0 < weigh(prev, x)):
                    nxt = x
            if nxt is None:
                goal, cum = u(9, "node2vec", start, 0, at) * sum(weigh(prev, x) for x in options), 0.0
                for x in options:
                    cum += weigh(prev, x)
                    if nxt is None and cum > goal:
                        nxt = x
            path, prev, cur = [*path, nxt], cur, nxt
        return path

    for tries in (1, 3):
        got = {r["start"]: r["path"] for r in walks.node2vec(edges(spark, pairs), 6, p, q, 9, direction=direction, tries=tries).collect()}
        assert got == {v: walk(v, tries) for v in {x for e in pairs for x in e}}


# sizes of tasks --------------------------------------------------------------------------------------------------


def test_tasks_follow_the_rows(spark):
    """Where their number is known, rows go to more partitions than the session's, and repeated neighbors count once."""
    r = spark.range(900).selectExpr("id % 30 AS id", "id % 7 AS nbr")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "4)" in plan(neighbors.plain_rows(r.toDF("src", "dst"))) and ", 9)" in plan(neighbors.plain_rows(r.toDF("src", "dst"), n_edges=9_000_000))
    many = sampling.k_uniform(r, 3, 5, n_rows=9_000_000)
    assert ", 9)" in plan(many) and rows(many) == rows(sampling.k_uniform(r.distinct(), 3, 5))
    assert rows(sampling.one_uniform(r, 5)) == rows(sampling.one_uniform(r.distinct(), 5)) and "Sort" not in plan(sampling.one_uniform(r, 5))


def test_parts_of_a_cut_are_split_by_size(spark):
    e = spark.range(40_000).selectExpr("id AS src", "id * 7919 % 1000003 AS dst")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        got = partitioning.partition_by(e, "RandomVertexCut", 2).withColumn("task", F.spark_partition_id())
        assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 15_000 and got.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_iterations_sort_no_edges(spark):
    """Rounds of PageRank hash the ranks beside a table that lies in place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = algorithms.pagerank(edges(spark, [(1, 2), (2, 3)]), 2)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_svd_plus_plus_counts_parallel_and_shared_ids(spark):
    """An id that is a user and an item, and errors of all items."""
    e = edges(spark, [(1, 2, 5.0), (2, 3, 1.0), (1, 3, 4.0), (4, 2, 2.0)], "rating double")
    model = algorithms.svd_plus_plus(e, "rating", algorithms.SvdConf(rank=2))
    assert {r["id"] for r in model.errors.collect()} == {2, 3} and model.factors.count() == 4
