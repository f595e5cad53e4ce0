"""DuckDB SQL for the queries of the catalog; iterative ones are chained common table expressions, one for each step."""

from __future__ import annotations

from .catalog import ROUNDS, SEED, SVD, WALK_LENGTH

# graphs ----------------------------------------------------------------------------------------------------------

_MULTI = "multi AS (SELECT l_partkey * 8 + 2 AS src, l_suppkey * 8 + 1 AS dst, l_quantity::BIGINT AS weight FROM lineitem)"
_PS = "ps AS (SELECT l_partkey * 8 + 2 AS src, l_suppkey * 8 + 1 AS dst, sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY 1, 2)"
_TYPED = """t0 AS (SELECT c_custkey * 8 AS src, 0 AS src_type, c_nationkey::BIGINT * 8 + 4 AS dst, 4 AS dst_type FROM customer
  UNION ALL SELECT s_suppkey * 8 + 1, 1, s_nationkey::BIGINT * 8 + 4, 4 FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 4, 4, n_regionkey::BIGINT * 8 + 5, 5 FROM nation
  UNION ALL SELECT o_orderkey * 8 + 3, 3, o_custkey * 8, 0 FROM orders),
typed AS (SELECT *, 1 + src % 5 AS weight FROM t0)"""
_COP = """cop AS (SELECT DISTINCT a.l_partkey * 8 + 2 AS src, b.l_partkey * 8 + 2 AS dst
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""
_RATE = """rate AS (SELECT o_custkey * 8 AS src, l_partkey * 8 + 2 AS dst, 1 + (sum(l_quantity)::BIGINT % 5)::DOUBLE AS rating
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
_EVENT = """ev AS (SELECT user_id * 8 + 6 AS src, ('0x' || substr(md5(event_type), 1, 8))::BIGINT * 8 + 7 AS dst, count(*) AS weight
  FROM events GROUP BY user_id, event_type)"""


def _u(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _both(table: str, more: str = "") -> str:
    return f"(SELECT src AS id, dst AS nbr{more} FROM {table} UNION ALL SELECT dst, src{more} FROM {table})"


def _ends(table: str) -> str:
    return f"(SELECT src AS id FROM {table} UNION SELECT dst FROM {table})"


_TO_CUSTOMER = "c AS (SELECT id, nbr, min(weight) AS weight FROM (SELECT src AS id, dst AS nbr, dst_type AS t, weight FROM typed UNION ALL SELECT dst, src, src_type, weight FROM typed) WHERE t = 0 GROUP BY 1, 2)"
_KEYED = "keyed AS (SELECT src AS id, count(*) AS value FROM ps GROUP BY 1 HAVING src % 3 = 0)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ORACLE: dict[str, str] = {
    "edges_text_parse": _with(_PS) + "SELECT src, dst, CASE WHEN weight % 2 = 0 THEN 1 ELSE weight END AS attr FROM ps",
    "edges_csv_parse": _with(_PS) + "SELECT src, dst, weight::DOUBLE AS attr FROM ps",
    "typed_edges_parse": _with(_TYPED) + "SELECT src, src_type::SMALLINT AS src_type, dst, dst_type::SMALLINT AS dst_type, CASE WHEN src_type > 0 THEN weight ELSE 1 END::DOUBLE AS weight FROM typed",
    "edge_text_sink": _with(_PS) + "SELECT concat_ws(chr(9), src, dst, weight) AS line FROM ps",
    "edges_drop_self_loops": _with(_PS) + "SELECT src, dst FROM ps WHERE weight % 7 <> 0",
    "canonical_orientation": _with(_PS) + "SELECT dst AS src, src AS dst, weight FROM ps WHERE src > dst",
    "canonical_flip": _with(_TYPED) + """SELECT least(src, dst) AS src, CASE WHEN src > dst THEN dst_type ELSE src_type END::SMALLINT AS src_type, greatest(src, dst) AS dst,
        CASE WHEN src > dst THEN src_type ELSE dst_type END::SMALLINT AS dst_type, weight FROM typed""",
    "weighted_pairs": _with(_EVENT) + "SELECT src, dst, weight FROM ev",
    "vertices_from_edges": _with(_PS) + f"SELECT id FROM {_ends('ps')}",
    "graph_counts": _with(_MULTI) + f"SELECT (SELECT count(*) FROM {_ends('multi')}) AS n_vertices, (SELECT count(*) FROM multi) AS n_edges",
    "min_max_vertex": _with(_PS) + "SELECT min(least(src, dst)) AS min_id, max(greatest(src, dst)) AS max_id FROM ps",
    "adjacency_attribute": _with(_PS) + "SELECT src AS id, dst AS nbr, 1.0::DOUBLE AS weight FROM ps",
    "map_vertices": _with(_PS) + f"SELECT id, id % 8 AS kind, id // 8 AS key FROM {_ends('ps')}",
    "map_edges": _with(_PS) + "SELECT src, dst, weight * 2 AS double_weight FROM ps",
    "map_triplets": _with(_PS) + "SELECT src, dst, src % 10 * 100 + dst % 10 * 10 + weight % 10 AS score FROM ps",
    "map_triplets_src_only": _with(_PS) + "SELECT src, dst, src % 10 + dst AS score FROM ps",
    "reverse_edges": _with(_PS) + "SELECT dst AS src, src AS dst, weight FROM ps",
    "triplets_view": _with(_PS) + "SELECT src, dst, weight, src % 10 AS src_x, dst % 10 AS dst_x FROM ps",
    "without_vertex_attributes": _with(_PS) + f"SELECT id, NULL::BIGINT AS attr FROM {_ends('ps')}",
    "subgraph_edges": _with(_PS) + "SELECT src, dst, weight FROM ps WHERE src % 3 <> 0 AND dst % 3 <> 0 AND weight > 20 AND src > dst",
    "subgraph_vertices": _with(_PS, "k AS (SELECT src, dst FROM ps WHERE src % 3 <> 0 AND dst % 3 <> 0 AND weight > 20 AND src > dst)") + f"SELECT id FROM {_ends('k')}",
    "subgraph_keep_isolated": _with(_PS) + f"SELECT id FROM {_ends('ps')} WHERE id % 3 <> 0",
    "active_edges": _with(_PS, "f AS (SELECT src, dst, (src % 4 = 1)::INT AS s, (dst % 4 = 1)::INT AS d FROM ps)") + "SELECT src, dst, 1 AS neither, s AS src_only, d AS dst_only, s & d AS both, s | d AS either FROM f",
    "join_vertices": _with(_PS, _KEYED) + f"SELECT id, id % 100 + 1000 * coalesce(value, 0) AS attr FROM {_ends('ps')} LEFT JOIN keyed USING (id)",
    "update_slots": _with(_PS, _KEYED) + f"SELECT id, value * CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS slot_deg FROM {_ends('ps')} LEFT JOIN keyed USING (id)",
    "get_slot": _with(_PS, _KEYED) + "SELECT id, value FROM keyed",
    "attach_labels": _with(_PS) + f"SELECT id, p_size::DOUBLE AS label FROM {_ends('ps')} LEFT JOIN part ON id = p_partkey * 8 + 2 AND p_size <= 25",
    "train_test_split": _with(_PS) + f"""SELECT id, CASE WHEN id % 8 = 2 THEN id % 5 END AS label,
        CASE WHEN id % 8 = 2 THEN CASE WHEN {_u(f"'{SEED}'", "'split'", 'id')} < 0.7 THEN 'train' ELSE 'test' END END AS split FROM {_ends('ps')}""",
    "degree_out": _with(_MULTI) + "SELECT src AS id, count(*) AS degree FROM multi GROUP BY 1",
    "degree_in": _with(_MULTI) + "SELECT dst AS id, count(*) AS degree FROM multi GROUP BY 1",
    "degree_both": _with(_MULTI) + f"SELECT id, count(*) AS degree FROM {_both('multi')} GROUP BY 1",
    "values_out": _with(_MULTI) + "SELECT src AS id, sum(weight)::BIGINT AS total FROM multi GROUP BY 1",
    "values_in": _with(_MULTI) + "SELECT dst AS id, sum(weight)::BIGINT AS total FROM multi GROUP BY 1",
    "values_both": _with(_MULTI) + f"SELECT id, sum(weight)::BIGINT AS total FROM {_both('multi', ', weight')} GROUP BY 1",
    "edge_mean": _with(_RATE) + "SELECT avg(rating) AS mean FROM rate",
    "svd_bias_init": _with(_RATE) + f"SELECT id, round(avg(rating) - (SELECT avg(rating) FROM rate), 6) AS bias, round(1 / sqrt(count(*)), 6) AS norm FROM {_both('rate', ', rating')} GROUP BY 1",
    "group_edges_sum": _with(_MULTI) + "SELECT src, dst, sum(weight)::BIGINT AS weight FROM multi GROUP BY 1, 2",
    "group_edges_max": _with(_MULTI) + "SELECT src, dst, max(weight) AS weight, count(*) AS n FROM multi GROUP BY 1, 2",
    "keyed_merge": _with(_MULTI) + "SELECT src, max(weight) AS weight FROM multi GROUP BY 1",
    "aggregate_messages_sum": _with(_PS) + "SELECT id, sum(m)::BIGINT AS msg FROM (SELECT dst AS id, src % 10 * weight AS m FROM ps UNION ALL SELECT src, dst % 10 FROM ps) GROUP BY 1",
    "aggregate_messages_max": _with(_PS) + "SELECT id, max(m) AS msg FROM (SELECT dst AS id, weight AS m FROM ps WHERE src % 2 = 0 UNION ALL SELECT src, -weight FROM ps) GROUP BY 1",
    "aggregate_messages_src_only": _with(_PS) + "SELECT dst AS id, sum(weight)::BIGINT AS msg FROM ps WHERE src % 5 < 2 GROUP BY 1",
    "has_neighbor": _with(_PS) + "SELECT src AS id, max((dst = 9)::INT) AS found FROM ps GROUP BY 1",
    "has_neighbor_pairs": _with(_PS) + "SELECT src AS id, dst + 8 AS nbr, EXISTS (SELECT 1 FROM ps q WHERE q.src = p.src AND q.dst = p.dst + 8)::INT AS found FROM ps p",
    "common_neighbors": _with(_COP, f"n AS (SELECT DISTINCT id, nbr FROM {_both('cop')})", "q AS (SELECT src AS a, dst AS b FROM cop)") + """
        SELECT q.a, q.b, count(y.nbr) AS common FROM q LEFT JOIN n x ON x.id = q.a LEFT JOIN n y ON y.id = q.b AND y.nbr = x.nbr GROUP BY 1, 2""",
    "sample_one_uniform": _with(_PS, f"n AS (SELECT DISTINCT id, nbr FROM {_both('ps')})") + f"SELECT id, arg_min(nbr, {_u(f"'{SEED}'", "'one'", 'id', 'nbr')}) AS nbr FROM n GROUP BY 1",
    "sample_k_uniform": _with(_PS, f"n AS (SELECT DISTINCT id, nbr FROM {_both('ps')})") + f"SELECT id, nbr FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_u(f"'{SEED}'", "'k'", 'id', 'nbr')}, nbr) <= 3",
    "sample_one_weighted": _with(_EVENT) + f"SELECT src AS id, arg_max(dst, ln({_u(f"'{SEED}'", "'one'", 'src', 'dst')}) / weight) AS nbr FROM ev GROUP BY 1",
    "sample_k_weighted": _with(_PS) + f"SELECT src AS id, dst AS nbr FROM ps QUALIFY row_number() OVER (PARTITION BY src ORDER BY ln({_u(f"'{SEED}'", "'k'", 'src', 'dst')}) / weight DESC, dst) <= 3",
    "sample_one_typed": _with(_TYPED, _TO_CUSTOMER) + f"SELECT id, arg_min(nbr, {_u(f"'{SEED}'", "'one'", 'id', 'nbr')}) AS nbr FROM c GROUP BY 1",
    "sample_k_typed": _with(_TYPED, _TO_CUSTOMER) + f"SELECT id, nbr FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_u(f"'{SEED}'", "'k'", 'id', 'nbr')}, nbr) <= 3",
    "sample_k_typed_weighted": _with(_TYPED, _TO_CUSTOMER) + f"SELECT id, nbr FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY ln({_u(f"'{SEED}'", "'k'", 'id', 'nbr')}) / weight DESC, nbr) <= 3",
    "remove_slot": _with(_PS, _KEYED) + f"SELECT id, value AS slot_deg FROM {_ends('ps')} LEFT JOIN keyed USING (id)",
    "checkpointed_graph": _with(_PS) + "SELECT src % 10 AS attr, count(*) AS n_edges FROM ps GROUP BY 1",
    "active_count": _with(_PS) + f"SELECT count(*) AS n FROM {_ends('ps')} WHERE id % 4 = 1",
    "graph_from_text": _with(_PS) + f"SELECT id FROM {_ends('ps')}",
    "adjacency_slot": _with(_PS) + f"SELECT id, (row_number() OVER (PARTITION BY id ORDER BY nbr) - 1)::INT AS pos, nbr FROM (SELECT DISTINCT id, nbr FROM {_both('ps')})",
    "adjacency_typed": _with(_TYPED) + "SELECT src AS id, dst_type::SMALLINT AS nbr_type, (row_number() OVER (PARTITION BY src, dst_type ORDER BY dst) - 1)::INT AS pos, dst AS nbr, min(weight)::DOUBLE AS weight FROM typed GROUP BY src, dst_type, dst",
    "has_typed_neighbor": _with(_TYPED) + "SELECT src AS id, max((dst = 4)::INT) AS found FROM typed WHERE src_type < 2 GROUP BY 1",
    "neighbors_merge_weighted": _with(_EVENT) + "SELECT src AS id, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS pos, dst AS nbr, CASE WHEN weight % 2 = 0 THEN weight ELSE weight + 100 END AS weight FROM ev",
    "neighbors_merge_typed_weighted": _with(_TYPED) + """SELECT src AS id, src_type::SMALLINT AS type, dst_type::SMALLINT AS nbr_type, (row_number() OVER (PARTITION BY src, dst_type ORDER BY dst) - 1)::INT AS pos, dst AS nbr,
        min(CASE WHEN src % 3 <> 0 THEN weight ELSE weight + 10 END) AS weight FROM typed GROUP BY src, src_type, dst_type, dst""",
    "neighbors_merge_typed": _with(_TYPED, "some_of AS (SELECT * FROM typed WHERE src % 3 <> 0 OR src % 2 = 0)") + """SELECT id, type::SMALLINT AS type, nbr_type::SMALLINT AS nbr_type, (row_number() OVER (PARTITION BY id, nbr_type ORDER BY nbr) - 1)::INT AS pos, nbr
        FROM (SELECT DISTINCT * FROM (SELECT src AS id, src_type AS type, dst AS nbr, dst_type AS nbr_type FROM some_of UNION ALL SELECT dst, dst_type, src, src_type FROM some_of))""",
    "partition_id_range": _with(_PS, f"v AS (SELECT id FROM {_ends('ps')})") + "SELECT id, ((id - (SELECT min(id) FROM v)) // ((SELECT max(id) - min(id) + 7 FROM v) // 7))::INT AS pid FROM v",
    "partition_random": _with(_PS) + f"SELECT src, dst, floor({_u("'cut'", 'src', 'dst')} * 8)::INT AS pid FROM ps",
    "partition_canonical": _with(_PS) + f"SELECT src, dst, floor({_u("'cut'", 'least(src, dst)', 'greatest(src, dst)')} * 8)::INT AS pid FROM ps",
    "map_updates": _with(_EVENT) + """, l AS (SELECT src, arg_min(weight, dst) AS lowest, sum(weight)::BIGINT AS total, sum(CASE WHEN weight % 2 = 0 THEN -weight ELSE weight END)::BIGINT AS updated FROM ev GROUP BY 1)
        SELECT src, lowest, -1 AS missing, updated, total - lowest AS rest FROM l WHERE src IN (SELECT src FROM ev WHERE weight % 2 = 0)""",
    "sample_vertices_k": _with(_PS) + f"SELECT id FROM {_ends('ps')} ORDER BY {_u(f"'{SEED}'", "'vertex'", 'id')}, id LIMIT 50",
    "array_set_functions": _with(_PS, "a AS (SELECT src AS id, list(dst ORDER BY dst) AS a FROM ps WHERE weight % 2 = 0 GROUP BY 1)", "b AS (SELECT src AS id, list(dst ORDER BY dst) AS b FROM ps WHERE weight % 3 = 0 GROUP BY 1)") + """
        SELECT id, array_to_string(list_sort(list_distinct(a || b)), ',') AS both, array_to_string([x FOR x IN a IF NOT list_contains(b, x)], ',') AS minus,
               array_to_string([x FOR x IN a IF list_contains(b, x)], ',') AS shared, array_to_string(a[1:2], ',') AS head, array_to_string(a[-2:], ',') AS last
        FROM a JOIN b USING (id)""",
    "pack_attributes": _with(_TYPED) + "SELECT src, dst, src_type AS a, dst_type AS b, (-weight)::INT AS c FROM typed",
    "vector_functions": _with(_PS) + "SELECT src, sum(weight * weight)::DOUBLE AS dot, 3.0::DOUBLE * max(weight) AS axpy, -max(weight)::DOUBLE AS scale FROM ps GROUP BY 1",
    "map_functions": _with(_EVENT) + """, l AS (SELECT src, dst, weight FROM ev), r AS (SELECT src, dst, weight FROM ev WHERE weight % 2 = 0)
        SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT * FROM l UNION ALL SELECT * FROM r) WHERE src IN (SELECT src FROM l) AND src IN (SELECT src FROM r) GROUP BY 1, 2""",
}

for _name, _condition in (("id_union", "id % 3 = 0 OR id % 2 = 0"), ("id_intersection", "id % 6 = 0"), ("id_difference", "id % 3 = 0 AND id % 2 <> 0"), ("id_symmetric_difference", "(id % 3 = 0) <> (id % 2 = 0)")):
    ORACLE[_name] = _with(_PS) + f"SELECT id FROM {_ends('ps')} WHERE {_condition}"
ORACLE["top_edges_by_vertex"] = _with(_PS) + "SELECT src, dst, weight FROM ps QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2"

for _name, _rows in (
    ("neighbors_out", "SELECT DISTINCT src AS id, dst AS nbr FROM multi"),
    ("neighbors_in", "SELECT DISTINCT dst AS id, src AS nbr FROM multi"),
    ("neighbors_both", f"SELECT DISTINCT id, nbr FROM {_both('multi')}"),
):
    ORACLE[_name] = _with(_MULTI) + f"SELECT id, (row_number() OVER (PARTITION BY id ORDER BY nbr) - 1)::INT AS pos, nbr FROM ({_rows})"
ORACLE["neighbors_weighted"] = _with(_MULTI) + "SELECT src AS id, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS pos, dst AS nbr, min(weight) AS weight FROM multi GROUP BY src, dst"
ORACLE["neighbors_typed"] = _with(_TYPED) + """SELECT id, type::SMALLINT AS type, nbr_type::SMALLINT AS nbr_type, (row_number() OVER (PARTITION BY id, nbr_type ORDER BY nbr) - 1)::INT AS pos, nbr
    FROM (SELECT DISTINCT * FROM (SELECT src AS id, src_type AS type, dst AS nbr, dst_type AS nbr_type FROM typed UNION ALL SELECT dst, dst_type, src, src_type FROM typed))"""
ORACLE["neighbors_typed_weighted"] = _with(_TYPED) + """SELECT src AS id, src_type::SMALLINT AS type, dst_type::SMALLINT AS nbr_type, (row_number() OVER (PARTITION BY src, dst_type ORDER BY dst) - 1)::INT AS pos, dst AS nbr, min(weight) AS weight
    FROM typed GROUP BY src, src_type, dst_type, dst"""
ORACLE["neighbors_merge"] = _with(_PS) + "SELECT src AS id, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS pos, dst AS nbr FROM (SELECT DISTINCT src, dst FROM ps WHERE weight % 2 = 0 OR weight % 3 = 0)"

# partitioning: products wrap at 64 bits --------------------------------------------------------------------------


def _wrapped(column: str) -> str:
    big = f"({column}::HUGEINT * 1125899906842597 + 9223372036854775808::HUGEINT)"
    return f"abs((({big} % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)"


ORACLE["partition_1d"] = _with(_PS) + f"SELECT src, dst, ({_wrapped('src')} % 7)::INT AS pid FROM ps"
ORACLE["partition_2d"] = _with(_PS) + f"""SELECT src, dst, ({_wrapped('src')} % 3 * 3 + {_wrapped('dst')} % 3)::INT AS pid9,
    ({_wrapped('src')} % 7 // 3 * 3 + {_wrapped('dst')} % CASE WHEN {_wrapped('src')} % 7 // 3 < 2 THEN 3 ELSE 1 END)::INT AS pid7 FROM ps"""

_POSITION = "(row_number() OVER (PARTITION BY cluster ORDER BY other, src))::INT AS position"
ORACLE["sorted_positions_out"] = _with(_PS) + f"SELECT src, dst, cluster, {_POSITION} FROM (SELECT src, dst, src AS cluster, dst AS other FROM ps)"
ORACLE["sorted_positions_in"] = _with(_PS) + f"SELECT src, dst, cluster, {_POSITION} FROM (SELECT src, dst, dst AS cluster, src AS other FROM ps)"
ORACLE["sorted_positions_both"] = _with(_PS, f"d AS (SELECT id, count(*) AS n FROM {_both('ps')} GROUP BY 1)", "o AS (SELECT src, dst, (x.n < y.n OR x.n = y.n AND src < dst) AS first FROM ps JOIN d x ON x.id = src JOIN d y ON y.id = dst)") + f"SELECT src, dst, cluster, {_POSITION} FROM (SELECT src, dst, CASE WHEN first THEN src ELSE dst END AS cluster, CASE WHEN first THEN dst ELSE src END AS other FROM o)"

# iteration -------------------------------------------------------------------------------------------------------


def _pagerank(freeze: float) -> str:
    parts = [_PS, f"d AS MATERIALIZED (SELECT id, count(*)::DOUBLE AS n FROM {_both('ps')} GROUP BY 1)", f"b AS MATERIALIZED (SELECT id, nbr, 1.0::DOUBLE / n AS share FROM {_both('ps')} JOIN d USING (id))", "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM d)"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT r.id, CASE WHEN abs(0.85::DOUBLE * (msg - rank)) < {freeze} THEN rank ELSE 0.15::DOUBLE * rank + 0.85::DOUBLE * msg END AS rank
            FROM r{k - 1} r JOIN (SELECT nbr AS id, sum(rank * share) AS msg FROM b JOIN r{k - 1} USING (id) GROUP BY 1) m USING (id))""")
    return _with(*parts) + f"SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}"


ORACLE["pagerank_fixed"] = _pagerank(0.0)
ORACLE["pagerank_gated"] = _pagerank(0.001)


def _rounds(graph: str, table: str, start: str, edges: str, step: str, n: int, last: str) -> str:
    parts = [graph, f"v AS MATERIALIZED (SELECT id FROM {_ends(table)})", f"r0 AS (SELECT id, {start} AS x FROM v)"]
    for k in range(1, n + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT r.id, least(any_value(r.x), min({step})) AS x FROM r{k - 1} r LEFT JOIN {edges} e ON e.nbr = r.id LEFT JOIN r{k - 1} s ON s.id = e.id GROUP BY r.id)")
    return _with(*parts) + f"SELECT id, x AS {last} FROM r{n}"


ORACLE["pregel_min_label"] = _rounds(_TYPED, "typed", "id", _both("typed"), "s.x", 4, "label")
ORACLE["pregel_sssp"] = _rounds(_COP, "cop", "CASE WHEN id = 10 THEN 0.0::DOUBLE END", "(SELECT src AS id, dst AS nbr FROM cop)", "s.x + 1", 20, "distance")
# seven steps lead from any vertex of the tree of regions, nations, customers, suppliers and orders to any other of its component
ORACLE["connected_components"] = _rounds(_TYPED, "typed", "id", _both("typed"), "s.x", 8, "component")
_TRI = "tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM cop x JOIN cop y ON x.dst = y.src JOIN cop z ON z.src = x.src AND z.dst = y.dst)"
ORACLE["triangle_count"] = _with(_COP, _TRI) + "SELECT count(*) AS triangles FROM tri"
ORACLE["triangle_per_vertex"] = _with(_COP, _TRI) + f"SELECT id, count(t) AS triangles FROM {_ends('cop')} LEFT JOIN (SELECT unnest([a, b, c]) AS t FROM tri) ON t = id GROUP BY 1"


def _walk(graph: str, table: str, neighbors: str, name: str, choose, walks: int = 1, length: int = WALK_LENGTH) -> str:
    """``choose(k, u)``: SQL of (start, walk, nxt) from step w{k-1} (start, walk, cur, prev)."""
    parts = [graph, neighbors, f"w0 AS (SELECT id AS start, k AS walk, id::VARCHAR AS path, id AS cur, NULL::BIGINT AS prev FROM {_ends(table)}, range({walks}) g(k))"]
    for k in range(1, length):
        u = _u(f"'{SEED}'", f"'{name}'", "w.start", "w.walk", f"'{k}'")
        parts.append(f"s{k} AS MATERIALIZED ({choose(k, u)})")
        parts.append(f"""w{k} AS MATERIALIZED (SELECT w.start, w.walk, CASE WHEN nxt IS NULL THEN path ELSE path || ' ' || nxt END AS path, nxt AS cur, cur AS prev
            FROM w{k - 1} w LEFT JOIN s{k} s ON s.start = w.start AND s.walk = w.walk)""")
    return _with(*parts) + f"SELECT start, walk::INT AS walk, path FROM w{length - 1}"


def _indexed(rows: str, more: str = "") -> str:
    by = f"id{more}"
    return f"n AS MATERIALIZED (SELECT id{more}, nbr, row_number() OVER (PARTITION BY {by} ORDER BY nbr) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows}))"


def _uniform_step(k: int, u: str) -> str:
    return f"SELECT w.start, w.walk, n.nbr AS nxt FROM w{k - 1} w JOIN n ON n.id = w.cur AND n.k = floor({u} * n.n)"


def _metapath_step(k: int, u: str) -> str:
    return f"SELECT w.start, w.walk, n.nbr AS nxt FROM w{k - 1} w JOIN n ON n.id = w.cur AND n.t = {(0, 4)[k % 2]} AND n.k = floor({u} * n.n)"


def _weighted_step(k: int, u: str) -> str:
    return f"SELECT w.start, w.walk, n.nbr AS nxt FROM w{k - 1} w JOIN n ON n.id = w.cur AND n.cum > {u} * n.total AND n.cum - n.weight <= {u} * n.total"


def _node2vec_step(k: int, _: str) -> str:
    weight = lambda w: f"CASE WHEN {w}.prev IS NULL THEN 2.0 WHEN n.nbr = {w}.prev THEN 2.0 WHEN m.id IS NOT NULL THEN 1.0 ELSE 1.25 END::DOUBLE"
    draw = lambda name: _u(f"'{SEED}'", f"'{name}'", "w.start", "w.walk", f"'{k}'", "t.try")
    near = lambda w: f"LEFT JOIN n m ON m.id = {w}.prev AND m.nbr = n.nbr"
    return f"""WITH p AS MATERIALIZED (SELECT start, walk, cur, prev, arg_min(nbr, try) FILTER (WHERE good) AS nbr FROM (
          SELECT w.start, w.walk, w.cur, w.prev, t.try, n.nbr, {draw("accept")} * 2.0::DOUBLE < {weight("w")} AS good FROM w{k - 1} w JOIN range(6) t(try) ON w.prev IS NOT NULL OR t.try = 0
          JOIN n ON n.id = w.cur AND n.k = floor({draw("node2vec")} * n.n) {near("w")}) GROUP BY 1, 2, 3, 4)
        SELECT start, walk, nbr AS nxt FROM p WHERE nbr IS NOT NULL UNION ALL
        SELECT start, walk, nbr FROM (SELECT *, sum(x) OVER (PARTITION BY start, walk ORDER BY nbr) AS cum, u * sum(x) OVER (PARTITION BY start, walk) AS goal
          FROM (SELECT w.start, w.walk, n.nbr, {weight("w")} AS x, {_u(f"'{SEED}'", "'node2vec'", "w.start", "w.walk", f"'{k}'")} AS u FROM p w JOIN n ON n.id = w.cur {near("w")} WHERE w.nbr IS NULL)) WHERE cum > goal AND cum - x <= goal"""


_PS_NEIGHBORS = _indexed(f"SELECT DISTINCT id, nbr FROM {_both('ps')}")
ORACLE["deepwalk"] = _walk(_PS, "ps", _PS_NEIGHBORS, "walk", _uniform_step, 2)
ORACLE["deepwalk_weighted"] = _walk(_EVENT, "ev", f"n AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY id ORDER BY nbr) AS cum, sum(weight) OVER (PARTITION BY id) AS total FROM {_both('ev', ', weight')})", "walk", _weighted_step)
ORACLE["node2vec"] = _walk(_TYPED, "typed", _indexed(f"SELECT DISTINCT id, nbr FROM {_both('typed')}"), "node2vec", _node2vec_step)
ORACLE["metapath_walk"] = _walk(_TYPED, "typed", _indexed("SELECT DISTINCT * FROM (SELECT src AS id, dst_type AS t, dst AS nbr FROM typed UNION ALL SELECT dst, src_type, src FROM typed)", ", t"), "metapath", _metapath_step)
ORACLE["walk_text_sink"] = _walk(_PS, "ps", _PS_NEIGHBORS, "walk", _uniform_step, 1, 3).replace("SELECT start, walk::INT AS walk, path FROM", "SELECT path AS line FROM")

ORACLE["neighbor_mean_sampled"] = _with(_PS, f"n AS (SELECT DISTINCT id, nbr FROM {_both('ps')})", f"k AS (SELECT id, nbr FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_u(f"'{SEED}'", "'k'", 'id', 'nbr')}, nbr) <= 4)") + "SELECT id, round(avg(nbr % 100), 6) AS mean FROM k GROUP BY 1"


def _svd(last: str) -> str:
    r = range(SVD.rank)
    cols = lambda f: ", ".join(f(k) for k in r)
    f0 = f"""f0 AS MATERIALIZED (SELECT id, {', '.join(f"{_u(f"'{SVD.seed}'", f"'v{v}'", 'id', f"'{k}'")} AS v{v}_{k}" for v in (1, 2) for k in r)},
        avg(rating) - (SELECT mean FROM mu) AS v3, 1 / sqrt(count(*)) AS v4 FROM {_both('rate', ', rating')} GROUP BY 1)"""
    parts = [_RATE, "mu AS MATERIALIZED (SELECT avg(rating) AS mean FROM rate)", f0]
    for i in range(1, SVD.max_iterations + 1):
        parts.append(f"y{i} AS MATERIALIZED (SELECT src AS id, {cols(lambda k: f'sum(v2_{k}) AS s{k}')} FROM rate JOIN f{i - 1} ON id = dst GROUP BY 1)")
        parts.append(f"z{i} AS MATERIALIZED (SELECT f.id, {cols(lambda k: f'v1_{k}')}, {cols(lambda k: f'CASE WHEN s{k} IS NULL THEN v2_{k} ELSE v1_{k} + v4 * s{k} END AS v2_{k}')}, v3, v4 FROM f{i - 1} f LEFT JOIN y{i} USING (id))")
        dot = " + ".join(f"i.v1_{k} * u.v2_{k}" for k in r)
        parts.append(f"""e{i} AS MATERIALIZED (SELECT src, dst, {cols(lambda k: f'u.v1_{k} AS p{k}, u.v2_{k} AS z{k}, i.v1_{k} AS q{k}, i.v2_{k} AS y{k}')}, u.v3 AS bu, i.v3 AS bi, u.v4 AS nu,
            rating - least(greatest((SELECT mean FROM mu) + u.v3 + i.v3 + {dot}, {SVD.min_value}), {SVD.max_value}) AS err FROM rate JOIN z{i} u ON u.id = src JOIN z{i} i ON i.id = dst)""")
        dy = cols(lambda k: f"{SVD.gamma2} * (err * nu * q{k} - {SVD.gamma7} * y{k}) AS y{k}")
        parts.append(f"""m{i} AS MATERIALIZED (SELECT id, {cols(lambda k: f'sum(x{k}) AS x{k}, sum(y{k}) AS y{k}')}, sum(b) AS b FROM (
            SELECT src AS id, {cols(lambda k: f'{SVD.gamma2} * (err * q{k} - {SVD.gamma7} * p{k}) AS x{k}')}, {dy}, {SVD.gamma1} * (err - {SVD.gamma6} * bu) AS b FROM e{i} UNION ALL
            SELECT dst, {cols(lambda k: f'{SVD.gamma2} * (err * z{k} - {SVD.gamma7} * q{k})')}, {dy}, {SVD.gamma1} * (err - {SVD.gamma6} * bi) FROM e{i}) GROUP BY 1)""")
        parts.append(f"f{i} AS MATERIALIZED (SELECT z.id, {cols(lambda k: f'v1_{k} + x{k} AS v1_{k}, v2_{k} + y{k} AS v2_{k}')}, v3 + b AS v3, v4 FROM z{i} z JOIN m{i} USING (id))")
    return _with(*parts) + last


_N = SVD.max_iterations
ORACLE["svdpp_factors"] = _svd(" UNION ALL ".join(f"SELECT id, {k} AS k, round(v1_{k}, 6) AS v1, round(v2_{k}, 6) AS v2, round(v3, 6) AS v3 FROM f{_N}" for k in range(SVD.rank)))
ORACLE["svdpp_error"] = _svd(f"SELECT dst AS id, round(sum(err * err), 6) AS error FROM e{_N} GROUP BY 1")
