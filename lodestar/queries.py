"""Queries over the ``embeddings`` table, one or more for each operator, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import IndexConfig
from .operators import centroid, connect, evaluate, knn, nndescent, nsg, redistribute, search
from .plans import pipeline
from .plans.scratch import cut, scratch_folder
from .sources import graph_file, vecs

Query = Callable[[SparkSession, str], DataFrame]

K, SPARSE_K, CANDIDATES, DEGREE, RANDOM, WORKERS = 10, 3, 40, 10, 10, 4
POOL, PATH_POOL, SEEDS = 40, 20, 20


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.vectors_of(_embeddings(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, worker): the label stands for the worker that holds a vector."""
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("worker"))


def _knn(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return knn.exact_knn(v, v, k)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def scan_vectors(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def knn_exact(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir), "dist")


def knn_adjacency(spark, sf_dir):
    graph = knn.adjacency(_knn(spark, sf_dir))
    return graph.select("id", F.posexplode("neighbors").alias("pos", "dst")).select("id", F.col("pos").cast("long").alias("pos"), "dst")


def reverse_neighbors(spark, sf_dir):
    return nndescent.reverse_edges(_knn(spark, sf_dir)).select("src", "dst")


def capped_reverse(spark, sf_dir):
    return nndescent.capped_reverse(_knn(spark, sf_dir), 5).select("src", "rank", "dst")


def forward_reverse_union(spark, sf_dir):
    return nndescent.forward_and_reverse(_knn(spark, sf_dir), 5)


def local_join_pairs(spark, sf_dir):
    return nndescent.local_join_pairs(_knn(spark, sf_dir).select("src", "dst"))


def random_graph(spark, sf_dir):
    return knn.edges(nndescent.random_graph(_vectors(spark, sf_dir), RANDOM))


def initial_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(nndescent.initial_knn(v, K, RANDOM, table=knn.vector_table(v)), "dist")


def _round(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The first lists and one round, as ``nn_descent`` runs them: by the table of vectors, candidates that can't enter left out."""
    v = cut(_vectors(spark, sf_dir), "vectors")
    table = knn.vector_table(v)
    first = cut(nndescent.initial_knn(v, K, RANDOM, table=table).withColumn("is_new", F.lit(True)), "first")
    return first, cut(nndescent.descent_round(first, v, K, 100, table=table), "round")


def nnd_round(spark, sf_dir):
    return _rounded(_round(spark, sf_dir)[1], "dist")


def nnd_updates(spark, sf_dir):
    return _round(spark, sf_dir)[1].groupBy("src").agg(F.count_if("is_new").alias("updates"))


def avg_graph_dist(spark, sf_dir):
    return _rounded(knn.average_distance(_knn(spark, sf_dir)), "avg_dist")


def centroid_by_dim(spark, sf_dir):
    return _rounded(centroid.centroid_by_dimension(_vectors(spark, sf_dir)), "value")


def midpoint_by_label(spark, sf_dir):
    v = _vectors(spark, sf_dir).join(_labels(spark, sf_dir), "id")
    return _rounded(centroid.centroid_by_dimension(v, "worker"), "value")


def distance_to_centroid(spark, sf_dir):
    return _rounded(centroid.distance_to_centroid(_vectors(spark, sf_dir)), "dist")


def navigating_node(spark, sf_dir):
    return _rounded(centroid.navigating_node(_vectors(spark, sf_dir)), "dist")


def route_to_midpoint(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    midpoints = centroid.centroid(v.join(_labels(spark, sf_dir), "id"), "worker")
    return _rounded(centroid.route(v.withColumnRenamed("id", "qid"), midpoints), "dist")


def _nsg(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """Vectors, the navigable graph pruned from exact candidates, and the navigating node."""
    v = cut(_vectors(spark, sf_dir), "vectors")
    chosen = nsg.select_edges(knn.exact_knn(v, v, CANDIDATES), v, DEGREE, CANDIDATES)
    return v, cut(nsg.navigable_graph(chosen, v), "nsg"), centroid.navigating_node(v).head().id


def occlusion_edges(spark, sf_dir):
    v, graph, _ = _nsg(spark, sf_dir)
    return knn.edges(graph)


def occlusion_degrees(spark, sf_dir):
    v, graph, _ = _nsg(spark, sf_dir)
    return nsg.degrees(knn.edges(graph), v)


def _tree(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, graph, nav = _nsg(spark, sf_dir)
    return v, graph, connect.spanning_tree(knn.edges(graph), nav)


def bfs_tree(spark, sf_dir):
    return _tree(spark, sf_dir)[2]


def unreached_nodes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    tree = connect.spanning_tree(_knn(spark, sf_dir, SPARSE_K).select("src", "dst"), centroid.navigating_node(v).head().id)
    return connect.unreached(v, tree)


def subtree_sizes(spark, sf_dir):
    return redistribute.subtree_sizes(_tree(spark, sf_dir)[2])


def tree_leaves(spark, sf_dir):
    return redistribute.tree_leaves(_tree(spark, sf_dir)[2])


def ancestor_pairs(spark, sf_dir):
    return redistribute.ancestors(_tree(spark, sf_dir)[2])


def parent_replicas(spark, sf_dir):
    return redistribute.parent_replicas(_tree(spark, sf_dir)[2], _labels(spark, sf_dir))


def shared_replicas(spark, sf_dir):
    placed = _labels(spark, sf_dir)
    return redistribute.shared_replicas(redistribute.parent_replicas(_tree(spark, sf_dir)[2], placed), placed, 10)


def replica_counts(spark, sf_dir):
    return redistribute.replica_counts(parent_replicas(spark, sf_dir))


def range_partition_plan(spark, sf_dir):
    parts = redistribute.range_partitions(_embeddings(spark, sf_dir).count(), WORKERS)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(parts)], "part long, lo long, hi long")


def load_bounds(spark, sf_dir):
    least, most = redistribute.load_bounds(_embeddings(spark, sf_dir).count(), WORKERS)
    return spark.createDataFrame([(least, most)], "least long, most long")


def worker_loads(spark, sf_dir):
    return redistribute.expected_counts(_labels(spark, sf_dir))


def owner_ids(spark, sf_dir):
    return redistribute.owner_ids(_labels(spark, sf_dir))


def range_workers(spark, sf_dir):
    """Placement by ranks of ids that have gaps (those that aren't queries)."""
    return redistribute.by_ranges(_vectors(spark, sf_dir).filter(F.col("id") % 50 != 0), WORKERS)


def partial_graph(spark, sf_dir):
    """Edges of the nodes of one worker."""
    mine = _labels(spark, sf_dir).filter("worker = 3")
    return knn.edges(redistribute.partial_graph(knn.adjacency(_knn(spark, sf_dir)), mine))


def redistributed_edges(spark, sf_dir):
    """Edges held by each worker after moving adjacency to the owners of its nodes."""
    placed = _labels(spark, sf_dir)
    graph = knn.adjacency(_knn(spark, sf_dir))
    moved = redistribute.redistribute(graph, placed, placed.filter("false"))
    return moved.groupBy("worker").agg(F.count("*").alias("nodes"), F.sum(F.size("neighbors")).alias("edges"))


def partition_plan(spark, sf_dir):
    v, _, tree = _tree(spark, sf_dir)
    return redistribute.assignment(tree, WORKERS)


def _search_queries(v: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vec")


def beam_full_pool(spark, sf_dir):
    v, graph, nav = _nsg(spark, sf_dir)
    q = _search_queries(v)
    return _rounded(search.beam_search(q, graph, v, search.seeds_at(q, nav), v.count()), "dist")


def beam_search_pool(spark, sf_dir):
    v, graph, nav = _nsg(spark, sf_dir)
    q = _search_queries(v)
    return _rounded(search.beam_search(q, graph, v, search.seeds_at(q, nav), POOL), "dist")


def beam_random_start(spark, sf_dir):
    v, graph, _ = _nsg(spark, sf_dir)
    q = _search_queries(v)
    return _rounded(search.beam_search(q, graph, v, search.random_seeds(q, v, SEEDS), POOL), "dist")


def path_search(spark, sf_dir):
    v, graph, nav = _nsg(spark, sf_dir)
    q = v.select(F.col("id").alias("qid"), "vec")
    return _rounded(search.beam_search(q, graph, v, search.seeds_at(q, nav), PATH_POOL, path=True), "dist")


def recall_metrics(spark, sf_dir):
    found = _round(spark, sf_dir)[1].select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    truth = _knn(spark, sf_dir).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    return _rounded(evaluate.recall_metrics(found, truth, K), "precision", "recall")


def fvecs_round_trip(spark, sf_dir):
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}.fvecs"
    vecs.write_fvecs(_vectors(spark, sf_dir), path)
    return vecs.read_fvecs(spark, path).select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("value"))


def ivecs_truth(spark, sf_dir):
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}.ivecs"
    graph = knn.adjacency(_knn(spark, sf_dir))
    vecs.write_ivecs(graph.select("id", F.col("neighbors").cast("array<int>").alias("values")), path)
    return vecs.read_truth(spark, path)


def graph_file_round_trip(spark, sf_dir):
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}.graph"
    graph_file.write_graph(knn.adjacency(_knn(spark, sf_dir)), path, 0)
    return knn.edges(graph_file.read_graph(spark, path)[0])


def _config(k: int = 20) -> IndexConfig:
    return IndexConfig(k=k, candidate_queue_size_nsg=40, candidate_queue_size_knng=40, candidate_queue_increase_by=10, candidate_queue_increases=3, workers=WORKERS)


def nn_descent_graph(spark, sf_dir):
    return pipeline.build_aknng(_vectors(spark, sf_dir), _config())[0]


def index_search_recall(spark, sf_dir):
    """Recall sweep of the whole pipeline: queries are held out of the index."""
    v = _vectors(spark, sf_dir)
    q = _search_queries(v)
    base = v.filter(F.col("id") % 50 != 0)
    index = pipeline.build_index(base, _config())
    truth = knn.exact_knn(q.withColumnRenamed("qid", "id"), base, K).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    return pipeline.sweep(index, q, truth, _config())


def connect_repair(spark, sf_dir):
    """The tree after repair of a navigable graph with few edges; every vector is in it."""
    v = cut(_vectors(spark, sf_dir), "vectors")
    chosen = nsg.select_edges(knn.exact_knn(v, v, CANDIDATES), v, 4, CANDIDATES)
    graph = cut(nsg.navigable_graph(chosen, v), "nsg")
    return connect.repair(graph, v, centroid.navigating_node(v).head().id, 40)[1]


NAMES = [
    scan_vectors, knn_exact, knn_adjacency, reverse_neighbors, capped_reverse, forward_reverse_union, local_join_pairs, random_graph, initial_knn, nnd_round, nnd_updates,
    avg_graph_dist, centroid_by_dim, midpoint_by_label, distance_to_centroid, navigating_node, route_to_midpoint, occlusion_edges, occlusion_degrees, bfs_tree, unreached_nodes,
    subtree_sizes, tree_leaves, ancestor_pairs, parent_replicas, shared_replicas, replica_counts, range_partition_plan, load_bounds, worker_loads, owner_ids, range_workers, partial_graph, redistributed_edges, partition_plan,
    beam_full_pool, beam_search_pool, beam_random_start, path_search, recall_metrics, fvecs_round_trip, ivecs_truth, graph_file_round_trip, nn_descent_graph, index_search_recall, connect_repair,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}


# SQL. Each piece is a list of common table expressions that later ones build on.
_PAIRS = "pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
_RANKED = "ranked AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dst, dist FROM pairs)"
_KNN = f"{_PAIRS}, {_RANKED}, knn AS (SELECT * FROM ranked WHERE rank <= {K})"
_REVERSE = "turned AS (SELECT dst AS src, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS rank, src AS dst FROM knn)"
_MEAN = "mean AS (SELECT list(value ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS value FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))"
_NAV = f"{_MEAN}, tocenter AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], m) AS dist FROM embeddings, mean), nav AS (SELECT id, dist FROM tocenter ORDER BY dist, id LIMIT 1)"


def _drawn(i: str, slot: str, n: str) -> str:
    """The arithmetic of ``seeded_id`` with seed 42."""
    p = 2147483647
    first = f"((({i}) * 7919 + {slot} * 104729 + {42 * 1299709 % p} + (({i}) * {slot}) % {p} * 31 + (({i}) * ({i})) % {p} * 17) % {p})"
    second = f"(({first} * {first} + {first} * 48271) % {p})"
    return f"(({second} * {second} + {second} * 16807 + {slot}) % {p} % {n})"


_N = "n AS (SELECT count(*)::BIGINT AS n FROM embeddings)"
_RANDOM = (
    f"{_N}, draws AS (SELECT e.vec_id AS src, s.slot, {_drawn('e.vec_id', 's.slot', 'n.n')} AS dst FROM embeddings e, (SELECT unnest(range(1, {2 * RANDOM + 11})) AS slot) s, n), "
    f"firsts AS (SELECT src, dst, min(slot) AS slot FROM draws WHERE src <> dst GROUP BY src, dst), rnd AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY slot, dst) AS r FROM firsts) WHERE r <= {RANDOM})"
)
_FIRST = f"{_RANDOM}, {_PAIRS}, first AS (SELECT * FROM (SELECT p.src, row_number() OVER (PARTITION BY p.src ORDER BY p.dist, p.dst) AS rank, p.dst, p.dist FROM rnd JOIN pairs p USING (src, dst)) WHERE rank <= {K})"
_ROUND = (
    f"{_FIRST}, around AS (SELECT src, dst FROM first UNION SELECT dst, src FROM first), met AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM around x JOIN around y ON x.src = y.src AND x.dst <> y.dst), "
    f"merged AS (SELECT src, dst, dist, true AS was FROM first UNION ALL SELECT p.src, p.dst, p.dist, false FROM met JOIN pairs p ON p.src = met.a AND p.dst = met.b), "
    f"best AS (SELECT src, dst, min(dist) AS dist, bool_or(was) AS was FROM merged GROUP BY src, dst), "
    f"round1 AS (SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dst, dist, NOT was AS is_new FROM best) WHERE rank <= {K})"
)
_PRUNE = (
    f"{_PAIRS}, {_RANKED}, cand AS (SELECT r.src, r.rank, r.dst, r.dist, e.embedding::DOUBLE[] AS vec FROM ranked r JOIN embeddings e ON e.vec_id = r.dst WHERE r.rank <= {CANDIDATES}), "
    f"scan(src, rank, acc) AS (SELECT src, rank, [{{'dst': dst, 'vec': vec}}] FROM cand WHERE rank = 1 UNION ALL SELECT c.src, c.rank, CASE WHEN len(s.acc) >= {DEGREE} OR len(list_filter(s.acc, lambda t: c.dist >= list_distance(c.vec, t.vec))) > 0 THEN s.acc "
    f"ELSE list_append(s.acc, {{'dst': c.dst, 'vec': c.vec}}) END FROM scan s JOIN cand c ON c.src = s.src AND c.rank = s.rank + 1), "
    f"full_scan AS (SELECT src, acc FROM scan WHERE rank = (SELECT max(rank) FROM cand)), edges AS (SELECT t.dst AS src, src AS dst FROM (SELECT src, unnest(acc) AS t FROM full_scan))"
)


def _bfs(edges: str) -> str:
    return (
        f"walk(id, depth) AS (SELECT id, 0 FROM nav UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.id WHERE w.depth < 64), level AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), "
        f"tree AS (SELECT l.id AS child, coalesce((SELECT min(e.src) FROM {edges} e JOIN level p ON p.id = e.src WHERE e.dst = l.id AND p.depth = l.depth - 1), l.id) AS parent, l.depth::BIGINT AS depth FROM level l)"
    )


_TREE = f"{_NAV}, {_PRUNE}, {_bfs('edges')}"
_ANCESTORS = "up(id, ancestor) AS (SELECT child, parent FROM tree WHERE child <> parent UNION ALL SELECT u.id, t.parent FROM up u JOIN tree t ON t.child = u.ancestor WHERE t.child <> t.parent)"
_REPLICAS = "held AS (SELECT DISTINCT u.ancestor AS id, e.label AS worker FROM up u JOIN embeddings e ON e.vec_id = u.id WHERE u.ancestor NOT IN (SELECT child FROM tree WHERE child = parent)), replica AS (SELECT h.id, h.worker FROM held h JOIN embeddings e ON e.vec_id = h.id WHERE e.label <> h.worker)"


def _beam(queries: str, seeds: str, pool: int) -> str:
    """All open members of a query's pool are expanded in a round; the last state of each query is its result."""
    measured = "list_distance(q.embedding::DOUBLE[], x.embedding::DOUBLE[])"
    return (
        f"query AS (SELECT * FROM embeddings q WHERE {queries}), seeds AS ({seeds}), "
        f"start AS (SELECT q.vec_id AS qid, list_sort(list(DISTINCT {{'dist': {measured}, 'id': x.vec_id, 'open': true}})) AS pool FROM query q JOIN seeds s ON s.qid = q.vec_id JOIN embeddings x ON x.vec_id = s.id GROUP BY q.vec_id), "
        f"beam(qid, r, pool, met, gone) AS (SELECT qid, 0, pool[1:{pool}], list_transform(pool, lambda t: t.id), pool[1:0] FROM start UNION ALL "
        f"SELECT qid, r + 1, merged[1:{pool}], list_concat(met, list_transform(fresh, lambda t: t.id)), list_concat(gone, list_filter(merged[{pool + 1}:], lambda t: NOT t.open)) FROM ("
        f"SELECT qid, r, met, gone, fresh, list_sort(list_concat(list_transform(pool, lambda t: {{'dist': t.dist, 'id': t.id, 'open': false}}), fresh)) AS merged FROM ("
        f"SELECT b.qid, any_value(b.r) AS r, any_value(b.pool) AS pool, any_value(b.met) AS met, any_value(b.gone) AS gone, list(DISTINCT {{'dist': {measured}, 'id': x.vec_id, 'open': true}}) AS fresh "
        f"FROM (SELECT qid, r, pool, met, gone, unnest(list_filter(pool, lambda t: t.open)) AS o FROM beam) b JOIN edges e ON e.src = b.o.id AND NOT list_contains(b.met, e.dst) JOIN query q ON q.vec_id = b.qid JOIN embeddings x ON x.vec_id = e.dst GROUP BY b.qid))), "
        f"ended AS (SELECT qid, arg_max(pool, r) AS pool, arg_max(gone, r) AS gone FROM beam GROUP BY qid)"
    )


def _found(lists: str) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY t.dist, t.id) AS rank, t.id AS id, round(t.dist, 6) AS dist FROM (SELECT qid, unnest({lists}) AS t FROM ended)"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def oracle_sql() -> dict[str, str]:
    mids = "mids AS (SELECT label, list(value ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"
    return {
        "scan_vectors": "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings",
        "knn_exact": _with(_KNN, "SELECT src, rank, dst, round(dist, 6) AS dist FROM knn"),
        "knn_adjacency": _with(_KNN, "SELECT src AS id, rank - 1 AS pos, dst FROM knn"),
        "reverse_neighbors": _with(_KNN, "SELECT dst AS src, src AS dst FROM knn"),
        "capped_reverse": _with(f"{_KNN}, {_REVERSE}", "SELECT src, rank, dst FROM turned WHERE rank <= 5"),
        "forward_reverse_union": _with(f"{_KNN}, {_REVERSE}", "SELECT src, dst FROM knn UNION SELECT src, dst FROM turned WHERE rank <= 5"),
        "local_join_pairs": _with(_KNN, "SELECT DISTINCT x.dst AS a, y.dst AS b FROM knn x JOIN knn y ON x.src = y.src AND x.dst < y.dst"),
        "random_graph": _with(_RANDOM, "SELECT src, dst FROM rnd"),
        "initial_knn": _with(_FIRST, "SELECT src, rank, dst, round(dist, 6) AS dist FROM first"),
        "nnd_round": _with(_ROUND, "SELECT src, rank, dst, round(dist, 6) AS dist, is_new FROM round1"),
        "nnd_updates": _with(_ROUND, "SELECT src, count(*) FILTER (is_new) AS updates FROM round1 GROUP BY src"),
        "avg_graph_dist": _with(_KNN, "SELECT round(avg(dist), 6) AS avg_dist FROM knn"),
        "centroid_by_dim": "SELECT pos - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos",
        "midpoint_by_label": "SELECT label AS worker, pos - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos",
        "distance_to_centroid": _with(_NAV, "SELECT id, round(dist, 6) AS dist FROM tocenter"),
        "navigating_node": _with(_NAV, "SELECT id, round(dist, 6) AS dist FROM nav"),
        "route_to_midpoint": _with(mids, "SELECT qid, worker, round(dist, 6) AS dist FROM (SELECT e.vec_id AS qid, m.label AS worker, list_distance(e.embedding::DOUBLE[], m.m) AS dist, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], m.m), m.label) AS r FROM embeddings e, mids m) WHERE r = 1"),
        "occlusion_edges": _with(_PRUNE, "SELECT src, dst FROM edges"),
        "occlusion_degrees": _with(_PRUNE, "SELECT vec_id AS id, (SELECT count(*) FROM edges WHERE src = vec_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = vec_id) AS in_degree FROM embeddings"),
        "bfs_tree": _with(_TREE, "SELECT child, parent, depth FROM tree"),
        "unreached_nodes": _with(f"{_NAV}, {_PAIRS}, {_RANKED}, few AS (SELECT src, dst FROM ranked WHERE rank <= {SPARSE_K}), walk(id) AS (SELECT id FROM nav UNION SELECT e.dst FROM walk w JOIN few e ON e.src = w.id)", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM walk)"),
        "subtree_sizes": _with(f"{_TREE}, {_ANCESTORS}", "SELECT t.child AS id, 1 + count(u.id) AS size FROM tree t LEFT JOIN up u ON u.ancestor = t.child GROUP BY t.child"),
        "tree_leaves": _with(_TREE, "SELECT child AS id FROM tree WHERE child NOT IN (SELECT parent FROM tree WHERE child <> parent)"),
        "ancestor_pairs": _with(f"{_TREE}, {_ANCESTORS}", "SELECT id, ancestor FROM up WHERE ancestor NOT IN (SELECT child FROM tree WHERE child = parent)"),
        "parent_replicas": _with(f"{_TREE}, {_ANCESTORS}, {_REPLICAS}", "SELECT id, worker FROM replica"),
        "shared_replicas": _with(f"{_TREE}, {_ANCESTORS}, {_REPLICAS}", "SELECT r.id, w.worker::INT AS worker FROM (SELECT DISTINCT id FROM replica) r, (SELECT unnest(range(0, 10)) AS worker) w JOIN embeddings e ON true WHERE e.vec_id = r.id AND e.label <> w.worker"),
        "replica_counts": _with(f"{_TREE}, {_ANCESTORS}, {_REPLICAS}", "SELECT count(DISTINCT id) AS nodes, count(*) AS replicas FROM replica"),
        "range_partition_plan": f"SELECT i AS part, least(i * s, n) AS lo, least((i + 1) * s, n) AS hi FROM (SELECT unnest(range(0, {WORKERS})) AS i), (SELECT count(*) AS n, (count(*) + {WORKERS - 1}) // {WORKERS} AS s FROM embeddings)",
        "load_bounds": f"SELECT n // {WORKERS} - n // {100 * (WORKERS - 1)} AS least, n // {WORKERS} + n // {100 * (WORKERS - 1)} AS most FROM (SELECT count(*) AS n FROM embeddings)",
        "worker_loads": "SELECT label AS worker, count(*) AS nodes, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label",
        "redistributed_edges": _with(_KNN, "SELECT e.label AS worker, count(DISTINCT k.src) AS nodes, count(*) AS edges FROM knn k JOIN embeddings e ON e.vec_id = k.src GROUP BY e.label"),
        "beam_full_pool": _with(f"{_NAV}, {_PRUNE}, {_bfs('edges')}", "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, round(dist, 6) AS dist FROM (SELECT q.vec_id AS qid, l.id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist FROM embeddings q, level l JOIN embeddings e ON e.vec_id = l.id WHERE q.vec_id % 50 = 0)"),
        "beam_search_pool": _with(f"{_NAV}, {_PRUNE}, {_beam('q.vec_id % 50 = 0', 'SELECT q.vec_id AS qid, nav.id FROM embeddings q, nav', POOL)}", _found("pool")),
        "beam_random_start": _with(f"{_N}, {_PRUNE}, {_beam('q.vec_id % 50 = 0', f'SELECT q.vec_id AS qid, ' + _drawn('q.vec_id', 's.slot', 'n.n') + f' AS id FROM embeddings q, n, (SELECT unnest(range(1, {SEEDS + 1})) AS slot) s', POOL)}", _found("pool")),
        "path_search": _with(f"{_NAV}, {_PRUNE}, {_beam('true', 'SELECT q.vec_id AS qid, nav.id FROM embeddings q, nav', PATH_POOL)}", _found("list_concat(pool, gone)")),
        "owner_ids": "SELECT label AS worker, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id AS id FROM embeddings",
        "range_workers": f"SELECT id, (place // ((n + {WORKERS - 1}) // {WORKERS}))::INT AS worker FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings WHERE vec_id % 50 <> 0)",
        "partial_graph": _with(_KNN, "SELECT k.src, k.dst FROM knn k JOIN embeddings e ON e.vec_id = k.src WHERE e.label = 3"),
        "recall_metrics": _with(f"{_ROUND}, truth AS (SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dst FROM pairs) WHERE rank <= {K})", f"SELECT count(DISTINCT t.src) AS queries, count(*) FILTER (t.rank = 1 AND r.rank = 1)::BIGINT AS first_hits, count(r.rank)::BIGINT AS correct, round(count(r.rank) / (count(DISTINCT t.src) * {K}), 6) AS precision, round(count(r.rank) / (count(DISTINCT t.src) * {K}), 6) AS recall FROM truth t LEFT JOIN round1 r ON r.src = t.src AND r.dst = t.dst"),
        "fvecs_round_trip": "SELECT id, pos - 1 AS pos, round(x, 6) AS value FROM (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)",
        "ivecs_truth": _with(_KNN, "SELECT src AS qid, rank, dst AS id FROM knn"),
        "graph_file_round_trip": _with(_KNN, "SELECT src, dst FROM knn"),
    }
