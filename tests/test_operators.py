"""Hand-made fixtures: known orders, duplicates, islands, ties, tiny sets, chains."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import IndexConfig
from lodestar.functions.vectors import l2, nearest
from lodestar.operators import centroid, connect, evaluate, knn, nndescent, nsg, redistribute, search
from lodestar.plans import pipeline, scratch
from lodestar.plans.scratch import cut, drop_scratch
from lodestar.sources import graph_file, vecs
from lodestar.streaming.search_stream import search_stream


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vec array<float>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    return frame(spark, list(enumerate(rng.normal(size=(300, 8)).astype(np.float32))))


def test_line(spark):
    v = frame(spark, [(0, [0]), (1, [1]), (2, [2]), (3, [4]), (4, [8])])
    rows = {(r.src, r["rank"]): (r.dst, r.dist) for r in knn.exact_knn(v, v, 2).collect()}
    assert rows[0, 1] == (1, 1.0) and rows[0, 2] == (2, 2.0)
    assert rows[1, 1] == (0, 1.0) and rows[1, 2] == (2, 1.0)  # tie by id
    assert rows[4, 1] == (3, 4.0) and rows[4, 2] == (2, 6.0)
    chosen = nsg.select_edges(knn.exact_knn(v, v, 4), v, 10, 10)
    assert sorted((r.src, r.dst) for r in chosen.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]


def test_duplicates_keep_each_other_and_drop_self(spark):
    v = frame(spark, [(1, [0, 0]), (2, [0, 0]), (3, [5, 5]), (4, [6, 6])])
    rows = knn.exact_knn(v, v, 3).collect()
    assert all(r.src != r.dst for r in rows) and len(rows) == 12
    assert next(r for r in rows if r.src == 2 and r["rank"] == 1).dst == 1


def test_blocks_give_the_same_neighbours(cloud):
    one = {tuple(r) for r in knn.exact_knn(cloud, cloud, 5).select("src", "rank", "dst").collect()}
    many = {tuple(r) for r in knn.exact_knn(cloud, cloud, 5, block_bytes=2000).select("src", "rank", "dst").collect()}
    assert one == many and len(one) == 1500


def test_empty_base(spark, cloud):
    assert knn.exact_knn(cloud, cloud.filter("false"), 3).count() == 0


def test_rank_by_product_is_exact():
    rng = np.random.default_rng(1)
    base = np.repeat(rng.normal(size=(40, 6)), 2, axis=0).astype(np.float32)  # every vector twice: ties everywhere
    ids = np.arange(80)
    place, dist = nearest(base, base, ids, 7)
    full = np.sqrt(((base[:, None].astype(float) - base[None]) ** 2).sum(-1))
    for i in range(80):
        want = sorted(range(80), key=lambda j: (full[i, j], j))[:7]
        assert place[i].tolist() == want


def test_more_ties_than_slack_are_broken_by_id():
    rng = np.random.default_rng(2)
    base = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 600, axis=0), rng.normal(size=(1400, 16))]).astype(np.float32)
    base = base[rng.permutation(2000)]
    ids = np.arange(2000) * 3
    place, dist = nearest(base[:200], base, ids, 11)
    for i in range(200):
        full = np.sqrt(((base[i].astype(float) - base) ** 2).sum(-1))
        assert place[i].tolist() == sorted(range(2000), key=lambda j: (full[j], ids[j]))[:11]
        assert np.allclose(dist[i], full[place[i]])


def test_l2_expression(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(l2("a", "b")).collect()] == [5.0, None]


def test_random_graph_has_no_loops_and_all_nodes(cloud):
    rows = nndescent.random_graph(cloud, 10).collect()
    assert len(rows) == 300 and all(r.id not in r.neighbors and len(set(r.neighbors)) == len(r.neighbors) <= 10 for r in rows)


@pytest.mark.parametrize("ids", [[5], [5, 9, 40]])
def test_tiny_sets_clamp(spark, ids):
    v = frame(spark, [(i, [i, 1]) for i in ids])
    graph, rounds = nndescent.nn_descent(v, 10, 10, 3)
    assert graph.count() == len(ids) * (len(ids) - 1)


def test_nn_descent_recall(cloud):
    truth = {(r.src, r.dst) for r in knn.exact_knn(cloud, cloud, 10).collect()}
    graph, rounds = nndescent.nn_descent(cloud, 20, 10, 10)
    rows = graph.collect()
    assert sum((r.src, r.dst) in truth for r in rows) / len(truth) > 0.95
    assert rounds <= 10 and all(r.src != r.dst for r in rows)
    degree = {}
    for r in rows:
        degree[r.src] = degree.get(r.src, 0) + 1
    assert max(degree.values()) <= 20


def test_both_ways_to_measure_agree(spark, cloud):
    pairs = spark.createDataFrame([(1, 2, "x"), (5, 5, "y"), (7, 299, None), (3, 9999, "no such vector")], "src long, dst long, note string")
    a, b = (sorted((r.src, r.dst, r.note or "", round(r.dist, 12)) for r in knn.with_distance(pairs, cloud, t).collect()) for t in (None, knn.vector_table(cloud)))
    assert a == b and len(a) == 3 and knn.vector_table(cloud, 10) is None
    joined, _ = nndescent.nn_descent(cloud, 5, 5, 2, broadcast_bytes=0)
    looked_up, _ = nndescent.nn_descent(cloud, 5, 5, 2)
    assert {tuple(r[:3]) for r in joined.collect()} == {tuple(r[:3]) for r in looked_up.collect()}


def test_strict_radius_is_no_better(cloud):
    free, _ = nndescent.nn_descent(cloud, 8, 8, 2)
    strict, _ = nndescent.nn_descent(cloud, 8, 8, 2, strict_radius=True)
    mean = lambda g: g.agg(F.avg("dist")).head()[0]
    assert mean(free) <= mean(strict) + 1e-9


def test_reverse_cap(cloud):
    rows = nndescent.capped_reverse(knn.exact_knn(cloud, cloud, 10), 3, seed=1).collect()
    per = {}
    for r in rows:
        per[r.src] = per.get(r.src, 0) + 1
    assert max(per.values()) <= 3


def test_both_searches_agree(cloud):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 6))
    q = cloud.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    for path in (False, True):
        a = search.beam_search(q, graph, cloud, search.seeds_at(q, 3), 12, path)
        b = search.beam_search(q, graph, cloud, search.seeds_at(q, 3), 12, path, broadcast_bytes=0)
        a, b = ([(r.qid, r["rank"], r.id, round(r.dist, 9)) for r in x.orderBy("qid", "rank").collect()] for x in (a, b))
        assert a == b and a
    seeds = search.random_seeds(q, cloud, 1000)
    assert search.beam_search(q, graph, cloud, seeds, 5).count() == 5 * 6


def test_islands_are_joined(spark):
    v = frame(spark, [(i, [i, 0]) for i in range(4)] + [(10 + i, [1000 + i, 0]) for i in range(4)])
    graph = knn.adjacency(knn.exact_knn(v, v, 3))
    tree = connect.spanning_tree(knn.edges(graph), 0)
    assert sorted(r.id for r in connect.unreached(v, tree).collect()) == [10, 11, 12, 13]
    repaired, tree, added = connect.repair(graph, v, 0, 8)
    assert tree.count() == 8 and [(r.src, r.dst) for r in added.collect()] == [(3, 10)]
    assert connect.spanning_tree(knn.edges(repaired), 0).count() == 8


def test_ids_with_gaps_and_dangling_neighbours(spark):
    v = frame(spark, [(1, [0]), (3, [1]), (5, [2]), (9, [7])])
    graph = spark.createDataFrame([(1, [2, 3]), (3, [5, 99]), (5, [1, 4]), (8, [1]), (9, None)], "id long, neighbors array<long>")
    q = spark.createDataFrame([(0, [0.0]), (7, [2.0])], "qid long, vec array<float>")
    seeds = spark.createDataFrame([(0, 1), (0, 2), (7, 3), (7, 100)], "qid long, id long")
    want = {0: [1, 3, 5], 7: [5, 3, 1]}
    for bound in (1 << 28, 0):
        got = {}
        for r in search.beam_search(q, graph, v, seeds, 5, broadcast_bytes=bound).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want
    assert search.beam_search(q, graph, v, seeds.filter("id > 50"), 5).count() == 0
    drawn = search.random_seeds(q, v, 50)
    assert {r.id for r in drawn.collect()} <= {1, 3, 5, 9} and drawn.count() == drawn.distinct().count() > 2
    assert search.random_seeds(q, v.filter("false"), 3).count() == 0


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_a_search_that_is_cut_off_is_an_error(spark, bound):
    v = frame(spark, [(i, [i]) for i in range(12)])
    graph = spark.createDataFrame([(i, [i + 1]) for i in range(11)], "id long, neighbors array<long>")
    q = spark.createDataFrame([(0, [11.0])], "qid long, vec array<float>")
    assert search.beam_search(q, graph, v, search.seeds_at(q, 0), 3, broadcast_bytes=bound).head().id == 11
    with pytest.raises(Exception, match="not done after 4 rounds"):
        search.beam_search(q, graph, v, search.seeds_at(q, 0), 3, broadcast_bytes=bound, max_rounds=4).collect()


def test_pools_together_are_each_pool(spark, cloud):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 6))
    q = cloud.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    both = search.search_pools(q, graph, cloud, search.seeds_at(q, 3), [5, 9])
    for pool in (5, 9):
        one = {tuple(r) for r in search.beam_search(q, graph, cloud, search.seeds_at(q, 3), pool).collect()}
        assert {tuple(r)[1:] for r in both.filter(F.col("pool") == pool).collect()} == one


def test_ranks_of_ids_with_gaps(spark):
    ids = [5, -3, 1000, 7, 8, 2**40, 12]
    ranks, n = knn.ranked_ids(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert n == 7 and {r.place: r.id for r in ranks.collect()} == dict(enumerate(sorted(ids)))
    placed = redistribute.by_ranges(spark.createDataFrame([(i,) for i in ids], "id long"), 3)
    assert sorted((r.worker, r.id) for r in placed.collect()) == [(0, -3), (0, 5), (0, 7), (1, 8), (1, 12), (1, 1000), (2, 2**40)]
    assert {(r.worker, r.pos): r.id for r in redistribute.owner_ids(placed).collect()}[1, 2] == 1000


def plain_repair(edges, vectors, nav, find):
    """One node after another, the smallest id first: the nodes that get an edge."""
    reach, joined = set(), []

    def flood(x):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in reach:
                reach.add(y)
                todo += edges.get(y, [])

    flood(nav)
    while set(vectors) - reach:
        joined.append(min(set(vectors) - reach))
        flood(joined[-1])
    return joined


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_joins_the_nodes_that_one_by_one_would(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    v = frame(spark, list(enumerate(rng.normal(size=(n, 3)).astype(np.float32))))
    edges = {i: [int(x) for x in rng.integers(0, n, rng.integers(0, 2))] for i in range(n)}
    graph = spark.createDataFrame(list(edges.items()), "id long, neighbors array<long>")
    repaired, tree, added = connect.repair(graph, v, 0, 8)
    assert sorted(r.dst for r in added.collect()) == plain_repair(edges, range(n), 0, None)
    rows = {r.child: r for r in tree.collect()}
    assert len(rows) == n == tree.count()
    linked = {(r.src, r.dst) for r in knn.edges(repaired).collect()}
    assert all(c == 0 or ((r.parent, c) in linked and r.depth == rows[r.parent].depth + 1) for c, r in rows.items())


def test_run_config(spark, cloud, tmp_path):
    files = {k: str(tmp_path / k) for k in ("input.fvecs", "aknng", "nsg", "query.fvecs", "truth.ivecs")}
    q = cloud.filter("id < 20")
    vecs.write_fvecs(cloud, files["input.fvecs"])
    vecs.write_fvecs(q, files["query.fvecs"])
    truth = knn.exact_knn(q, cloud, 5, exclude_self=False)
    vecs.write_ivecs(knn.adjacency(truth).select("id", F.col("neighbors").cast("array<int>").alias("values")), files["truth.ivecs"])
    config = IndexConfig(input_file=files["input.fvecs"], aknng_file=files["aknng"], nsg_file=files["nsg"], query_file=files["query.fvecs"], query_result_file=files["truth.ivecs"], k=15, candidate_queue_size_nsg=30, candidate_queue_size_knng=30, max_reverse_neighbors_nsg=15, candidate_queue_increases=1, approximate_navigating_node=True)
    built, rows = pipeline.run_config(spark, config)
    rows = rows.orderBy("pool").collect()
    assert [r.pool for r in rows] == [5, 25] and rows[1].recall > 0.9 and {r.name for r in built.metrics().collect()} >= {"rounds", "repairs", "aknng_seconds", "nodes", "edges"}
    again, more = pipeline.run_config(spark, config)  # from the saved graph
    assert again.nav_node == built.nav_node and sorted(map(tuple, more.collect())) == sorted(map(tuple, rows)) and again.tree.count() == 300
    few, none = pipeline.run_config(spark, IndexConfig(input_file=files["input.fvecs"], lines=40, k=10, candidate_queue_size_nsg=20))
    assert few.vectors.count() == 40 and none is None


def test_approximate_navigating_node(spark, cloud):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 10))
    near = centroid.approximate_navigating_node(cloud, graph, 40).head()
    exact = centroid.navigating_node(cloud).head()
    assert exact.dist <= near.dist + 1e-6 and near.dist < 1.5 * exact.dist + 1e-6


def test_partial_graph_and_leaves(spark, cloud):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 3))
    assert sorted(r.id for r in redistribute.partial_graph(graph, cloud.filter("id < 4")).collect()) == [0, 1, 2, 3]
    assert [r.id for r in redistribute.tree_leaves(chain(spark)).collect()] == [9]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(Session())


def chain(spark, n=10):
    return spark.createDataFrame([(i, max(i - 1, 0), i) for i in range(n)], connect.TREE)


def test_chain_tree(spark):
    tree = chain(spark)
    sizes = {r.id: r.size for r in redistribute.subtree_sizes(tree).collect()}
    assert sizes == {i: 10 - i for i in range(10)}
    assert redistribute.ancestors(tree).count() == sum(range(9))
    placed = redistribute.assignment(tree, 2, mode="fastRedistribution")
    loads = sorted(r["count"] for r in placed.groupBy("worker").count().collect())
    assert loads == [5, 5] and placed.count() == 10
    replicas = redistribute.replicate(tree, placed, 2, "onlyParentsReplication")
    assert replicas.join(placed, ["id", "worker"]).count() == 0 and replicas.filter("id = 0").count() == 0
    assert redistribute.replicate(tree, placed, 2, "noReplication").count() == 0


@pytest.mark.parametrize("workers", [1, 3, 4, 7])
def test_plan_covers_all_within_bounds(spark, cloud, workers):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 8))
    tree = connect.repair(graph, cloud, 0, 20)[1]
    placed = redistribute.assignment(tree, workers, cloud, "optimalRedistribution")
    assert placed.select("id").distinct().count() == 300 == placed.count()
    shared = redistribute.replicate(tree, placed, workers, "allSharedReplication")
    assert shared.join(placed, ["id", "worker"]).count() == 0
    moved = redistribute.redistribute(cloud, placed, shared)
    assert moved.count() == 300 + shared.count() and moved.filter("is_primary").count() == 300


def test_range_and_load_bounds():
    assert redistribute.range_partitions(10, 4) == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert redistribute.range_partitions(2, 4) == [(0, 1), (1, 2), (2, 2), (2, 2)]
    assert redistribute.load_bounds(1000, 5) == (198, 202)


def test_pipeline_invariants_and_recall(spark, cloud, tmp_path):
    config = IndexConfig(k=20, candidate_queue_size_nsg=40, candidate_queue_size_knng=40, max_reverse_neighbors_nsg=15, candidate_queue_increase_by=10, candidate_queue_increases=2, workers=3)
    base = cloud.filter("id % 50 <> 0")
    q = cloud.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    index = pipeline.build_index(base, config)
    degree = nsg.degrees(knn.edges(index.graph), base)
    assert degree.agg(F.max("in_degree")).head()[0] <= 15 + index.info["repairs"]
    assert index.tree.count() == base.count() and knn.edges(index.graph).filter("src = dst").count() == 0
    truth = knn.exact_knn(q.withColumnRenamed("qid", "id"), base, 10).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    rows = pipeline.sweep(index, q, truth, config).orderBy("pool").collect()
    assert rows[-1].recall > 0.93 and rows[-1].precision >= rows[-1].recall
    index.save(str(tmp_path / "index"))
    again = pipeline.Index.load(spark, str(tmp_path / "index"), base)
    assert again.nav_node == index.nav_node and again.graph.count() == index.graph.count()
    for mode in ("noRedistribution", "fastRedistribution"):
        placed, _ = pipeline.distribute(index, IndexConfig(workers=3, data_redistribution=mode, data_replication="noReplication"))
        assert placed.select("worker").distinct().count() == 3


def test_metrics(spark):
    truth = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20), (2, 2, 21)], "qid long, rank long, id long")
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (1, 3, 11), (2, 1, 21)], "qid long, rank long, id long")
    r = evaluate.recall_metrics(found, truth, 2).head()
    assert (r.queries, r.first_hits, r.correct, r.precision, r.recall) == (2, 1, 3, 0.75, 0.5)


def test_routing_and_centroid(spark):
    v = frame(spark, [(0, [0, 0]), (1, [2, 0]), (2, [10, 0])])
    assert centroid.centroid(v).head().vec == [4.0, 0.0]
    assert centroid.navigating_node(v).head().id == 1
    mids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "worker int, vec array<double>")
    routed = {r.qid: r.worker for r in centroid.route(v.withColumnRenamed("id", "qid"), mids).collect()}
    assert routed == {0: 0, 1: 0, 2: 1}


def test_codecs(spark, cloud, tmp_path):
    path = str(tmp_path / "a.fvecs")
    vecs.write_fvecs(cloud, path)
    assert {r.id: r.vec for r in vecs.read_fvecs(spark, path).collect()} == {r.id: r.vec for r in cloud.collect()}
    assert vecs.read_fvecs(spark, path, 7).count() == 7
    rows = spark.createDataFrame([(0, [3, 1]), (1, [2, 2])], "id long, values array<int>")
    vecs.write_ivecs(rows, str(tmp_path / "b.ivecs"))
    assert sorted(map(tuple, vecs.read_truth(spark, str(tmp_path / "b.ivecs")).collect())) == [(0, 1, 3), (0, 2, 1), (1, 1, 2), (1, 2, 2)]
    q, t = vecs.read_queries(spark, path, str(tmp_path / "b.ivecs"))
    assert q.count() == 2 and t.count() == 4
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert vecs.read_fvecs(spark, str(tmp_path / "none.fvecs")).count() == 0


@pytest.mark.parametrize("nav", [None, 7])
def test_graph_file_keeps_every_neighbour(spark, tmp_path, nav):
    graph = spark.createDataFrame([(1, [2, 3]), (2, []), (3, [1])], "id long, neighbors array<long>")
    path = str(tmp_path / "g.graph")
    graph_file.write_graph(graph, path, nav)
    back, found = graph_file.read_graph(spark, path)
    assert found == nav and {r.id: r.neighbors for r in back.collect()} == {1: [2, 3], 2: [], 3: [1]}


def test_truncated_graph_file():
    with pytest.raises(ValueError):
        list(graph_file.decode_graph(np.array([-1, 5, 3, 1], "<i4").tobytes()))


def test_query_stream(spark, cloud, tmp_path):
    graph = knn.adjacency(knn.exact_knn(cloud, cloud, 8))
    index = pipeline.Index(cloud, graph, 0)
    q = cloud.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    q.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = search_stream(index, stream, 5, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    assert spark.read.parquet(out).count() == 5 * q.count()


def test_scratch_is_dropped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    df = cut(spark.range(5).toDF("x"))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    held = list(scratch._PATHS)
    scratch._PATHS[:] = [p for p in held if p in path]
    assert drop_scratch(spark) == 1 and not os.path.exists(path) and (tmp_path / "kept").exists()
    scratch._PATHS[:] = [p for p in held if p not in path]


def test_config(spark):
    with pytest.raises(ValueError):
        IndexConfig(k=0)
    with pytest.raises(ValueError):
        IndexConfig(data_replication="some")
    spark.conf.set("lodestar.k", "33")
    try:
        c = IndexConfig.from_spark(spark, workers=2)
        assert c.k == 33 and c.workers == 2 and "k = 33" in c.describe()
    finally:
        spark.conf.unset("lodestar.k")


def test_plan_from_the_top_of_the_tree_is_that_of_the_whole(spark):
    rng = np.random.default_rng(3)
    parent, depth = [0], [0]
    for i in range(1, 1200):
        parent.append(int(rng.integers((i - 1) // 8, (i - 1) // 3 + 1)))
        depth.append(depth[parent[-1]] + 1)
    size = [1] * 1200
    for i in range(1199, 0, -1):
        size[parent[i]] += size[i]
    rows = list(zip(range(1200), parent, depth))
    tree = cut(spark.createDataFrame(rows, "child long, parent long, depth int"), "tree")
    sizes = redistribute.subtree_sizes(tree)
    top = redistribute.top_of_tree(tree, sizes, 1200, 3)
    assert 0 < len(top) < 600
    whole = spark.createDataFrame(list(zip(range(1200), parent, size)), "child long, parent long, size long").collect()
    want = dict(redistribute.plan(whole, 1200, 3))
    got = {r.id: r.worker for r in redistribute.assignment(tree, 3).collect()}
    assert got == want and set(want.values()) == {0, 1, 2}
