"""Partitioning of vectors along the spanning tree, with replication.

Subtree sizes are sums by level, deepest first. The plan itself is a sequential walk over (node, parent, size) on the
driver, but only over the top of the tree: a subtree that fits between the load bounds is never entered, so what is
below it stays where it is and inherits its worker by levels. Moving rows is one shuffle on the worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Growing
from .knn import ranked_ids, vector_matrix

ASSIGNMENT = "id long, worker int"


def range_partitions(n: int, parts: int) -> list[tuple[int, int]]:
    """Contiguous ranges [from, to) of ceil-sized parts; on tiny data the last ones are empty."""
    size = -(-n // max(parts, 1))
    return [(min(i * size, n), min((i + 1) * size, n)) for i in range(parts)]


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(id, size): nodes of each subtree, the node itself included."""
    deepest = tree.agg(F.max("depth")).head()[0]
    done = Growing(tree.sparkSession, "id long, parent long, size long", "sizes")
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = tree.filter(F.col("depth") == depth).select(F.col("child").alias("id"), "parent")
        level = level.withColumn("below", F.lit(0).cast("long")) if below is None else level.join(below, "id", "left")
        sized = done.append(level.select("id", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size")))
        below = sized.filter("id <> parent").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
    return done.table().select("id", "size")


def by_ranges(vectors: DataFrame, workers: int) -> DataFrame:
    """(id, worker) by the ids' ranks: the ranges of ``range_partitions``, whatever gaps the ids have."""
    ranks, n = ranked_ids(vectors)
    size = max(1, -(-n // max(workers, 1)))
    return ranks.select("id", F.floor(F.col("place") / size).cast("int").alias("worker"))


def owner_ids(placed: DataFrame) -> DataFrame:
    """(worker, pos, id): the ids that each worker holds, in order, as rows: no list grows with the data."""
    from pyspark.sql import Window

    w = Window.partitionBy("worker").orderBy("id")
    return placed.select("worker", (F.row_number().over(w) - 1).cast("long").alias("pos"), "id")


def expected_counts(placed: DataFrame) -> DataFrame:
    """(worker, nodes, first_id, last_id): what each worker is to receive."""
    return placed.groupBy("worker").agg(F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def partial_graph(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``graph(id, neighbors)`` for some ``ids(id)``, as a worker asks for them."""
    return graph.join(ids.select("id"), "id", "left_semi")


def tree_leaves(tree: DataFrame) -> DataFrame:
    """(id) of nodes without children."""
    return tree.select(F.col("child").alias("id")).join(tree.filter("child <> parent").select(F.col("parent").alias("id")), "id", "left_anti")


def load_bounds(n: int, workers: int) -> tuple[int, int]:
    """Least and most nodes of a worker: n / workers give or take n / (100 (workers - 1)), in whole numbers."""
    if workers < 2:
        return n, n
    slack = n // (100 * (workers - 1))
    return n // workers - slack, n // workers + slack


def top_of_tree(tree: DataFrame, sizes: DataFrame, n: int, workers: int) -> list:
    """Rows (child, parent, size) that ``plan`` can visit: the children of subtrees larger than the bounds are apart.

    At most depth x 50 (workers - 1) subtrees are that large; a smaller one never overfills a worker that still lacks nodes.
    """
    least, most = load_bounds(n, workers)
    large = sizes.filter(F.col("size") > most - least).select(F.col("id").alias("parent"))
    rows = tree.select("child", "parent").join(large, "parent", "left_semi")
    return rows.join(sizes, rows["child"] == sizes["id"]).select("child", "parent", "size").collect()


def inherited(tree: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, worker): every node of the tree with its worker in ``owners``, or else its parent's, level by level."""
    deepest = tree.agg(F.max("depth")).head()[0]
    done, above = Growing(tree.sparkSession, ASSIGNMENT, "assignment"), None
    owners = owners.select(F.col("id"), F.col("worker").alias("own"))
    for depth in range(-1 if deepest is None else deepest + 1):
        level = tree.filter(F.col("depth") == depth).select(F.col("child").alias("id"), "parent").join(owners, "id", "left")
        level = level.withColumn("up", F.lit(None).cast("int")) if above is None else level.join(above, "parent", "left")
        placed = done.append(level.select("id", F.coalesce("own", "up").cast("int").alias("worker")))
        above = placed.select(F.col("id").alias("parent"), F.col("worker").alias("up"))
    return done.table()


def plan(rows: list, n: int, workers: int, closest: Callable[[int, list[int]], int] | None = None) -> list[tuple[int, int]]:
    """(id, worker) for the nodes of ``rows`` (child, parent, size), the whole tree of ``n`` nodes or its top.

    Subtrees are gathered on a waiting list until they reach a worker's share: one that is too small is queued and its
    parent looked at again, one that is too large is left for a child. ``closest`` picks the child (default: the
    first) given the node queued last; the last worker takes what is left.
    """
    parent = {r.child: r.parent for r in rows}
    rest = {r.child: r.size for r in rows}
    children: dict[int, list[int]] = {r.child: [] for r in rows}
    root = next(r.child for r in rows if r.child == r.parent)
    for r in sorted(rows, key=lambda r: r.child):
        if r.child != root:
            children[r.parent].append(r.child)
    full = {x: list(c) for x, c in children.items()}
    least, most = load_bounds(n, workers)
    owner: dict[int, int] = {}

    def claim(nodes: list[int], worker: int) -> None:
        stack = list(nodes)
        while stack:
            x = stack.pop()
            if x not in owner:
                owner[x] = worker
                stack += full[x]

    def detach(x: int) -> None:
        """Take a subtree out of its ancestors' rests."""
        size, p = rest[x], parent[x]
        if x != root:
            children[p].remove(x)
            while True:
                rest[p] -= size
                if p == root:
                    break
                p = parent[p]

    waiting: list[int] = []
    gathered, worker, node = 0, 0, root
    while worker < workers - 1:
        size = rest[node] + gathered
        if size > most and children[node]:
            last = waiting[-1] if waiting else node
            node = closest(last, children[node]) if closest and len(children[node]) > 1 else children[node][0]
            continue
        if node == root:
            break
        up = parent[node]
        detach(node)
        waiting.append(node)
        gathered = size
        if gathered >= least:
            claim(waiting, worker)
            waiting, gathered, worker = [], 0, worker + 1
        node = up
    claim(waiting, worker)
    claim([root], worker)
    for x in full:  # whatever no subtree brought along
        owner.setdefault(x, worker)
    return sorted(owner.items())


def assignment(tree: DataFrame, workers: int, vectors: DataFrame | None = None, mode: str = "optimalRedistribution", fetch_bytes: int = 256 << 20) -> DataFrame:
    """(id, worker). ``optimalRedistribution`` descends into the child nearest to the node queued last."""
    spark = tree.sparkSession
    sizes = subtree_sizes(tree)
    pick = None
    if mode == "optimalRedistribution" and vectors is not None:
        r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).head()
        held = vectors.select("id", "vec").toArrow() if r.n * (4 * r.d + 8) <= fetch_bytes else None

        def fetched(ids: list[int]) -> dict[int, np.ndarray]:
            """Vectors of a node and its children; one job for each choice only where the table is too large to be held."""
            if held is None:
                return {x.id: np.array(x.vec) for x in vectors.filter(F.col("id").isin(ids)).select("id", "vec").collect()}
            return {i: matrix[at[i]] for i in ids}

        if held is not None:
            at, matrix = {i: k for k, i in enumerate(held["id"].to_pylist())}, vector_matrix(held["vec"]).astype(np.float64)

        def pick(last: int, options: list[int]) -> int:
            vec = fetched([last, *options])
            return min(options, key=lambda x: (float(((vec[last] - vec[x]) ** 2).sum()), x))

    n = tree.count()
    placed = plan(top_of_tree(tree, sizes, n, workers), n, workers, pick)
    owners = spark.createDataFrame(placed, ASSIGNMENT)
    return owners if len(placed) == n else inherited(tree, owners)


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor): every proper ancestor of each node but the root."""
    deepest = tree.agg(F.max("depth")).head()[0]
    up = tree.filter("child <> parent").select(F.col("child").alias("node"), "parent")
    step = up.select(F.col("node").alias("id"), F.col("parent").alias("ancestor"))
    out = step
    for _ in range(max(deepest - 1, 0)):
        step = step.join(up.withColumnRenamed("parent", "next"), step["ancestor"] == F.col("node")).select("id", F.col("next").alias("ancestor"))
        out = out.unionByName(step)
    roots = tree.filter("child = parent").select(F.col("child").alias("ancestor"))
    return out.join(roots, "ancestor", "left_anti").select("id", "ancestor")


def parent_replicas(tree: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, worker): workers that also get a node since they hold a descendant of it; never its primary worker."""
    holders = ancestors(tree).join(placed, "id").select(F.col("ancestor").alias("id"), "worker").distinct()
    return holders.join(placed, ["id", "worker"], "left_anti").select("id", "worker")


def shared_replicas(replicas: DataFrame, placed: DataFrame, workers: int) -> DataFrame:
    """(id, worker): nodes with any replica go to every worker but their primary one."""
    every = replicas.select("id").distinct().withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    return every.join(placed, ["id", "worker"], "left_anti").select("id", F.col("worker").cast("int").alias("worker"))


def replicate(tree: DataFrame, placed: DataFrame, workers: int, model: str) -> DataFrame:
    if model == "noReplication":
        return placed.filter("false")
    replicas = parent_replicas(tree, placed)
    return replicas if model == "onlyParentsReplication" else shared_replicas(replicas, placed, workers)


def replica_counts(replicas: DataFrame) -> DataFrame:
    """One row: nodes with a replica, and replicas."""
    return replicas.agg(F.countDistinct("id").alias("nodes"), F.count("*").alias("replicas"))


def redistribute(rows: DataFrame, placed: DataFrame, replicas: DataFrame) -> DataFrame:
    """Rows (with id) beside the workers that hold them, dealt by worker: columns worker and is_primary are added."""
    where = placed.withColumn("is_primary", F.lit(True)).unionByName(replicas.withColumn("is_primary", F.lit(False)))
    return rows.join(where, "id").repartition("worker")
