"""Random initial graphs and NN-Descent in synchronous rounds.

A round joins each node's neighbourhood with itself: forward neighbours and a capped sample of reverse neighbours meet at
the node between them, a pair counts if one side is new since the last round, both ends get the other as candidate, and
each node keeps its best k by (distance, id). Rounds stop at ``max_rounds`` or when nothing changes. All steps are
shuffles on node ids; a node's neighbourhood is bounded by k + the reverse cap, so no join group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import PRIME, l2_rows, seeded_id
from ..plans.scratch import cut, drop_scratch, mark
from .knn import ranked_ids, top_k, vector_table, with_distance


def random_pairs(vectors: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """(src, dst): ``degree`` distinct pseudo-random neighbours of each node, without itself; fewer if there are fewer nodes.

    Each node draws ranks among the sorted ids, twice as many as it needs and ten, and keeps the first distinct ones; of a
    handful of nodes every other is drawn.
    """
    ranks, n = ranked_ids(vectors)
    degree = min(degree, max(n - 1, 0))
    slots = ranks.select(F.col("id").alias("src"), F.col("place").alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(n if n <= 4 * degree + 1 else 2 * degree + 10, 1)).cast("long"))).alias("slot"))
    if n <= 4 * degree + 1:
        drawn = slots.withColumn("place", F.col("slot") - 1).withColumn("slot", seeded_id(PRIME, seed, "own", "slot"))
    else:
        drawn = slots.withColumn("place", seeded_id(n, seed, "own", "slot"))
    first = drawn.filter("place <> own").groupBy("src", "place").agg(F.min("slot").alias("slot"))
    w = Window.partitionBy("src").orderBy("slot", "place")
    kept = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= degree)
    return kept.join(ranks.withColumnRenamed("id", "dst"), "place").select("src", "dst")


def random_graph(vectors: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """``graph(id, neighbors)``; every node has a row."""
    lists = random_pairs(vectors, degree, seed).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    return vectors.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def initial_knn(vectors: DataFrame, k: int, degree: int, seed: int = 42, table: Broadcast | None = None) -> DataFrame:
    """The first lists: random neighbours, measured, best k."""
    return top_k(with_distance(random_pairs(vectors, degree, seed), vectors, table), k)


def reverse_edges(knn: DataFrame) -> DataFrame:
    """(src, dst, dist) with the direction turned."""
    return knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def capped_reverse(knn: DataFrame, cap: int, seed: int | None = None) -> DataFrame:
    """At most ``cap`` reverse neighbours of each node: the nearest, or a seeded choice."""
    order = ["dist", "dst"] if seed is None else [F.xxhash64(F.lit(seed), "src", "dst"), F.col("dst")]
    w = Window.partitionBy("src").orderBy(*order)
    turned = reverse_edges(knn)
    rest = [c for c in turned.columns]
    return turned.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= cap).select(*rest, "rank")


def forward_and_reverse(knn: DataFrame, cap: int) -> DataFrame:
    """Distinct (src, dst) of forward and capped reverse neighbours."""
    return knn.select("src", "dst").unionByName(capped_reverse(knn, cap).select("src", "dst")).distinct()


def local_join_pairs(neighbourhood: DataFrame, flagged: bool = False, distinct: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that meet at some node; ``flagged``: one of them is new there."""
    flag = F.col("is_new") if flagged else F.lit(True)
    one = neighbourhood.select(F.col("src").alias("pivot"), F.col("dst").alias("a"), flag.alias("new_a"))
    two = neighbourhood.select(F.col("src").alias("pivot"), F.col("dst").alias("b"), flag.alias("new_b"))
    pairs = one.join(two, "pivot").filter((F.col("a") < F.col("b")) & (F.col("new_a") | F.col("new_b"))).select("a", "b")
    return pairs.distinct() if distinct else pairs


def candidates(pairs: DataFrame, vectors: DataFrame, table: Broadcast | None = None) -> DataFrame:
    """Both directions of measured pairs: (src, dst, dist)."""
    measured = with_distance(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), vectors, table)
    ends = F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))
    return measured.select(F.explode(ends).alias("e"), "dist").select(F.col("e.x").alias("src"), F.col("e.y").alias("dst"), "dist")


def improving_candidates(knn: DataFrame, around: DataFrame, k: int, table: Broadcast) -> DataFrame:
    """(src, dst, dist) from the local join, without those that can't enter a full list of ``k``.

    The farthest distance of each list is sent along: as many numbers as the table has vectors.
    """
    worst = knn.groupBy("src").agg(F.max("dist").alias("worst"), F.count("*").alias("n")).filter(F.col("n") >= k).toArrow()
    ids = table.value[0]
    radius = np.full(len(ids), np.inf)
    radius[np.searchsorted(ids, worst["src"].to_numpy())] = worst["worst"].to_numpy()
    sent = knn.sparkSession.sparkContext.broadcast(radius)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, matrix), radius = table.value, sent.value
        for r in batches:
            if not r.num_rows:
                continue
            a, b = (r.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
            dist = l2_rows(matrix[x], matrix[y])
            to_a, to_b = dist <= radius[x], dist <= radius[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[to_a], b[to_b]])), pa.array(np.concatenate([b[to_a], a[to_b]])), pa.array(np.concatenate([dist[to_a], dist[to_b]]))], names=["src", "dst", "dist"])

    return local_join_pairs(around, flagged=True, distinct=False).mapInArrow(measured, "src long, dst long, dist double")


def descent_round(knn: DataFrame, vectors: DataFrame, k: int, cap: int, strict_radius: bool = False, seed: int = 42, table: Broadcast | None = None) -> DataFrame:
    """One round over ``knn`` (src, dst, dist, is_new); the result has the flag set where the neighbour was not there before."""
    forward = knn.select("src", "dst", "is_new")
    reverse = capped_reverse(knn.select("src", "dst", "dist"), cap, seed).select("src", "dst")
    turned = knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "is_new")
    around = forward.unionByName(reverse.join(turned, ["src", "dst"])).groupBy("src", "dst").agg(F.max("is_new").alias("is_new"))
    if table is not None and not strict_radius:
        fresh = improving_candidates(knn, around, k, table)
    else:
        fresh = candidates(local_join_pairs(around, flagged=True), vectors, table)
    if strict_radius:
        worst = knn.groupBy("src").agg(F.max("dist").alias("worst"))
        fresh = fresh.join(worst, "src").filter("dist < worst").drop("worst")
    both = knn.select("src", "dst", "dist", F.lit(True).alias("was")).unionByName(fresh.withColumn("was", F.lit(False)))
    merged = both.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("was").alias("was"))
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return merged.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("src", "rank", "dst", "dist", (~F.col("was")).alias("is_new"))


def nn_descent(vectors: DataFrame, k: int, degree: int = 10, max_rounds: int = 10, cap: int = 100, strict_radius: bool = False, seed: int = 42, broadcast_bytes: int = 256 << 20) -> tuple[DataFrame, int]:
    """The approximate graph (src, rank, dst, dist) and the rounds used.

    Distances are looked up in a table of the vectors where that fits ``broadcast_bytes``, else joined by id.
    """
    table, began = vector_table(vectors, broadcast_bytes), mark()
    knn = cut(initial_knn(vectors, k, degree, seed, table).withColumn("is_new", F.lit(True)), "nnd")
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        knn = cut(descent_round(knn, vectors, k, cap, strict_radius, seed, table), "nnd")
        drop_scratch(vectors.sparkSession, began, knn)
        if not knn.filter("is_new").limit(1).count():
            break
    return knn.select("src", "rank", "dst", "dist"), rounds
