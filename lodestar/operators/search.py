"""Batched beam search on a proximity graph.

All queries advance together. In a round every pool member that has not been expanded is expanded: its neighbours that the
query has not met are measured and the best ``pool`` by (distance, id) stay; a search ends when all members of its pool
are expanded. ``path``: expanded nodes that fell out of the pool are kept too and come back with the result.

Two executions with equal results: where graph and vectors fit ``broadcast_bytes`` (checked), each partition of queries
runs its rounds in one numpy kernel; beyond that, rounds are DataFrame joins on node ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2, l2_rows, seeded_id
from ..plans.scratch import cut, drop_scratch, mark
from .knn import ranked_ids, vector_matrix

RESULT = "qid long, rank long, id long, dist double"


def seeds_at(queries: DataFrame, node: int) -> DataFrame:
    """(qid, id): every query starts at one node."""
    return queries.select("qid", F.lit(node).cast("long").alias("id"))


def random_seeds(queries: DataFrame, vectors: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(qid, id): distinct pseudo-random nodes for each query, by their rank among the ids; at most as many as there are."""
    ranks, n = ranked_ids(vectors)
    if not n:
        return queries.select("qid", F.lit(None).cast("long").alias("id")).filter("false")
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(min(count, n)))).alias("slot"))
    drawn = slots.select("qid", seeded_id(n, seed, "qid", "slot").alias("place")).distinct()
    return drawn.join(ranks, "place").select("qid", "id")


def beam_search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, seeds: DataFrame, pool: int, path: bool = False, broadcast_bytes: int = 256 << 20, max_rounds: int = 1000) -> DataFrame:
    """(qid, rank, id, dist) for ``queries(qid, vec)`` on ``graph(id, neighbors)`` from ``seeds(qid, id)``.

    Seeds and neighbours without a vector are passed over; a query without any seed that has one has no result. An error
    if some query is not done after ``max_rounds`` rounds.
    """
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).head()
    e = graph.agg(F.coalesce(F.sum(F.size("neighbors")), F.lit(0))).head()[0]
    if r.n * (4 * r.d + 24) + 8 * e <= broadcast_bytes:
        return _kernel_search(queries, GraphArrays.sent(vectors, graph), seeds, pool, path, max_rounds)
    return _join_search(queries, graph, vectors, seeds, pool, path, max_rounds)


class GraphArrays:
    """Vectors and adjacency as arrays over positions of the sorted ids."""

    def __init__(self, vectors: pa.Table, graph: pa.Table):
        ids = vectors["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], vector_matrix(vectors["vec"])[order]
        lists = graph["neighbors"].combine_chunks() if graph.num_rows else pa.array([], pa.list_(pa.int64()))
        size = np.zeros(len(self.ids) + 1, np.int64)
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        flat, known = self.place(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        count = segment_counts(known, lists.offsets.to_numpy() - (lists.offsets.to_numpy()[0] if len(lists.offsets) else 0))
        flat = flat[known]
        at, has = self.place(graph["id"].to_numpy())
        flat, at, count = flat[np.repeat(has, count)], at[has], count[has]
        size[at + 1] = count
        self.offsets = np.cumsum(size)
        self.targets = np.empty(len(flat), np.int64)
        begin = self.offsets[at]
        ends = np.cumsum(count)
        self.targets[np.repeat(begin - (ends - count), count) + np.arange(len(flat))] = flat

    @classmethod
    def sent(cls, vectors: DataFrame, graph: DataFrame) -> Broadcast:
        return vectors.sparkSession.sparkContext.broadcast(cls(vectors.select("id", "vec").toArrow(), graph.select("id", "neighbors").toArrow()))

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ids, and which of them there are."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.targets[self.offsets[x] : self.offsets[x + 1]] for x in nodes]) if len(nodes) else np.zeros(0, np.int64)

    def search(self, query: np.ndarray, seeds: np.ndarray, pool: int, path: bool, max_rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) in order."""
        seeds, known = self.place(seeds)
        met = np.unique(seeds[known])
        dist = l2_rows(self.matrix[met], query[None, :])
        open_ = np.ones(len(met), bool)
        order = np.lexsort((met, dist))
        node, dist, open_ = met[order], dist[order], open_[order]
        node, dist, open_ = node[:pool], dist[:pool], open_[:pool]
        out_node, out_dist = np.zeros(0, np.int64), np.zeros(0)
        rounds = 0
        while open_.any():
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"a search is not done after {max_rounds} rounds")
            fresh = np.setdiff1d(self.neighbours(node[open_]), met)
            open_[:] = False
            if not len(fresh):
                break
            met = np.union1d(met, fresh)
            node = np.concatenate([node, fresh])
            dist = np.concatenate([dist, l2_rows(self.matrix[fresh], query[None, :])])
            open_ = np.concatenate([open_, np.ones(len(fresh), bool)])
            order = np.lexsort((node, dist))
            if path:
                gone = order[pool:][~open_[order[pool:]]]
                out_node, out_dist = np.concatenate([out_node, node[gone]]), np.concatenate([out_dist, dist[gone]])
            order = order[:pool]
            node, dist, open_ = node[order], dist[order], open_[order]
        node, dist = np.concatenate([node, out_node]), np.concatenate([dist, out_dist])
        order = np.lexsort((node, dist))
        return node[order], dist[order]


def segment_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]] if len(offsets) else np.zeros(0, np.int64)


def _kernel_search(queries: DataFrame, sent: Broadcast, seeds: DataFrame, pool: int, path: bool, max_rounds: int) -> DataFrame:
    starts = seeds.groupBy("qid").agg(F.collect_set("id").alias("seeds"))  # as many as the parameter of the seeds says

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            qids, vecs = b.column(0).to_pylist(), vector_matrix(b.column(1))
            rows = [arrays.search(v, np.asarray(s, np.int64), pool, path, max_rounds) for v, s in zip(vecs, b.column(2).to_pylist())]
            size = [len(n) for n, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, size), pa.int64()), pa.array(np.concatenate([np.arange(1, s + 1) for s in size])), pa.array(arrays.ids[np.concatenate([n for n, _ in rows])]), pa.array(np.concatenate([d for _, d in rows]))],
                names=["qid", "rank", "id", "dist"],
            )

    return queries.join(starts, "qid").select("qid", "vec", "seeds").mapInArrow(run, RESULT)


def search_pools(queries: DataFrame, graph: DataFrame, vectors: DataFrame, seeds: DataFrame, pools: list[int], broadcast_bytes: int = 256 << 20, max_rounds: int = 1000) -> DataFrame:
    """(pool, qid, rank, id, dist): ``beam_search`` for several pool sizes; graph and vectors are sent once for all."""
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).head()
    e = graph.agg(F.coalesce(F.sum(F.size("neighbors")), F.lit(0))).head()[0]
    sent = GraphArrays.sent(vectors, graph) if r.n * (4 * r.d + 24) + 8 * e <= broadcast_bytes else None
    out = None
    for pool in pools:
        found = _join_search(queries, graph, vectors, seeds, pool, False, max_rounds) if sent is None else _kernel_search(queries, sent, seeds, pool, False, max_rounds)
        found = found.select(F.lit(pool).cast("long").alias("pool"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def _join_search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, seeds: DataFrame, pool: int, path: bool, max_rounds: int) -> DataFrame:
    def measured(pairs: DataFrame) -> DataFrame:
        q = queries.select("qid", F.col("vec").alias("qv"))
        return pairs.join(vectors.select("id", "vec"), "id").join(q, "qid").select("qid", "id", l2("vec", "qv").alias("dist"))

    w = Window.partitionBy("qid").orderBy("dist", "id")
    # state: every node that a query has met; kept: in its pool; open: to be expanded.
    state = measured(seeds.distinct()).withColumn("rank", F.row_number().over(w)).select("qid", "id", "dist", (F.col("rank") <= pool).alias("kept"), (F.col("rank") <= pool).alias("open"), F.lit(False).alias("expanded"))
    began = mark()
    state = cut(state, "beam")
    for _ in range(max_rounds):
        frontier = state.filter("open")
        if not frontier.limit(1).count():
            break
        reached = frontier.select("qid", "id").join(graph, "id").select("qid", F.explode("neighbors").alias("id")).distinct()
        fresh = measured(reached.join(state.select("qid", "id"), ["qid", "id"], "left_anti"))
        old = state.select("qid", "id", "dist", "kept", F.lit(False).alias("open"), (F.col("expanded") | F.col("open")).alias("expanded"))
        new = fresh.select("qid", "id", "dist", F.lit(True).alias("kept"), F.lit(True).alias("open"), F.lit(False).alias("expanded"))
        both = old.unionByName(new)
        ranked = both.withColumn("rank", F.when(F.col("kept"), F.row_number().over(Window.partitionBy("qid", "kept").orderBy("dist", "id"))))
        inside = F.col("kept") & (F.col("rank") <= pool)
        state = cut(ranked.select("qid", "id", "dist", inside.alias("kept"), (inside & F.col("open")).alias("open"), "expanded"), "beam")
        drop_scratch(queries.sparkSession, began, state)
    else:
        if state.filter("open").limit(1).count():
            raise RuntimeError(f"a search is not done after {max_rounds} rounds")
    out = state.filter(F.col("kept") | (F.lit(path) & F.col("expanded")))
    return out.select("qid", F.row_number().over(w).cast("long").alias("rank"), "id", "dist")
