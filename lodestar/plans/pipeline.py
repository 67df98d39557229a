"""Index building from vectors to a connected navigable graph, its persistence, searching and the recall sweep.

``build_index`` works on tables; ``run_config`` does all that an ``IndexConfig`` names: it reads the vector file, reuses or
saves both graphs, places the vectors, and sweeps over the queries.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..operators import centroid, connect, evaluate, knn, nndescent, nsg, redistribute, search
from ..sources import graph_file, vecs
from .scratch import cut


@dataclass
class Index:
    vectors: DataFrame
    graph: DataFrame
    nav_node: int
    tree: DataFrame | None = None
    info: dict = field(default_factory=dict)

    def search(self, queries: DataFrame, pool: int) -> DataFrame:
        """(qid, rank, id, dist): up to ``pool`` nearest found from the navigating node."""
        return search.beam_search(queries, self.graph, self.vectors, search.seeds_at(queries, self.nav_node), pool)

    def save(self, path: str) -> None:
        """Distributed Parquet; the navigating node is a table of one row."""
        spark = self.graph.sparkSession
        self.graph.write.mode("overwrite").parquet(f"{path}/graph")
        spark.createDataFrame([(self.nav_node,)], "nav_node long").write.mode("overwrite").parquet(f"{path}/nav_node")

    def metrics(self) -> DataFrame:
        """(name, value): seconds of each stage, rounds, repairs, and sizes of the graph."""
        spark = self.graph.sparkSession
        r = self.graph.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.size("neighbors")), F.lit(0)).alias("edges")).head()
        rows = [*self.info.items(), ("nodes", r.nodes), ("edges", r.edges)]
        return spark.createDataFrame([(name, float(value)) for name, value in rows], "name string, value double")

    @classmethod
    def load(cls, spark: SparkSession, path: str, vectors: DataFrame) -> Index:
        nav = spark.read.parquet(f"{path}/nav_node").head()[0]
        return cls(vectors, spark.read.parquet(f"{path}/graph"), nav)


def build_aknng(vectors: DataFrame, config: IndexConfig) -> tuple[DataFrame, int]:
    """The approximate neighbour graph as (src, rank, dst, dist), and the rounds used."""
    return nndescent.nn_descent(vectors, config.k, config.pre_nndescent_k, config.max_nndescent_iterations, config.max_reverse_neighbors_nndescent, config.strict_initial_radius, config.seed)


def build_nsg(vectors: DataFrame, aknng: DataFrame, nav_node: int, config: IndexConfig) -> DataFrame:
    """Path searches from the navigating node for every vector, occlusion pruning, reversed edges."""
    everyone = vectors.select(F.col("id").alias("qid"), "vec")
    paths = search.beam_search(everyone, aknng, vectors, search.seeds_at(everyone, nav_node), config.candidate_queue_size_nsg, path=True)
    chosen = nsg.select_edges(paths.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"), vectors, config.max_reverse_neighbors_nsg, config.max_neighbor_candidates)
    return nsg.navigable_graph(chosen, vectors, config.edge_direction)


@contextmanager
def _timed(info: dict, name: str) -> Iterator[None]:
    start = time.perf_counter()
    yield
    info[f"{name}_seconds"] = round(time.perf_counter() - start, 3)


def build_index(vectors: DataFrame, config: IndexConfig, aknng: DataFrame | None = None) -> Index:
    """An index of ``vectors(id, vec)``; ``aknng``: a neighbour graph (id, neighbors) made before."""
    info: dict = {}
    with _timed(info, "vectors"):
        vectors = cut(vectors.select("id", "vec").repartitionByRange("id"), "vectors")
    with _timed(info, "aknng"):
        if aknng is None:
            pairs, info["rounds"] = build_aknng(vectors, config)
            aknng = knn.adjacency(pairs)
        lists = aknng.select("id", "neighbors")
        aknng = cut(vectors.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors")), "aknng")
    with _timed(info, "navigating_node"):
        nav = (centroid.approximate_navigating_node(vectors, aknng, config.candidate_queue_size_knng, config.seed) if config.approximate_navigating_node else centroid.navigating_node(vectors)).head().id
    with _timed(info, "nsg"):
        graph = cut(build_nsg(vectors, aknng, nav, config), "nsg")
    with _timed(info, "repair"):
        graph, tree, added = connect.repair(graph, vectors, nav, config.candidate_queue_size_knng)
    info["repairs"] = added.count()
    return Index(vectors, graph, nav, tree, info)


def run_config(spark: SparkSession, config: IndexConfig) -> tuple[Index, DataFrame | None]:
    """(index, recall sweep or None) by the files that the settings name.

    ``input_file``: vectors (.fvecs; ``lines`` limits them). ``nsg_file``, ``aknng_file``: graph files that are read if
    they are there, else written. ``query_file`` and ``query_result_file``: queries and their true neighbours.
    """
    vectors = vecs.read_fvecs(spark, config.input_file, config.lines)
    if config.nsg_file and vecs.exists(spark, config.nsg_file):
        graph, nav = graph_file.read_graph(spark, config.nsg_file)
        graph = cut(graph, "nsg")
        index = Index(cut(vectors, "vectors"), graph, nav, connect.spanning_tree(cut(knn.edges(graph), "edges"), nav))
    else:
        known = bool(config.aknng_file) and vecs.exists(spark, config.aknng_file)
        aknng, rounds = graph_file.read_graph(spark, config.aknng_file)[0] if known else None, 0
        if aknng is None and config.aknng_file:
            pairs, rounds = build_aknng(vectors, config)
            aknng = cut(knn.adjacency(pairs), "aknng")
            graph_file.write_graph(aknng, config.aknng_file)
        index = build_index(vectors, config, aknng)
        index.info.setdefault("rounds", rounds)
        if config.nsg_file:
            graph_file.write_graph(index.graph, config.nsg_file, index.nav_node)
    if not (config.query_file and config.query_result_file):
        return index, None
    queries, truth = vecs.read_queries(spark, config.query_file, config.query_result_file)
    return index, sweep(index, queries, truth, config)


def distribute(index: Index, config: IndexConfig) -> tuple[DataFrame, DataFrame]:
    """(assignment, replicas) of an index by its spanning tree; without redistribution, by ranges of the ids' ranks."""
    if config.data_redistribution == "noRedistribution":
        placed = redistribute.by_ranges(index.vectors, config.workers)
    else:
        placed = redistribute.assignment(index.tree, config.workers, index.vectors, config.data_redistribution)
    return placed, redistribute.replicate(index.tree, placed, config.workers, config.data_replication)


def sweep(index: Index, queries: DataFrame, truth: DataFrame, config: IndexConfig) -> DataFrame:
    """(pool, queries, first_hits, correct, precision, recall) for growing pools, from the truth's length on."""
    k = truth.agg(F.max("rank")).head()[0]
    pools = [k + i * config.candidate_queue_increase_by for i in range(config.candidate_queue_increases + 1)]
    found = search.search_pools(queries, index.graph, index.vectors, search.seeds_at(queries, index.nav_node), pools)
    return evaluate.recall_metrics(found, truth, k, pools)
