"""Centroids, the navigating node, and routing of queries to the nearest midpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2
from .knn import vector_matrix
from .search import beam_search, random_seeds


def centroid_by_dimension(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, value): mean of each dimension in double; every task gives out one sum a key and dimension."""
    types = dict(vectors.dtypes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []
        for b in batches:
            if not b.num_rows:
                continue
            kinds = [f.type for f in b.schema][: len(keys)]
            matrix = vector_matrix(b.column(len(keys))).astype(np.float64)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(len(keys)))) if keys else [()] * b.num_rows):
                places.setdefault(key, []).append(i)
            for key, rows in places.items():
                own = sums.setdefault(key, [np.zeros(matrix.shape[1]), 0])
                own[0] += matrix[rows].sum(0)
                own[1] += len(rows)
        for key, (total, n) in sums.items():
            d = len(total)
            columns = [pa.array([x] * d, t) for x, t in zip(key, kinds)] + [pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, n))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pos", "total", "n"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "pos long, total double, n long"])
    rows = vectors.select(*keys, "vec").mapInArrow(summed, schema)
    return rows.groupBy(*keys, "pos").agg((F.sum("total") / F.sum("n")).alias("value"))


def centroid(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec) with the mean vector."""
    rows = centroid_by_dimension(vectors, *keys)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vec")
    return rows.groupBy(*keys).agg(packed) if keys else rows.agg(packed)


def distance_to_centroid(vectors: DataFrame) -> DataFrame:
    """(id, dist) of every vector; the centroid is one row."""
    c = centroid(vectors).withColumnRenamed("vec", "mean")
    return vectors.join(F.broadcast(c)).select("id", l2("vec", "mean").alias("dist"))


def navigating_node(vectors: DataFrame) -> DataFrame:
    """One row (id, dist): the vector nearest to the centroid, ties by id."""
    return distance_to_centroid(vectors).agg(F.min(F.struct("dist", "id")).alias("m")).select("m.id", "m.dist")


def approximate_navigating_node(vectors: DataFrame, graph: DataFrame, pool: int, seed: int = 42) -> DataFrame:
    """One row (id, dist): the nearest to the centroid that a beam search from random nodes finds on ``graph``."""
    query = centroid(vectors).select(F.lit(0).cast("long").alias("qid"), F.col("vec").cast("array<float>").alias("vec"))
    return beam_search(query, graph, vectors, random_seeds(query, vectors, pool, seed), pool).filter("rank = 1").select("id", "dist")


def route(queries: DataFrame, midpoints: DataFrame) -> DataFrame:
    """(qid, worker, dist): the nearest midpoint of each query; midpoints are as many as workers."""
    packed = midpoints.agg(F.collect_list(F.struct("worker", "vec")).alias("all"))
    best = F.array_min(F.transform("all", lambda m: F.struct(l2(F.col("vec"), m["vec"]).alias("dist"), m["worker"].alias("worker"))))
    return queries.join(F.broadcast(packed)).select("qid", best.alias("b")).select("qid", F.col("b.worker").alias("worker"), F.col("b.dist").alias("dist"))
