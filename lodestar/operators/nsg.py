"""Occlusion pruning and the navigable graph that follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_rows


def occlusion_choice(dist: np.ndarray, vecs: np.ndarray, limit: int) -> list[int]:
    """Greedy scan of candidates, nearest first: a candidate is taken unless one taken before is no farther from it than the query is.

    The candidate must also lie no nearer to the query than the taken one, which the order implies.
    """
    taken: list[int] = []
    for i in range(len(dist)):
        if len(taken) >= limit:
            break
        if not taken or (l2_rows(vecs[taken], vecs[i][None, :]) > dist[i]).all():
            taken.append(i)
    return taken


def select_edges(candidates: DataFrame, vectors: DataFrame, limit: int, most: int) -> DataFrame:
    """(src, dst, dist): the chosen of each node's best ``most`` candidates (src, dst, dist); self is excluded by id.

    A node's candidates are at most ``most``, so the groups that are brought together are bounded.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy("dist", "dst")
    ranked = candidates.filter("src <> dst").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    ranked = ranked.join(vectors.select(F.col("id").alias("dst"), "vec"), "dst")
    lists = ranked.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist", "vec"))).alias("c"))
    lists = lists.select("src", F.transform("c", lambda x: x["dst"]).alias("dst"), F.transform("c", lambda x: x["dist"]).alias("dist"), F.flatten(F.transform("c", lambda x: x["vec"])).alias("flat"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst, dist = [], [], []
            for s, ids, d, flat in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                ids, d = ids.values.to_numpy(), d.values.to_numpy()
                vecs = flat.values.to_numpy().reshape(len(ids), -1)
                take = occlusion_choice(d, vecs, limit)
                src += [s] * len(take)
                dst.append(ids[take])
                dist.append(d[take])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(np.concatenate(dst)), pa.array(np.concatenate(dist))], names=["src", "dst", "dist"])

    return lists.mapInArrow(chosen, "src long, dst long, dist double")


def reversed_edges(chosen: DataFrame) -> DataFrame:
    """Every choice becomes an edge towards the node that chose: in-degrees are bounded, out-degrees are not."""
    return chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def navigable_graph(chosen: DataFrame, vectors: DataFrame, direction: str = "reversed") -> DataFrame:
    """``graph(id, neighbors)`` with a row for every vector; neighbours by id."""
    rows = reversed_edges(chosen) if direction == "reversed" else chosen.select("src", "dst")
    lists = rows.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))
    return vectors.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def degrees(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every vector."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0).cast("long")
    return vectors.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))


