"""Exact nearest neighbours, the ground truth of everything else.

The base set is handled in blocks of at most ``block_bytes``: each block is broadcast, every partition of queries finds
its best k there with a numpy kernel, and the blocks' results are merged by a ranked window, so neither the driver nor
an executor holds more than one block. Distances never leave the kernels as full rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_rows, nearest
from ..plans.scratch import cut

KNN = "src long, rank long, dst long, dist double"


def vector_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def vectors_of(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The canonical table ``vectors(id, vec)``; rows without id or vector are left out."""
    return embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")


def ranked_ids(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((place, id), n): each id's rank among the sorted ids, from 0 on.

    Dense ids are their own rank. Others are dealt by range, counted by partition, and numbered within partitions; the
    driver sees one count a partition.
    """
    r = vectors.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).head()
    if not r.n:
        return vectors.select(F.col("id").alias("place"), "id"), 0
    if r.lo == 0 and r.hi == r.n - 1:
        return vectors.select(F.col("id").alias("place"), "id"), r.n
    dealt = cut(vectors.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranked-ids")
    counts = sorted((x.part, x["count"]) for x in dealt.groupBy("part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    start = F.create_map(*[F.lit(x).cast(t) for part, n in before.items() for x, t in ((part, "int"), (n, "long"))])
    w = Window.partitionBy("part").orderBy("id")
    return dealt.select((F.element_at(start, F.col("part")) + F.row_number().over(w) - 1).alias("place"), "id"), r.n


def blocks_of(vectors: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges of ids [from, to) that hold at most about ``block_bytes`` each (ids need not be dense)."""
    r = vectors.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.size("vec")).alias("d")).head()
    if not r.n:
        return []
    count = max(1, -(-r.n * (4 * r.d + 8) // block_bytes))
    if count == 1:
        return [(r.lo, r.hi + 1)]
    cuts = vectors.stat.approxQuantile("id", [i / count for i in range(1, count)], 0.01)
    edges = sorted({r.lo, r.hi + 1, *(int(c) for c in cuts)})
    return list(zip(edges, edges[1:]))


def exact_knn(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True, block_bytes: int = 64 << 20, task_pairs: int = 400_000_000) -> DataFrame:
    """(src, rank, dst, dist): the k nearest rows of ``base`` for each row of ``queries`` (both id, vec), by (dist, id).

    Self-matches are excluded by id, not by place, so exact duplicates stay. Queries are dealt anew where their
    partitions would have to measure more than ``task_pairs`` pairs each.
    """
    spark = queries.sparkSession
    parts = []
    blocks = blocks_of(base, block_bytes)
    tasks = -(-queries.count() * base.count() // task_pairs) if blocks else 0
    if tasks > queries.rdd.getNumPartitions():
        queries = queries.repartition(tasks)
    for lo, hi in blocks:
        block = base.filter((F.col("id") >= lo) & (F.col("id") < hi)).select("id", "vec").toArrow()
        ids = block["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        sent = spark.sparkContext.broadcast((ids[order], vector_matrix(block["vec"])[order]))

        def ranked(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            step = max(1, (32 << 20) // (8 * max(1, len(ids))))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    src = b.column(0).to_numpy(zero_copy_only=False)
                    place, dist = nearest(vector_matrix(b.column(1)), matrix, ids, k + exclude_self)
                    dst = ids[place]
                    keep = (dst != src[:, None]) if exclude_self else np.ones(dst.shape, bool)
                    rank = np.cumsum(keep, axis=1)
                    keep &= rank <= k
                    rows = np.nonzero(keep)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(src[rows]), pa.array(rank[keep]), pa.array(dst[keep]), pa.array(dist[keep])], names=["src", "rank", "dst", "dist"])

        parts.append(queries.select("id", "vec").mapInArrow(ranked, KNN))
    if not parts:
        return spark.createDataFrame([], KNN)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else top_k(out, k)


def top_k(rows: DataFrame, k: int, key: str = "src") -> DataFrame:
    """Best k by (dist, dst) of each key; repeated (key, dst) count once."""
    w = Window.partitionBy(key).orderBy("dist", "dst")
    return rows.groupBy(key, "dst").agg(F.min("dist").alias("dist")).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(key, "rank", "dst", "dist")


def adjacency(knn: DataFrame) -> DataFrame:
    """``graph(id, neighbors)`` with neighbours nearest first."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "dst")))
    return knn.groupBy(F.col("src").alias("id")).agg(F.transform(ranked, lambda x: x["dst"]).alias("neighbors"))


def edges(graph: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of a graph; nodes without neighbours give none."""
    return graph.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst"))


def vector_table(vectors: DataFrame, limit_bytes: int = 256 << 20) -> Broadcast | None:
    """Sorted ids and their vectors, sent to every executor, if they fit ``limit_bytes``; else None."""
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).head()
    if r.n * (4 * r.d + 8) > limit_bytes:
        return None
    rows = vectors.select("id", "vec").toArrow()
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return vectors.sparkSession.sparkContext.broadcast((ids[order], vector_matrix(rows["vec"])[order]))


def with_distance(pairs: DataFrame, vectors: DataFrame, table: Broadcast | None = None) -> DataFrame:
    """Add ``dist`` to rows that have (src, dst), by a numpy kernel.

    With a ``table`` of the vectors the step is narrow; without, the vectors are joined by id. Pairs with an id that
    has no vector are left out.
    """
    rest, types = list(pairs.columns), dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in rest) + ", dist double"
    if table is not None:
        at = rest.index("src"), rest.index("dst")

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = table.value
            for r in batches:
                if not r.num_rows or not len(ids):
                    continue
                src, dst = (r.column(i).to_numpy(zero_copy_only=False) for i in at)
                x, y = (np.minimum(np.searchsorted(ids, c), len(ids) - 1) for c in (src, dst))
                known = (ids[x] == src) & (ids[y] == dst)
                if not known.all():
                    r, x, y = r.filter(pa.array(known)), x[known], y[known]
                yield pa.RecordBatch.from_arrays([*r.columns, pa.array(l2_rows(matrix[x], matrix[y]))], names=[*rest, "dist"])

        return pairs.mapInArrow(looked_up, schema)
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("a"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("b"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if r.num_rows:
                x, y = vector_matrix(r.column(len(rest))), vector_matrix(r.column(len(rest) + 1))
                yield pa.RecordBatch.from_arrays([*r.columns[: len(rest)], pa.array(l2_rows(x, y))], names=[*rest, "dist"])

    return pairs.join(a, "src").join(b, "dst").select(*rest, "a", "b").mapInArrow(measured, schema)


def average_distance(knn: DataFrame) -> DataFrame:
    return knn.agg(F.avg("dist").alias("avg_dist"))


def saved(knn: DataFrame) -> DataFrame:
    return cut(knn, "knn")
