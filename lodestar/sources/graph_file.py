"""Binary graph files: int32 navigating node (-1: none), then for each node its id, degree and neighbours, all int32 little-endian.

The format has no fixed records, so a file is decoded in one pass; graphs meant for further use are kept as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vecs import head_bytes, write_file

GRAPH = "id long, neighbors array<long>"


def decode_graph(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(id, neighbours) of a file's content; every neighbour of every node."""
    words, at = np.frombuffer(data, "<i4"), 1
    while at < len(words):
        degree = int(words[at + 1])
        if at + 2 + degree > len(words):
            raise ValueError("the graph file ends within a node")
        yield int(words[at]), words[at + 2 : at + 2 + degree]
        at += 2 + degree


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """``graph(id, neighbors)`` and the navigating node."""
    nav = int(np.frombuffer(head_bytes(spark, path, 4), "<i4")[0])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(decode_graph(data))
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1].tolist() for r in part], pa.list_(pa.int64()))], names=["id", "neighbors"])

    graph = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, GRAPH)
    return graph, None if nav < 0 else nav


def write_graph(graph: DataFrame, path: str, nav_node: int | None = None) -> None:
    """One file in id order; partitions pass through the driver one at a time."""
    ordered = graph.select(F.col("id"), "neighbors").orderBy("id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array([i, len(n), *n], "<i4").tobytes() for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(rows)], pa.binary())], names=["bytes"])

    def chunks() -> Iterator[bytes]:
        yield np.array([-1 if nav_node is None else nav_node], "<i4").tobytes()
        for r in ordered.mapInArrow(encoded, "bytes binary").toLocalIterator():
            yield bytes(r[0])

    write_file(graph.sparkSession, path, chunks())
