"""``.fvecs`` and ``.ivecs`` files: records of a little-endian int32 length and as many float32 or int32 values.

Reading is split by records through Hadoop's fixed-length input format, whose key is the ordinal of a record, so any
store that Spark reads will do and ids need no extra pass. Only the first record's length is read beforehand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, by Hadoop's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(x & 0xFF for x in (stream.read() for _ in range(n)) if x >= 0)
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _records(spark: SparkSession, path: str, kind: str, lines: int, name: str) -> DataFrame:
    first = head_bytes(spark, path, 4)
    sql_type = f"array<{'float' if kind == '<f4' else 'int'}>"
    if len(first) < 4:
        return spark.createDataFrame([], f"id long, {name} {sql_type}")
    dim = struct.unpack("<i", first)[0]
    rows = spark.sparkContext.newAPIHadoopFile(path, FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{FORMAT}.recordLength": str(4 * (dim + 1))})
    raw = spark.createDataFrame(rows.map(lambda r: (r[0], bytes(r[1]))), "id long, record binary")
    if lines > 0:
        raw = raw.filter(F.col("id") < lines)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, dim + 1)
            if (words[:, 0] != dim).any():
                raise ValueError(f"{path}: records of different lengths")
            values = np.ascontiguousarray(words[:, 1:]).view(kind).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", name])

    return raw.mapInArrow(decoded, f"id long, {name} {sql_type}")


def read_fvecs(spark: SparkSession, path: str, lines: int = 0) -> DataFrame:
    """``vectors(id, vec)``; ``lines`` > 0 keeps the records with smaller ordinals."""
    return _records(spark, path, "<f4", lines, "vec")


def read_ivecs(spark: SparkSession, path: str, lines: int = 0) -> DataFrame:
    """``(id, values)``."""
    return _records(spark, path, "<i4", lines, "values")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``truth(qid, rank, id)`` with ranks from 1."""
    return read_ivecs(spark, path).select(F.col("id").alias("qid"), F.posexplode("values").alias("pos", "v")).select("qid", (F.col("pos") + 1).cast("long").alias("rank"), F.col("v").cast("long").alias("id"))


def read_queries(spark: SparkSession, query_path: str, truth_path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and truth of the records that both files have."""
    queries = read_fvecs(spark, query_path).select(F.col("id").alias("qid"), "vec")
    truth = read_truth(spark, truth_path)
    return queries.join(truth.select("qid").distinct(), "qid", "left_semi"), truth.join(queries.select("qid"), "qid", "left_semi")


def write_file(spark: SparkSession, path: str, chunks: Iterator[bytes]) -> None:
    """One file from chunks, through Hadoop's file systems (an existing file is replaced)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for chunk in chunks:
            stream.write(bytearray(chunk))
    finally:
        stream.close()


def _write_vecs(rows: DataFrame, column: str, order: str, kind: str, path: str) -> None:
    packed = rows.select(order, column).orderBy(order)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = [struct.pack("<i", len(v)) + np.asarray(v, kind).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], names=["bytes"])

    write_file(rows.sparkSession, path, (bytes(r[0]) for r in packed.mapInArrow(encoded, "bytes binary").toLocalIterator()))


def write_fvecs(vectors: DataFrame, path: str) -> None:
    """One file of ``vectors(id, vec)`` in id order; partitions pass through the driver one at a time."""
    _write_vecs(vectors, "vec", "id", "<f4", path)


def write_ivecs(rows: DataFrame, path: str) -> None:
    _write_vecs(rows, "values", "id", "<i4", path)
