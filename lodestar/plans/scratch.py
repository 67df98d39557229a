"""Intermediate tables in the folder shared by the driver and all executors (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that ``cut`` has written, for ``drop_scratch``.
_PATHS: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark runs in one process, a folder below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` and scan it again: ends the lineage of iterative plans and survives lost executors."""
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


class Growing:
    """A table that is written part by part and read by one scan of all parts."""

    def __init__(self, spark: SparkSession, schema: str, label: str = "growing"):
        self.spark, self.schema, self.label, self.paths = spark, schema, label, []

    def append(self, df: DataFrame) -> DataFrame:
        """Write a part and return a scan of it."""
        path = f"{scratch_folder(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        _PATHS.append(path)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


def mark() -> int:
    """A point in the list of scratch tables, for ``drop_scratch``."""
    return len(_PATHS)


def drop_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what has been written since a mark; to be called once no result that reads it is needed. Returns how many.

    ``keep``: a table from ``cut`` that stays. Loops drop their earlier rounds by this, each round's table being whole.
    """
    kept = getattr(keep, "scratch_path", None)
    gone = [p for p in _PATHS[since:] if p != kept]
    _PATHS[since:] = [p for p in _PATHS[since:] if p == kept]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)
