"""Written intermediate tables in the folder that driver and executors share, and small helpers of the operators.

Lineage is cut with plain Parquet tables, never with executor-local copies: a lost executor only means that its tasks
are run again from those files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the files (column pruning keeps working on it)."""
    return cut(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str = "doc_id", modulus: int = 5):
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Enough partitions that none has to hold much more than ``rows_per_partition`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))
