"""Search quality against exact neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_metrics(found: DataFrame, truth: DataFrame, k: int, pools: list[int] | None = None) -> DataFrame:
    """One row: queries, first_hits, correct (of the whole pool), precision, recall (of the best k).

    ``found``, ``truth``: (qid, rank, id). precision counts true neighbours anywhere in the pool; recall only among
    the first k found. ``pools``: ``found`` has a column pool with these values, and each gives a row.
    """
    t = truth.filter(F.col("rank") <= k).select("qid", "id", F.col("rank").alias("true_rank"))
    if pools is None:
        hit, by = t.join(found.select("qid", "id", "rank"), ["qid", "id"], "left"), []
    else:
        t = t.withColumn("pool", F.explode(F.array(*[F.lit(p).cast("long") for p in pools])))
        hit, by = t.join(found.select("pool", "qid", "id", "rank"), ["pool", "qid", "id"], "left"), ["pool"]
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = hit.groupBy(*by).agg(
        F.countDistinct("qid").alias("queries"),
        one((F.col("true_rank") == 1) & (F.col("rank") == 1)).alias("first_hits"),
        one(F.col("rank").isNotNull()).alias("correct"),
        one(F.col("rank") <= k).alias("correct_k"),
    )
    all_ = F.col("queries") * k
    return out.select(*by, "queries", "first_hits", "correct", (F.col("correct") / all_).alias("precision"), (F.col("correct_k") / all_).alias("recall"))
