"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges stay in a DataFrame; each round is written to the shared folder, so lineage stays short and a lost executor
costs one round. Every aggregation is a minimum, which is combined before the shuffle, so a node with very many
neighbours is no burden there. In the joins, rows of nodes with more than ``HUB_SHARE`` of all rows meet their node's
minimum by broadcast (there are at most 1 / ``HUB_SHARE`` such nodes), all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import drop_scratch, mark
from .storage import written

#: A node is a hub if it has more than this share of all rows (and more than ``HUB_ROWS``).
HUB_SHARE, HUB_ROWS = 1e-4, 100


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0)).alias("h"), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))), F.lit(0)).alias("g")).head()
    return r.n, r.h, r.g


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: int, hub_share: float = HUB_SHARE) -> DataFrame:
    """``rows`` beside what ``groups`` (key, degree, ...) says of their key; no task gets a large group's rows to itself.

    ``degree``: how many of the at most ``n`` rows have the key. At most 1 / ``hub_share`` keys are joined by broadcast.
    """
    bound = max(HUB_ROWS, int(n * hub_share))
    if n <= bound:
        return rows.join(groups.drop("degree"), key)
    hubs = F.broadcast(written(groups.filter(F.col("degree") > bound).drop("degree"), "hubs"))
    rest = rows.join(hubs.select(key), key, "left_anti").join(groups.filter(F.col("degree") <= bound).drop("degree"), key)
    return rows.join(hubs, key).unionByName(rest)


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the smallest v of each u as column m."""
    return join_groups(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "u", 2 * edges)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v; any order, loops and repeats allowed).

    ``root`` is the smallest node of the component; roots themselves are not listed.
    """
    began = mark()
    star = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _mark(star)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # Large star: every larger neighbour is linked to the smallest of the closed neighbourhood.
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, before[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: every node and its smaller neighbours are linked to the smallest of them.
        large = written(large, "large-star")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _with_least(large, before[0]).select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        star = written(small, "edges")
        drop_scratch(edges.sparkSession, began, star)
        after = _mark(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
