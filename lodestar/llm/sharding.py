"""Sharding (operator 9): a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of positions. Each shard owns many virtual nodes on it; a row's key is the hash of
its text, so equal texts meet at one position, and the row belongs to the first virtual node clockwise. A shard
takes no more rows than its bound; rows beyond that continue clockwise to the next virtual node whose shard has
room. With ``slack=0`` the bounds are the exact quotas, so row counts differ by one at most.

How it scales: one narrow pass over the texts writes (id, size, crc, key); all later work is on those few bytes
a row. Rows are counted by ring position, and the walk clockwise runs on these counts (as many numbers as the
ring has positions, a parameter). It gives each position a few intervals of ranks with their shard. A row's rank
within its position is found without bringing a position's rows together: positions are cut into cells by a hash
of the id, in as many cells as the fullest position needs, ranks are taken within a cell and the sums of earlier
cells are added. A text that holds a third of all rows is thus spread over many cells; rows of one id that alone would
overfill a cell (repeated or null ids) are salted with the number they were written under.

Defined cases: a null or empty text has size 8 and crc 0; rows with a null id or repeated rows are placed each
for themselves; an empty table gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written


def ring_owners(spark: SparkSession, shards: int, virtual_nodes: int, positions: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; a shard's nodes do not depend on how many shards there are."""
    nodes = spark.range(shards * virtual_nodes).select(
        F.pmod(F.col("id"), F.lit(shards)).alias("shard"),
        F.pmod(F.xxhash64(F.lit("virtual node"), F.pmod(F.col("id"), F.lit(shards)), F.floor(F.col("id") / shards)), F.lit(positions)).alias("position"),
    )
    return sorted((r.position, r.shard) for r in nodes.collect())


def place_counts(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each position the intervals (from rank, to rank, shard, first slot).

    First every position fills the shard that owns it; then what is left over walks clockwise, in ring order.
    """
    room, used = list(bounds), [0] * len(bounds)
    at = [p for p, _ in nodes]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    waiting: list[tuple[int, int, int]] = []

    def take(position: int, rank: int, most: int, shard: int) -> int:
        n = min(most, room[shard])
        if n:
            out.setdefault(position, []).append((rank, rank + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    for position in sorted(counts):
        first = bisect.bisect_left(at, position) % len(nodes)
        n = take(position, 0, counts[position], nodes[first][1])
        if n < counts[position]:
            waiting.append((position, n, first))
    for position, rank, node in waiting:
        left = counts[position] - rank
        while left:
            node = (node + 1) % len(nodes)
            n = take(position, rank, left, nodes[node][1])
            rank, left = rank + n, left - n
    return out


def shard_bounds(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows that each shard takes: its exact share, or (1 + slack) times the mean."""
    if slack:
        return [-int(-(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards: int = 24, virtual_nodes: int = 64, positions: int = 1 << 14, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(positions)).alias("position"),
        F.monotonically_increasing_id().alias("written"),
    )
    keyed = written(keyed, "shard-keys")
    counts = {r.position: r.n for r in keyed.groupBy("position").agg(F.count("*").alias("n")).collect()}  # at most `positions` rows
    rows = sum(counts.values())
    placed = place_counts(counts, ring_owners(spark, shards, virtual_nodes, positions), shard_bounds(rows, shards, slack))

    # Intervals by position as a literal: their number is bounded by positions + shards (each shard fills up once).
    intervals = json.dumps([{"position": p, "parts": [{"lo": a, "hi": b, "shard": s, "slot": f} for a, b, s, f in parts]} for p, parts in sorted(placed.items())])
    schema = "array<struct<position:bigint,parts:array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>>>"
    ring = spark.range(1).select(F.explode(F.from_json(F.lit(intervals), schema)).alias("r")).select("r.position", "r.parts")

    cell_rows = max(1000, rows // (4 * positions))
    cells = max(1, -(-max(counts.values(), default=1) // cell_rows))
    # At most rows / cell_rows ids can overfill a cell on their own: no more than 4 x positions.
    hot = keyed.groupBy(F.col("position").alias("hot_position"), F.col(id_col).alias("hot_id")).agg(F.count("*").alias("times")).filter(F.col("times") > cell_rows)
    same = (F.col("position") == F.col("hot_position")) & F.col(id_col).eqNullSafe(F.col("hot_id"))
    salt = F.when(F.col("times").isNotNull(), F.col("written")).otherwise(0)
    keyed = keyed.join(F.broadcast(hot), same, "left").withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), F.col(id_col), salt), F.lit(cells))).drop("hot_position", "hot_id", "times")
    earlier = Window.partitionBy("position").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("position", "cell").agg(F.count("*").alias("n")).select("position", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("position", "cell").orderBy(id_col, "text_crc32", "size")
    ranked = keyed.drop("written").withColumn("place", F.row_number().over(within) - 1).join(base, ["position", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).join(F.broadcast(ring), "position")
    part = F.filter("parts", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["hi"]))[0]
    return ranked.withColumn("part", part).select(
        F.col(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("rank") - F.col("part.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
