"""Reachability from the navigating node, spanning trees, and repair of unreached nodes.

The search is a frontier loop: each round joins the frontier with the edges, takes the smallest parent of each new node and
leaves out nodes reached before. A level is written once; the tree is one scan of all levels, so no round's plan grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Growing, cut, drop_scratch, mark
from .search import beam_search, seeds_at

TREE = "child long, parent long, depth long"


def spanning_tree(edges: DataFrame, root: int) -> DataFrame:
    """(child, parent, depth) of breadth-first search; the root is its own parent at depth 0."""
    return extended_tree(edges, edges.sparkSession.createDataFrame([(root, root, 0)], TREE), None)


def extended_tree(edges: DataFrame, first: DataFrame, reached: DataFrame | None) -> DataFrame:
    """``reached`` and what can be reached from the rows ``first`` (both like a tree) beyond it, level by level."""
    tree = Growing(edges.sparkSession, TREE, "tree")
    if reached is not None:
        tree.append(reached)
    level = tree.append(first)
    while level.limit(1).count():
        met = level.join(edges, level["child"] == edges["src"]).select(F.col("dst").alias("child"), F.struct((F.col("depth") + 1).alias("depth"), F.col("src").alias("parent")).alias("by"))
        step = met.groupBy("child").agg(F.min("by").alias("by")).select("child", "by.parent", "by.depth")
        level = tree.append(step.join(tree.table().select("child"), "child", "left_anti").select("child", "parent", "depth"))
    return tree.table()


def unreached(vectors: DataFrame, tree: DataFrame) -> DataFrame:
    """(id) of vectors outside the tree."""
    return vectors.select("id").join(tree.select(F.col("child").alias("id")), "id", "left_anti")


def sources(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): the nodes of ``ids`` that no smaller one of them reaches within ``ids``; every other is reached from one of these."""
    ids = cut(ids, "unreached")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    inside = cut(inside, "inside")
    began = mark()
    label = cut(ids.select("id", F.col("id").alias("least"), F.lit(True).alias("moved")), "labels")
    while label.filter("moved").limit(1).count():
        told = label.filter("moved").join(inside, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("told"))
        better = F.coalesce(F.col("told") < F.col("least"), F.lit(False))
        label = cut(label.join(told, "id", "left").select("id", F.when(better, F.col("told")).otherwise(F.col("least")).alias("least"), better.alias("moved")), "labels")
        drop_scratch(edges.sparkSession, began, label)
    return label.filter("id = least").select("id")


def repair(graph: DataFrame, vectors: DataFrame, nav_node: int, pool: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, tree, added edges): unreached nodes are joined to the nearest node that a search from ``nav_node`` finds.

    Only nodes that no smaller unreached one reaches need an edge: the very nodes that joining one node after another,
    smallest id first, would take. All of them are searched for at once, on the graph as it is.
    """
    spark = graph.sparkSession
    edges = cut(graph.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst")), "edges")
    tree = spanning_tree(edges, nav_node)
    rest = unreached(vectors, tree)
    if not rest.limit(1).count():
        return graph, tree, spark.createDataFrame([], "src long, dst long")
    queries = vectors.join(sources(edges, rest), "id", "left_semi").select(F.col("id").alias("qid"), "vec")
    found = beam_search(queries, graph, vectors, seeds_at(queries, nav_node), pool).filter("rank = 1")
    added = cut(found.select(F.col("id").alias("src"), F.col("qid").alias("dst")), "added")
    first = added.join(tree.select(F.col("child").alias("src"), "depth"), "src").select(F.col("dst").alias("child"), F.col("src").alias("parent"), (F.col("depth") + 1).alias("depth"))
    return cut(with_edges(graph, added), "graph"), extended_tree(edges, first, tree), added


def with_edges(graph: DataFrame, new: DataFrame) -> DataFrame:
    """Append edges to adjacency lists."""
    more = new.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("more"))
    return graph.join(more, "id", "left").select("id", F.when(F.col("more").isNull(), F.col("neighbors")).otherwise(F.array_union("neighbors", "more")).alias("neighbors"))
