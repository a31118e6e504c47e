"""Hash trees over count matrices: equal parts are told by their hashes, and only parts that differ are compared.

A row's hash is SHA-256 of ``i|g:v,g:v,...``; a node's is that of its children, ``number=hash``
by number, joined by commas. A node of level n stands for FAN ** n rows; rows and
nodes without a cell have none. So a tree depends on the matrix alone, and no task holds
more than a row's cells or FAN hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import layout

#: Children of a node; FAN ** LEVELS is more than a matrix's most rows.
FAN, LEVELS = 64, 4


def leaves(counts: DataFrame) -> DataFrame:
    """(sample_id, node, cells, sha256) of level 1, from canonical cells."""
    cells = F.array_sort(F.collect_list(F.struct("g", "v")))
    text = F.concat_ws("|", F.col("i").cast("string"), F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["g"].cast("string"), c["v"].cast("string"))), ","))
    return above(counts.groupBy("sample_id", "i").agg(F.sha2(text, 256).alias("sha256"), F.count("*").alias("cells")).withColumnRenamed("i", "node"))


def above(nodes: DataFrame) -> DataFrame:
    """The next level: (sample_id, node, cells, sha256)."""
    children = F.array_sort(F.collect_list(F.struct("node", "sha256")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["node"].cast("string"), c["sha256"])), ",")
    return nodes.groupBy("sample_id", F.floor(F.col("node") / FAN).alias("parent")).agg(F.sum("cells").alias("cells"), F.sha2(text, 256).alias("sha256")).withColumnRenamed("parent", "node")


def tree(level1: DataFrame) -> DataFrame:
    """(sample_id, level, node, cells, sha256): all levels; the last has one node a sample, its root."""
    out, level = level1.withColumn("level", F.lit(1)), level1
    for n in range(2, LEVELS + 1):
        level = above(level)
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select("sample_id", "level", "node", "cells", "sha256")


def compare(a: DataFrame, b: DataFrame, tree_a: DataFrame, tree_b: DataFrame) -> DataFrame:
    """(sample_id, equal, changed, only_a, only_b, identical, nodes, differing) of two matrices, by their stored trees.

    Samples of one root are done; of the others, level 1 says which nodes differ, and
    only their cells are read and joined. nodes and differing count those of level 1.
    """
    of = lambda t, level, side: t.where(F.col("level") == level).select("sample_id", "node", F.col("cells").alias(f"n{side}"), F.col("sha256").alias(f"h{side}"))
    same = F.col("ha").eqNullSafe(F.col("hb"))
    roots = of(tree_a, LEVELS, "a").join(of(tree_b, LEVELS, "b"), ["sample_id", "node"], "full_outer")
    apart = roots.where(~same).select("sample_id")
    low = [of(t, 1, side).join(apart, "sample_id", "left_semi") for t, side in ((tree_a, "a"), (tree_b, "b"))]
    nodes = low[0].join(low[1], ["sample_id", "node"], "full_outer")
    per = nodes.groupBy("sample_id").agg(F.coalesce(F.sum(F.when(same, F.col("na"))), F.lit(0)).alias("kept"), F.count(F.when(~same, 1)).alias("differing"))
    # Written, so that Spark knows its size: a short list is sent to the cells, and with none they are not read.
    where = materialise(nodes.where(~same).select("sample_id", "node"), "differing")
    of_nodes = lambda m: m.withColumn("node", F.floor(F.col("i") / FAN)).join(where, ["sample_id", "node"], "left_semi")
    cells = layout.compare(of_nodes(a), of_nodes(b))
    count = lambda t, name: t.where("level = 1").groupBy("sample_id").agg(F.count("*").alias(name))
    sizes = count(tree_a, "sa").join(count(tree_b, "sb"), "sample_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = roots.join(per, "sample_id", "left").join(cells, "sample_id", "left").join(sizes, "sample_id", "left")
    equal = F.when(same, F.col("na")).otherwise(zero("kept") + zero("equal"))
    return out.select("sample_id", equal.alias("equal"), *[zero(c).alias(c) for c in ("changed", "only_a", "only_b")], same.alias("identical"), F.greatest(zero("sa"), zero("sb")).alias("nodes"), zero("differing").alias("differing"))
