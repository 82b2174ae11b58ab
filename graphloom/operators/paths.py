"""Shortest paths and hop distances by breadth-first search over joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.stage import staged



#: A frontier of up to this many nodes is broadcast (some 50 MB); a larger one is joined.
MOST_BROADCAST = 500_000


def adjacency(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """``(a_label, a_key, rel_type, b_label, b_key)``, each edge both ways, of the given types or all; written out.

    Made once for a graph, it serves any number of searches. No shuffle: parallel edges are left to the searches.
    """
    if types is not None:
        edges = edges.where(F.col("rel_type").isin(*types))
    out = edges.select(F.col("src_label").alias("a_label"), F.col("src_key").alias("a_key"), "rel_type", F.col("tgt_label").alias("b_label"), F.col("tgt_key").alias("b_key"))
    back = edges.select(F.col("tgt_label").alias("a_label"), F.col("tgt_key").alias("a_key"), "rel_type", F.col("src_label").alias("b_label"), F.col("src_key").alias("b_key"))
    return staged(out.unionByName(back), "steps")


def _small(front: DataFrame, size: int) -> DataFrame:
    return F.broadcast(front) if size <= MOST_BROADCAST else front


def _origin(spark: SparkSession, node: tuple[str, str], **more: Column) -> DataFrame:
    return spark.range(1).select(F.lit(node[0]).alias("label"), F.lit(node[1]).alias("key"), *[c.alias(n) for n, c in more.items()])


def hop_distances(edges: DataFrame, start: tuple[str, str], max_hops: int = 4, types: tuple[str, ...] | None = None, steps: DataFrame | None = None) -> DataFrame:
    """``(label, key, hops)`` of the nodes within ``max_hops`` of the start, the start itself at 0.

    ``steps`` is an :func:`adjacency` made before. A hop scans it once, with the frontier broadcast while it is small.
    """
    spark = edges.sparkSession
    steps = adjacency(edges, types) if steps is None else steps
    found = [_origin(spark, start, hops=F.lit(0))]
    front, size = found[0], 1
    for hop in range(1, max_hops + 1):
        own = front.select(F.col("label").alias("a_label"), F.col("key").alias("a_key"))
        after = steps.join(_small(own, size), ["a_label", "a_key"]).select(F.col("b_label").alias("label"), F.col("b_key").alias("key")).distinct()
        seen = reduce(DataFrame.unionByName, found[-2:]).select("label", "key")  # a neighbour is at most one hop nearer
        front = staged(after.join(seen, ["label", "key"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        size = front.count()
        if not size:
            break
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def _extended(front: DataFrame, size: int, steps: DataFrame, seen: list[DataFrame], forward: bool) -> DataFrame:
    """The best path to each node one step beyond a frontier that ``seen``, the last two frontiers, doesn't hold."""
    after = steps.join(_small(front.select(F.col("label").alias("a_label"), F.col("key").alias("a_key"), "nodes", "rels"), size), ["a_label", "a_key"])
    node, rel = F.array("b_key"), F.array("rel_type")
    path = F.struct(F.concat("nodes", node).alias("nodes"), F.concat("rels", rel).alias("rels")) if forward else F.struct(F.concat(node, "nodes").alias("nodes"), F.concat(rel, "rels").alias("rels"))
    best = after.groupBy(F.col("b_label").alias("label"), F.col("b_key").alias("key")).agg(F.min(path).alias("p"))
    old = reduce(DataFrame.unionByName, [s.select("label", "key") for s in seen])
    return staged(best.join(old, ["label", "key"], "left_anti").select("label", "key", "p.nodes", "p.rels"), "front")


def shortest_path(edges: DataFrame, start: tuple[str, str], end: tuple[str, str], max_hops: int = 4, types: tuple[str, ...] | None = None, steps: DataFrame | None = None) -> DataFrame:
    """``(nodes, rels)`` of one shortest path of 1 to ``max_hops`` steps, along edges in either direction.

    Of equally short paths the one with the least array of keys, and of parallel edges the least type; no row if there
    is none or start and end are the same. Searched from both ends, always on from the smaller frontier; the first
    node that both reach lies on a shortest path. Only the best path to each node of a frontier is kept, which is
    enough, as paths through a node are compared by their part before it and then by the rest.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "nodes array<string>, rels array<string>")
    if start == end:
        return none
    steps = adjacency(edges, types) if steps is None else steps
    sides = [[_origin(spark, node, nodes=F.array(F.lit(node[1])), rels=F.array().cast("array<string>"))] for node in (start, end)]
    sizes = [1, 1]
    for _ in range(max_hops):
        side = 0 if sizes[0] <= sizes[1] else 1
        front = _extended(sides[side][-1], sizes[side], steps, sides[side][-2:], side == 0)
        sizes[side] = front.count()
        if not sizes[side]:
            return none
        sides[side].append(front)
        tail = sides[1][-1].select("label", "key", F.col("nodes").alias("__n"), F.col("rels").alias("__r"))
        met = sides[0][-1].join(tail, ["label", "key"]).select(F.concat("nodes", F.slice("__n", 2, max_hops + 1)).alias("nodes"), F.concat("rels", "__r").alias("rels"))
        best = met.agg(F.min(F.struct("nodes", "rels")).alias("p")).where("p IS NOT NULL").select("p.nodes", "p.rels")
        if not best.isEmpty():
            return best
    return none


def best_of(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__i") <= limit).drop("__i")
