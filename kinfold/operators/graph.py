"""Connected components of an undirected edge table, as joins and aggregates.

Alternating large-star and small-star steps: every node is hung under the least
neighbour seen, first among the larger ones, then among the smaller ones, until
each component is a star around its least node. The number of rounds grows with
the logarithm of the node count. Minima are pre-aggregated on the map side and
hot nodes meet only in joins, whose skewed partitions adaptive execution splits;
no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, settle


def named_components(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node, component) for every node of ``nodes``, named by text; ``component`` is one key for each component.

    Rounds carry 64-bit hashes of the names, not the names. Whether two names share a hash is looked up first; in that
    (unlikely) case the names themselves are carried.
    """
    short = settle(edges.select(F.xxhash64(src).alias("src"), F.xxhash64(dst).alias("dst"), F.col(src).alias("a"), F.col(dst).alias("b")), "named-edges")
    own = nodes.select(F.col(node).alias("node")).distinct()
    names = short.select(F.col("a").alias("node")).union(short.select(F.col("b").alias("node"))).union(own).distinct()
    clash = names.groupBy(F.xxhash64("node").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    if clash.isEmpty():
        found = connected_components(short).withColumnRenamed("node", "key")
        return own.withColumn("key", F.xxhash64("node")).join(found, "key", "left").select("node", F.coalesce("component", "key").alias("component"))
    found = connected_components(short.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge between two different non-null nodes;
    ``component`` is the least node. Repeated edges, self loops and nulls are allowed and
    add nothing. An empty edge table gives an empty result."""
    a, b = F.col(src), F.col(dst)
    e = settle(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
