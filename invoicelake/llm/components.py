"""Connected components by alternating large-star and small-star steps on a table of links.

Each step is one grouped minimum and one join on the node, and is written to the shared folder; the number of steps
grows with the logarithm of a component's diameter. After a few steps a component's least node holds all its links: links of such
nodes are dealt out over many tasks. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, salted_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v), u > v. Large: the greater neighbours of each node link to the least of its closed neighbourhood.
    Small: its lesser neighbours and itself do."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = hot_keys(least, ["u"], 2 * total)
    least = least.select("u", F.least("m", "u").alias("m") if large else "m")
    both = salted_join(near, least, ["u"], hot, F.xxhash64("v"))
    if large:
        out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b), in any order, repeats and self-links allowed -> (node, component): the least node reachable, for each node
    with a link to another. Nulls link nothing; no links give no rows."""
    edges = scratch.store(
        links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    )
    mark = _print_of(edges)
    while mark[0]:
        large = scratch.store(_star(edges, True, mark[0]))
        small = scratch.store(_star(large, False, 2 * mark[0]))
        scratch.drop(edges, large)
        edges, before = small, mark
        mark = _print_of(edges)
        if mark == before:
            break
    return scratch.store(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("c")).distinct().toDF("node", "component")))
