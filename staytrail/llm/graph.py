"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest id of its component.

    Stars are taken with a minimum per node (combined before the exchange), which is written, and a join back on the
    node: both sides of it are dealt anew, so that adaptive skew joins can split a hub's rows.  Loops and repeated edges are harmless; no edges give an empty result.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, "edges")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stage(least, "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        root = stage(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        small = (large.join(root, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(root.withColumnRenamed("m", "v")).distinct())
        pairs = stage(small, "small-star")
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
