"""Masked softmax pooling of vectors per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join

MASKED_SCORE = -1e9


def masked_softmax_pool(df: DataFrame, group: str, score: str, vector: str, mask: str) -> tuple[DataFrame, DataFrame]:
    """Softmax of the scores within each group (masked rows get -1e9, so weight
    ~0) and the weighted sum of the vectors.

    Returns (pooled(group, dim, pooled), weights(<input columns>, weight)).
    The largest score of a group is a hash aggregate that ``lookup_join`` brings
    back without moving the vectors; the pooled vector is sum(e * x) / sum(e) in
    one aggregate per (group, dimension), so a large group is combined map-side.
    Only ``weights`` looks the normaliser up again.
    """
    d = df.withColumn("_s", F.when(F.col(mask), F.col(score)).otherwise(F.lit(MASKED_SCORE)))
    d = lookup_join(d, d.groupBy(group).agg(F.max("_s").alias("_mx")), group, "inner")
    d = d.withColumn("_e", F.exp(F.col("_s") - F.col("_mx")))
    pooled = (d.select(group, "_e", F.posexplode(vector).alias("dim", "_x")).groupBy(group, "dim")
              .agg((F.sum(F.col("_e") * F.col("_x")) / F.sum("_e")).alias("pooled")))
    z = d.groupBy(group).agg(F.sum("_e").alias("_z"))
    weights = lookup_join(d, z, group, "inner").withColumn("weight", F.col("_e") / F.col("_z"))
    return pooled, weights.select(*df.columns, "weight")
