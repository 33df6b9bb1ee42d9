"""Mixing sources to target weights.

Every source gets a target of words by weight; a target never exceeds ``cap`` times what its source holds, and the
excess goes to the other sources by weight.  Documents get hash-random keys and are range-sorted within their
source; distributed prefix sums of their sizes place the cut at the source's exact budget.  A budget beyond the
source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_bits, hex_bucket, ranked, stage

#: production mix: weights repeat over the sources in code point order; all targets together are SHARE times the
#: words there are; no target is above CAP times its source
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), (3, 2), 2, "mix-1"


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """A reproducible key: rows of one source come in an order that nothing but the id and the seed decides."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def source_key(source_col: str = "source") -> Column:
    """Never null, ordered by code point with null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(sk, source_size, target) from one row a source (sk, source_size).

    Each round is one aggregate: sources whose share by weight exceeds their cap are set to it, the rest share what
    is left; the set only grows, so the rounds end.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = stage(ranked(sizes, ["sk"], "_rank", "sources").withColumn("w", w.cast("long")), "weights")
    num, den = share
    total = table.agg(F.sum("source_size")).first()[0] or 0
    top = F.col("source_size") * cap
    level, capped, held = 0.0, F.lit(False), None
    while True:
        full, weight = table.agg(F.sum(F.when(capped, top).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("w")))).first()
        if not weight or (full, weight) == held:
            level = level if weight else float("inf")
            break
        held = (full, weight)
        level = float(num * total - den * full) / float(den * weight)
        capped = F.col("w") * F.lit(level) > top
    target = top.cast("double") if level == float("inf") else F.when(capped, top.cast("double")).otherwise(F.col("w") * F.lit(level))
    return table.select("sk", "source_size", target.cast("double").alias("target"))


def mix(keyed: DataFrame, whole: bool = False, **parameters) -> DataFrame:
    """``keyed`` (sk, size, key, tie and any other columns) with source_size, target, copies and taken.

    ``taken`` counts the words the mix takes from the row, repeats counted.  By default the row at the cut gives
    only the words that are left, so that a source's words are its target rounded down; with ``whole`` it is taken
    in full if at least half of it fits.  ``copies`` is how often the row appears, the cut one included.
    """
    spark = keyed.sparkSession
    bits = min(12, bucket_bits(spark, 12))
    rows = keyed.withColumn("_b", hex_bucket("key", bits))
    buckets = stage(rows.groupBy("sk", "_b").agg(F.sum("size").alias("s")), "buckets")
    targets = source_targets(buckets.groupBy("sk").agg(F.sum("s").alias("source_size")), **parameters)
    before = buckets.withColumn("_before", F.sum("s").over(Window.partitionBy("sk").orderBy("_b")) - F.col("s")).drop("s")
    placed = before.join(targets, "sk")
    start = F.col("_before") - F.col("size") + F.sum("size").over(
        Window.partitionBy("sk", "_b").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    budget = F.floor("target")
    rest = F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0)
    epochs = F.when(F.col("source_size") > 0, (budget - rest) / F.col("source_size")).otherwise(0).cast("long")
    mixed = rows.join(placed, ["sk", "_b"]).withColumn("_start", start).withColumn("_epochs", epochs).withColumn("_rest", rest)
    if whole:
        part = F.when(2 * F.col("_start") + F.col("size") <= 2 * F.col("_rest"), F.col("size"))
        part = F.when(F.col("_rest") > 0, part)
    else:
        part = F.least(F.col("size"), F.col("_rest") - F.col("_start"))
        part = F.when(part > 0, part)
    return (mixed.withColumn("copies", (F.col("_epochs") + F.when(part.isNull(), 0).otherwise(1)).cast("int"))
            .withColumn("taken", (F.col("_epochs") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long"))
            .drop("_b", "_before", "_start", "_epochs", "_rest"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Per row of ``docs``: doc_id, size (words; null text: 0), source_size, target, taken.

    Rows with a null source form the last source.  A source without words has target 0.  Rows with equal ids come
    in the order of their texts' digests; equal rows may swap.  An empty table gives an empty result; further
    columns are ignored.
    """
    keyed = stage(docs.select("doc_id", word_count().alias("size"), source_key().alias("sk"), random_key().alias("key"),
                              F.xxhash64("text").alias("tie")), "mix")
    return mix(keyed, **parameters).select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with their columns unchanged.

    Documents stay whole; nulls, ties and empty tables as in ``mix_documents``.
    """
    keyed = docs.select(word_count().alias("size"), source_key().alias("sk"), random_key().alias("key"),
                        F.xxhash64("text").alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    mixed = mix(keyed, whole=True, **parameters).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
