"""Sharding by minimax contiguous partition.

Rows come in atomic groups; groups have an order.  The smallest capacity for which a greedy left-to-right fill needs
no more than the given number of shards is found by bisection, and the order is cut where that fill cuts.  Group
sizes become distributed prefix sums, written in range order; a greedy step for many candidate capacities at once
is one aggregate over a narrow range of that table, so that only a few numbers ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, hex_bucket, shuffle_partitions, stage, text_or_empty

#: capacities tried in one pass; the interval shrinks by this factor a round
TRIED = 32
#: group of a null text; sorts after every SHA-256
NULL_GROUP = "g" * 64


def prefix_sums(keyed: DataFrame) -> DataFrame:
    """(g, end): the groups' sizes summed in the order of ``g``, a hexadecimal digest, written in that order."""
    spark = keyed.sparkSession
    bits = bucket_bits(spark)
    bucket = F.when(F.col("g") == NULL_GROUP, F.lit(1 << bits)).otherwise(hex_bucket("g", bits))
    groups = stage(keyed.groupBy("g").agg(F.sum("size").alias("gsize")).withColumn("b", bucket), "groups")
    before = groups.groupBy("b").agg(F.sum("gsize").alias("s")).withColumn(  # at most 2**16 + 1 rows
        "before", F.sum("s").over(Window.orderBy("b")) - F.col("s")).drop("s")
    ordered = groups.repartitionByRange(shuffle_partitions(spark), "b").join(F.broadcast(before), "b")
    inside = F.sum("gsize").over(Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return stage(ordered.select("g", "gsize", (F.col("before") + inside).alias("end")), "ends")


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest feasible capacity, the last group of each shard but the last used one)."""
    total, largest = ends.agg(F.max("end"), F.max("gsize")).first()
    if not total:
        return 0, []

    def step(targets: list[int]) -> list[int]:
        """For each target, the largest prefix sum that does not exceed it."""
        todo = sorted({t for t in targets if t < total})
        if not todo:
            return [total] * len(targets)
        near = ends.filter((F.col("end") > todo[0] - largest) & (F.col("end") <= todo[-1]))
        found = near.agg(*(F.max(F.when(F.col("end") <= t, F.col("end"))) for t in todo)).first()
        at = {t: x or 0 for t, x in zip(todo, found)}
        return [at.get(t, total) for t in targets]

    def fill(capacities: list[int]) -> list[list[int]]:
        """The greedy cuts for each capacity."""
        cuts: list[list[int]] = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(shards):
            at = step([a + c for a, c in zip(at, capacities)])
            for c, a in zip(cuts, at):
                c.append(a)
            if min(at) == total:
                break
        return cuts

    low = max(largest, -(-total // shards))  # no smaller capacity can do
    high = -(-total // shards) + largest  # this one always does
    while low < high:
        tried = sorted({low + (high - low) * i // TRIED for i in range(TRIED)})
        fits = [c[-1] == total for c in fill(tried)]
        k = fits.index(True) if True in fits else len(tried)
        low, high = (tried[k - 1] + 1 if k else low), (tried[k] if k < len(tried) else high)
    cuts = sorted({c for c in fill([low])[0] if c < total})
    keys = {r["end"]: r["g"] for r in ends.filter(F.col("end").isin(cuts)).select("end", "g").collect()} if cuts else {}
    return low, [keys[c] for c in cuts]


def place(keyed: DataFrame, cuts: list[str], order: list[str]) -> DataFrame:
    """``keyed`` with ``shard`` (by the cuts) and ``slot`` (gapless from 0 in a shard).

    Positions are counted in two levels, by hash of the row's order columns, so that neither a shard nor a group of
    copies is numbered in one task.  Equal rows may swap slots.
    """
    shard = sum((F.when(F.col("g") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    parts = min(4096, shuffle_partitions(keyed.sparkSession))
    rows = keyed.withColumn("shard", shard).withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))  # at most shards * 4096 rows
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy(*order))
    return (rows.join(F.broadcast(before), ["shard", "_sub"])
            .withColumn("slot", (F.col("_before") + number - 1).cast("long")).drop("_sub", "_before"))


def group_of(text_col: str = "text"):
    """The atomic group of a row: equal texts share it; null is a group of its own."""
    return F.coalesce(F.sha2(F.col(text_col), 256), F.lit(NULL_GROUP))


def text_size(text_col: str = "text"):
    """UTF-8 bytes (null: none) plus 1."""
    return F.octet_length(text_or_empty(text_col)).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: equal texts stay together, groups are ordered by digest, and the largest shard is as small as
    contiguous runs allow.  A null text has size 1, the CRC of no bytes, and forms one group with other nulls; an
    empty text is another group.  Repeated rows each get a slot; a null doc_id is kept.  A group larger than the
    mean shard fills a shard by itself.  With fewer groups than shards some shards stay empty.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    keyed = stage(docs.select("doc_id", text_size().alias("size"), crc.alias("text_crc32"), group_of().alias("g")), "keyed")
    _, cuts = minimax_cuts(prefix_sums(keyed), shards)
    return place(keyed, cuts, ["doc_id", "g"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All columns of ``docs`` plus shard and slot, by the same law; columns that already have one of those two
    names (in any case) are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keyed = docs.select(group_of().alias("g"), text_size().alias("size"), "doc_id",
                        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    _, cuts = minimax_cuts(prefix_sums(keyed.select("g", "size")), shards)
    return place(keyed.drop("size"), cuts, ["doc_id", "g"]).select("row.*", "shard", "slot")
