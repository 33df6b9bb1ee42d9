"""Shared helpers of the training-data operators: stage tables, batches, hash buckets, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

#: fixed value: a word is a maximal run of characters other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches sent to Python hold at most so many rows and bytes, so that very long texts stay in bounds
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm-{name}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage is cut, and a lost executor costs no
    recomputation of what came before."""
    return materialize(df, f"llm-{name}")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes; a batch of default size could hold thousands of very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(spark: SparkSession, most: int = 16) -> int:
    """So many leading bits of a hash that there are at least four buckets a shuffle partition (2**8 to 2**most)."""
    return min(most, max(8, (4 * shuffle_partitions(spark)).bit_length()))


def hex_bucket(hex_col: str, bits: int) -> Column:
    """The first ``bits`` (at most 16) bits of a hexadecimal string as a number; order follows the string's."""
    return F.shiftright(F.conv(F.substring(hex_col, 1, 4), 16, 10).cast("int"), 16 - bits)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ranked(df: DataFrame, cols: list, out: str, name: str) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``cols``.  Rows are dealt by range, written
    with the number of their range, counted by range (one row each) and ranked within it, so that the order in
    which ranges were sampled can't change between the count and the rank."""
    n = shuffle_partitions(df.sparkSession)
    dealt = stage(df.repartitionByRange(n, *cols).withColumn("_range", F.spark_partition_id()), name)
    before = (dealt.groupBy("_range").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    return (dealt.join(F.broadcast(before), "_range")  # one row for each shuffle partition
            .withColumn(out, F.col("_before") + within - 1).drop("_range", "_before"))
