"""Joins of entities to their (many) events that stay splittable under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: rows of a lookup table up to which it is broadcast (its size is counted first)
BROADCAST_ROWS = 500_000
#: parts into which the rows of a key are dealt when the lookup table is larger
SALTS = 32


def left_join_many(left: DataFrame, right: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``left`` LEFT OUTER JOIN ``right`` USING (``key``), where ``right`` holds
    many rows per key.

    Written as the inner join (AQE can split a hot key on either side of an
    inner join, but only the preserved side of an outer join) plus the left rows
    whose key has no match (anti-join against the *distinct* right keys, an
    aggregate that collapses a hot key before the shuffle), padded with nulls.
    Same rows and columns as the outer join, including left rows with a null key.

    ``parts`` says that no key has very many rows (``ordered.parts_by``): both sides
    are dealt into so many parts by the key and meet in the outer join itself.
    """
    if parts:
        return left.repartition(parts, key).join(right.repartition(parts, key), key, "left")
    matched = left.join(right, key, "inner")
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def lookup_join(df: DataFrame, table: DataFrame, key: str, how: str = "left", broadcast_rows: int | None = None,
                salts: int = SALTS, rows: int | None = None) -> DataFrame:
    """``df`` joined to ``table`` (one row per ``key``) so that a hot key never lands in one task.

    The table is computed once and counted.  If small it is broadcast and the
    rows of ``df`` don't move; beyond that the rows are dealt by key and a salt
    that follows from the row, and each table row is repeated for every salt.
    Both ways give the same rows; a null key matches nothing.  ``rows`` says that
    ``table`` is written already and how many rows it has."""
    if rows is None:
        table = materialize(table, "lookup")
        rows = table.count()
    if rows <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return df.join(F.broadcast(table), key, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
