"""Aggregations: counts, rare-value lumping, daily sums, pivots, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import lookup_join
from .ordered import cumulative


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Frequency of every non-null value."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("long").alias(out))


#: frequent values, over all columns, up to which they are compared as a literal set without a join
LITERAL_VALUES = 1000


def lump_rare(df: DataFrame, cols: Sequence[str], min_count: int, other: str,
              materialize_input: bool = True, literal_values: int = LITERAL_VALUES) -> DataFrame:
    """Replace values seen fewer than ``min_count`` times by ``other``; nulls stay.

    One scan counts every listed column (explode of (column, value) pairs, hash
    aggregate with map-side combine, so a hot value is pre-aggregated before the
    shuffle).  The *frequent* values (at most rows / min_count per column) are
    written once, and a column looks its values up in that table with
    ``lookup_join``, so the rows of a hot value are never gathered.  Of several
    columns up to ``literal_values`` frequent values in all are read by the driver
    instead and become sets in the plan, so that one pass without a join replaces
    all columns.

    The input is read twice (counts, lookup), so by default it is written once
    to the shared folder instead of being recomputed.
    """
    cols = list(cols)
    if materialize_input:
        df = materialize(df, "lump_input")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in cols])).alias("_p"))
    freq = materialize(pairs.select("_p._c", "_p._v").filter(F.col("_v").isNotNull())
                       .groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
                       .filter(F.col("_n") >= F.lit(min_count)), "frequent")
    lumped = lambda c, kept: F.when(F.col(c).isNull() | kept, F.col(c)).otherwise(F.lit(other)).alias(c)
    few = freq.select("_c", "_v").limit(literal_values + 1).collect() if len(cols) > 1 else []
    if 0 < len(few) <= literal_values:
        sets = {c: [r["_v"] for r in few if r["_c"] == c] for c in cols}
        return df.select(*[lumped(c, F.col(c).cast("string").isin(sets[c])) if c in sets else c for c in df.columns])
    rows = {r["_c"]: r["n"] for r in freq.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, order = df, df.columns
    for c in cols:
        keep = freq.filter(F.col("_c") == F.lit(c)).select(F.col("_v").alias(c), F.lit(True).alias("_keep"))
        out = lookup_join(out, keep, c, rows=rows.get(c, 0))
        out = out.select(*[lumped(c, F.col("_keep").isNotNull()) if x == c else x for x in order])
    return out


def daily_sum(df: DataFrame, key: str, ts: str, v: str, day: str = "chartday") -> DataFrame:
    """Sum of ``v`` per (key, calendar day)."""
    return df.groupBy(key, F.to_date(ts).alias(day)).agg(F.sum(v).alias(v))


def pivot_mean(df: DataFrame, idx: Sequence[str], type_col: str, v: str, values: Sequence[str]) -> DataFrame:
    """Long -> wide mean per index x type, with an explicit value list (no extra
    distinct job).  Missing combinations are null."""
    return df.groupBy(*idx).pivot(type_col, list(values)).agg(F.avg(v))


def group_sizes(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias(out))


def exact_quantile(df: DataFrame, col: str, q: float, out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantile (one row; null without values).  Values
    are counted (hash aggregate), the distinct ones get running counts range by
    range, and only the one or two at the wanted ranks are kept, so no task holds
    all of them."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    t = cumulative(counts, [F.col(col).asc()], ["_n"])
    n = t.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    at = (F.col("_total") - 1) * F.lit(float(q))
    low, high = F.floor(at), F.ceil(at)
    t = t.crossJoin(F.broadcast(n))  # one row
    holds = lambda k: (F.col("cum__n") - F.col("_n") <= k) & (k < F.col("cum__n"))
    ends = t.filter(holds(low) | holds(high)).agg(
        F.max(F.when(holds(low), F.col(col))).cast("double").alias("_lo"),
        F.max(F.when(holds(high), F.col(col))).cast("double").alias("_hi"), F.max(at - low).alias("_part"))
    return ends.select((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def max_normalise(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Divide ``c`` by its global maximum (a one-row broadcast, no collect)."""
    m = df.agg(F.max(c).alias("_max"))
    return df.crossJoin(F.broadcast(m)).withColumn(out or c, F.col(c) / F.col("_max")).drop("_max")


def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None, within: str | None = None) -> DataFrame:
    """Exact-row (or key) dedupe; nulls compare equal.  ``within`` names a column that
    equal rows share by the caller's word: rows that lie by it already are compared
    there, and it is dropped."""
    if within:
        return df.dropDuplicates([within, *cols] if cols else None).drop(within)
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()
