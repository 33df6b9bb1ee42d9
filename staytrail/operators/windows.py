"""Window operators over keyed, time-ordered rows.

Partitioning notes (for 100 TB scale):
* ``trailing_count`` of a key with up to ``WINDOW_ROWS`` rows is one range window.
  For other keys it is the difference of two prefix counts over the distinct
  (key, time) pairs: within a day from a window per (key, day), across days from
  one row a day.  Equal times are combined before they move, so a hot key is
  spread over as many tasks as it has days.
* ``latest_per_group`` and ``first_per_group`` are ``min_by`` aggregates over a
  struct: partial aggregation runs before the shuffle, so a hot group never lands
  whole in one task (Spark runs them sort-based, as structs can't be updated in
  place).
* ``first_n`` is the one plain window per key; Catalyst puts a group limit of n
  rows before its shuffle, so a task gets n rows of a key from each task at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import MICROS_PER_DAY, epoch_micros
from ..session import materialize
from . import ordered
from .ordered import Key


#: rows of a key up to which its trailing counts are one window, whose frames are counted row by row
WINDOW_ROWS = 256


def trailing_count(df: DataFrame, key: str, ts: str, min_days: int = 1, max_days: int = 365,
                   out: str = "n_recent", bucket_days: int | None = None, parts: int | None = None) -> DataFrame:
    """For each row: rows of the same key whose ``ts`` lies ``min_days``..``max_days``
    *whole* (floored) days earlier.  floor(d) in [a, b] <=> a days <= d < b+1 days.

    Rows of keys with up to ``WINDOW_ROWS`` rows move once, by the key (into ``parts`` parts, if given); all others (all, with
    ``bucket_days``) are counted by ``_prefix_counts``.  Null keys are one key; a null time
    counts nothing and is not counted."""
    prefix = lambda d: _prefix_counts(d, key, ts, min_days, max_days, out, bucket_days)
    if bucket_days or max_days < min_days:
        return prefix(df)
    near, far = min_days * MICROS_PER_DAY, (max_days + 1) * MICROS_PER_DAY
    counted = lambda d, w: d.withColumn(out, F.count("_trail").over(w.rangeBetween(1 - far, -near))).drop("_trail")
    timed = df.withColumn("_trail", epoch_micros(ts))
    return ordered.by_size(timed, [key], [Key("_trail")], counted, prefix, None, WINDOW_ROWS, parts)


def _prefix_counts(df: DataFrame, key: str, ts: str, min_days: int, max_days: int, out: str,
                   bucket_days: int | None) -> DataFrame:
    """``trailing_count`` for keys of any size.

    The count is (rows up to t - a days) minus (rows up to t - (b+1) days), so it
    depends on the key and t alone.  Rows are counted by (key, t); each such pair
    goes to the buckets (``bucket_days``, a day by default) of its own time and of
    both bounds.  A prefix count is what earlier buckets of the key hold, from one
    row a bucket, plus what the bucket itself holds up to the bound.  Pairs with a
    count go back to the rows from a written table, so that the rows of a hot pair
    can be split."""
    near = min_days * MICROS_PER_DAY                 # at least this far back
    far = (max_days + 1) * MICROS_PER_DAY            # less than this far back
    width = (bucket_days or 1) * MICROS_PER_DAY
    df = df.drop("_trail")
    times = (df.select(F.col(key).alias("_k"), epoch_micros(ts).alias("_t")).filter(F.col("_t").isNotNull())
               .groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("_n")))
    no_rows = F.lit(0).cast("long")
    marks = F.array(F.struct(F.col("_t").alias("at"), F.col("_n").alias("held"), F.lit(0).alias("sign")),
                    F.struct((F.col("_t") - near).alias("at"), no_rows.alias("held"), F.lit(1).alias("sign")),
                    F.struct((F.col("_t") - far).alias("at"), no_rows.alias("held"), F.lit(-1).alias("sign")))
    at = (times.select("_k", "_t", F.explode(marks).alias("_m")).select("_k", "_t", "_m.*")
               .withColumn("_b", F.floor(F.col("at") / F.lit(width)).cast("long")))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (at.groupBy("_k", "_b").agg(F.sum("held").alias("_h"))
                 .select(F.col("_k").alias("_k0"), F.col("_b").alias("_b0"),
                         F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_before")))
    upto = Window.partitionBy("_k", "_b").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = (at.withColumn("_in", F.sum("held").over(upto))
                .join(buckets, (F.col("_b") == F.col("_b0")) & F.col("_k").eqNullSafe(F.col("_k0"))))
    counts = (prefix.filter("sign != 0").groupBy(F.col("_k"), F.col("_t"))
                    .agg(F.sum(F.col("sign") * (F.col("_in") + F.col("_before"))).alias("_c")).filter("_c > 0"))
    found = materialize(counts, "trailing")
    cond = F.col(key).eqNullSafe(F.col("_k")) & (epoch_micros(ts) == F.col("_t"))
    return df.join(found, cond, "left").select(*[df[c] for c in df.columns], F.coalesce("_c", no_rows).alias(out))


def next_value(df: DataFrame, key: str | Sequence[str], order: Sequence[Key], value: str, out: str,
               width: float, like: DataFrame | None = None) -> DataFrame:
    """Value of the following row of the same key in ``order`` (two-level, see
    ``ordered``; ``width`` is the bucket width of the leading order column, in
    microseconds for timestamps).  ``like``: see ``ordered``."""
    return ordered.neighbour(df, key, order, value, width, out, following=True, like=like)


def _default_width(df: DataFrame, order: Sequence[str], width: float | None) -> float:
    """A day of a time column, one unit of a number."""
    if width is not None:
        return width
    return float(MICROS_PER_DAY) if dict(df.dtypes)[order[0]].startswith("timestamp") else 1.0


def fill_forward(df: DataFrame, key: str, order: Sequence[str], c: str, out: str | None = None,
                 width: float | None = None) -> DataFrame:
    """Last non-null ``c`` so far within ``key`` (two-level over ranges of ``width``
    of the leading order column, by default a day or one unit)."""
    width = _default_width(df, order, width)
    return ordered.fill_nulls(df, key, [Key(o) for o in order], c, width, out or c)


def fill_backward(df: DataFrame, key: str, order: Sequence[str], c: str, out: str | None = None,
                  width: float | None = None) -> DataFrame:
    """First non-null ``c`` from this row on within ``key``."""
    width = _default_width(df, order, width)
    return ordered.fill_nulls(df, key, [Key(o) for o in order], c, width, out or c, backward=True)


def fill_both(df: DataFrame, key: str, order: Sequence[str], c: str, width: float | None = None) -> DataFrame:
    """Forward fill, then backward fill what is still missing."""
    d = materialize(fill_forward(df, key, order, c, "_ff", width), "filled")
    d = fill_backward(d, key, order, c, "_bf", width)
    return d.withColumn(c, F.coalesce("_ff", "_bf")).drop("_ff", "_bf")


def drop_consecutive_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Key], c: str,
                             width: float) -> DataFrame:
    """Keep change points of ``c`` within ``keys`` in ``order``; a null is never
    equal to anything, so null rows and the rows after them are kept (the first
    row of a key has no previous value and is kept too)."""
    d = ordered.neighbour(df, keys, order, c, width, "_prev", following=False)
    return d.filter(F.col(c).isNull() | F.col("_prev").isNull() | (F.col(c) != F.col("_prev"))).drop("_prev")


def latest_per_group(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Row with the latest ``ts`` per group (ties: smallest ``tie``, nulls first)."""
    cols = [c for c in df.columns if c not in keys]
    order = F.struct((-epoch_micros(ts)).alias("t"), F.col(tie).alias("k"))
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def first_per_group(df: DataFrame, keys: Sequence[str], order: str, tie: str, descending: bool = False) -> DataFrame:
    """First row per group by ``order`` (``descending`` for the last), ties by ``tie``."""
    cols = [c for c in df.columns if c not in keys]
    o = F.col(order)
    if descending:
        o = -epoch_micros(order) if dict(df.dtypes)[order].startswith("timestamp") else -o
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(o.alias("o"), F.col(tie).alias("k"))).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def sequence_position(df: DataFrame, key: str | Sequence[str], order: str, tie: str, out: str = "pos",
                      width: float = 1.0, like: DataFrame | ordered.Placed | None = None) -> DataFrame:
    """0-based position within ``key`` by ``order`` ascending (nulls last), then
    ``tie`` (nulls first); two-level, buckets of ``width`` units of ``order``.
    ``like``: see ``ordered``; ``df`` itself if its rows lie by key already."""
    return ordered.position(df, key, [Key(order), Key(tie, nulls_first=True)], width, out, like)


def first_n(df: DataFrame, key: str | Sequence[str], order: str, tie: str, n: int) -> DataFrame:
    """First ``n`` rows per key (Catalyst turns this into a WindowGroupLimit)."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(order).asc_nulls_last(), F.col(tie).asc_nulls_first())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _latest_first(pos: str) -> list[Key]:
    """The order of ``pos`` from its end, which time deltas and decay share so that rows are sorted once for both."""
    return [Key(pos, asc=False, nulls_first=True)]


def time_delta(df: DataFrame, key: str | Sequence[str], pos: str, t: str, out: str = "delta", width: float = 64.0,
               like: DataFrame | ordered.Placed | None = None) -> DataFrame:
    """t minus the previous t of the key (the first keeps its own t), clamped at 0.
    ``like``: see ``ordered``; the earlier rows that ``df`` was made from by key."""
    d = ordered.neighbour(df, key, _latest_first(pos), t, width, "_prev_t", following=True, like=like)
    return d.withColumn(out, F.greatest(F.col(t) - F.coalesce("_prev_t", F.lit(0.0)), F.lit(0.0))).drop("_prev_t")


def exp_decay_recency(df: DataFrame, key: str | Sequence[str], pos: str, delta: str, group: str, x: str | None = None,
                      rate: float = 1.0, out: str = "recency", width: float = 64.0,
                      like: DataFrame | ordered.Placed | None = None) -> DataFrame:
    """Recency weight per (key, group): sum of x_i * exp(-rate * sum of deltas from
    step i to the end of the sequence).  Equals what an exponentially decayed
    state accumulates from each input.  The sum runs from the end of the sequence, so that a key costs as many
    additions as it has rows, and is two-level for a long key.
    ``like``: see ``ordered``; the earlier rows that ``df`` was made from by key."""
    xv = F.lit(1.0) if x is None else F.col(x)
    d = ordered.running_sum(df, key, _latest_first(pos), delta, width, "_s", like=like)
    d = d.withColumn("_w", xv * F.exp(-F.greatest(F.col("_s") * F.lit(rate), F.lit(0.0))))
    return d.groupBy(*([key] if isinstance(key, str) else key), group).agg(F.sum("_w").alias(out))


def sort_mixed(df: DataFrame, spec: Sequence[tuple[str, bool]], nulls: str = "last") -> DataFrame:
    """Multi-key sort, ``spec`` = [(column, ascending)], nulls placed ``nulls``."""
    cols = []
    for c, asc in spec:
        col = F.col(c)
        if asc:
            cols.append(col.asc_nulls_last() if nulls == "last" else col.asc_nulls_first())
        else:
            cols.append(col.desc_nulls_last() if nulls == "last" else col.desc_nulls_first())
    return df.orderBy(*cols)
