"""Row position and neighbours within a key, without putting a key in one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task; a key holding a third of the data would serialise the job.  These
helpers split each key into ranges and work in two levels:

1. inside each (key, range) with an ordinary window, and
2. across ranges through a small per-(key, range) table (one row per
   non-empty range: counts, first or last row), prefix-summed or shifted with
   a window over ranges and joined back on (key, range).

A range is a fixed-width bucket of the leading order column (bucket order
follows row order).  The rows of each bucket are counted first; a bucket with
more than ``BUCKET_ROWS`` rows, such as that of a key whose rows all share one
time, is cut further by the whole order, ties included, at bounds that Spark
samples from its rows (``_dealt``).  Only the rows of such buckets are dealt by
range and written; all others stay as they are.

The join and the inner window share the (key, range) partitioning, so this
costs one extra aggregation and a join of a table far smaller than the data.
Results equal the single-window versions exactly (tests compare them).

Only keys with more than ``BUCKET_ROWS`` rows need that.  All others are one range
each, as large as a bucket may be: their rows move once, by the key alone, so that
further steps by the key find them together, and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timefns import epoch_micros
from ..session import materialize

LAST_BUCKET = 2 ** 62
#: rows of a (key, bucket) beyond which it is cut at counted bounds; results don't depend on it
BUCKET_ROWS = 1_000_000
#: rows of a part in which keys lie together
PART_ROWS = 1_000_000
#: slots of keys that are counted before single keys are
SLOTS = 1 << 16


@dataclass(frozen=True)
class Key:
    """One sort key: column, direction and null placement."""
    col: str
    asc: bool = True
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.col)
        if self.asc:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def _numeric(df: DataFrame, col: str) -> Column:
    return epoch_micros(col) if dict(df.dtypes)[col].startswith("timestamp") else F.col(col).cast("double")


def bucket_of(df: DataFrame, lead: Key, width: float) -> Column:
    """Fixed-width bucket of the leading sort key, increasing in sort order;
    nulls get the first or last bucket according to their placement."""
    x = _numeric(df, lead.col)
    b = F.floor(x / F.lit(float(width))).cast("long")
    b = b if lead.asc else -b
    return F.when(x.isNull(), F.lit(-LAST_BUCKET if lead.nulls_first else LAST_BUCKET)).otherwise(b)


def _negated(df: DataFrame, col: str) -> Column:
    """A value that falls as ``col`` rises, exact for every numeric and time type."""
    kind = dict(df.dtypes)[col]
    if kind.startswith("timestamp"):
        return -epoch_micros(col)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return -F.col(col).cast("decimal(20,0)")
    return -F.col(col)


def _rank_struct(df: DataFrame, keys: Sequence[Key]) -> Column:
    """A struct whose natural ascending order is the sort order of ``keys``
    (descending keys must be numeric or timestamps)."""
    fields = []
    for i, k in enumerate(keys):
        c = F.col(k.col)
        fields.append((c.isNotNull() if k.nulls_first else c.isNull()).alias(f"n{i}"))
        fields.append((c if k.asc else _negated(df, k.col)).alias(f"v{i}"))
    return F.struct(*fields)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: a range within a key: the bucket, and the part of a bucket that was cut
RANGE = ("_bk", "_sub")


def _dealt(df: DataFrame, ks: Sequence[str], keys: Sequence[Key], width: float) -> DataFrame:
    """``df`` with the range of each row as ``_bk`` and ``_sub``, both rising in sort
    order within a key.  ``_sub`` is 0 but in buckets of more than ``BUCKET_ROWS``
    rows: these rows are dealt by ranges of (key, order), about half that many rows
    each, and written, so that all later steps see the same bounds."""
    d = df.withColumn("_bk", bucket_of(df, keys[0], width))
    counts = d.groupBy(*ks, "_bk").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS)
    rows = counts.agg(F.sum("_n")).first()[0]
    if not rows:
        return d.withColumn("_sub", F.lit(0))
    full = materialize(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], F.col("_bk").alias("_b")), "full")
    cond = F.col("_bk") == F.col("_b")
    for i, k in enumerate(ks):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    light = d.join(full, cond, "left_anti").withColumn("_sub", F.lit(0))
    heavy = d.join(full, cond, "left_semi")
    cut = in_ranges(heavy, [*map(F.col, ks), *[k.order() for k in keys]], -(-2 * rows // BUCKET_ROWS))
    return light.unionByName(cut.withColumnRenamed("_pid", "_sub"))


def _ranges_of(ks: Sequence[str]) -> list[Column]:
    """Key and range columns of a per-(key, range) table under the names that ``_join_back`` takes."""
    return [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], F.col("_bk").alias("_b"), F.col("_sub").alias("_s")]


def _join_back(d: DataFrame, small: DataFrame, ks: list[str]) -> DataFrame:
    """Join a per-(key, range) table (columns renamed by ``_ranges_of``) back."""
    cond = (F.col("_bk") == F.col("_b")) & (F.col("_sub") == F.col("_s"))
    for i, k in enumerate(ks):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(small, cond).drop("_b", "_s", *[f"_k{i}" for i in range(len(ks))])


def parts_by(df: DataFrame, key: str) -> int | None:
    """The number of parts by ``key`` into which rows like those of ``df`` can be dealt, about ``PART_ROWS`` each; None if
    a key has more than ``BUCKET_ROWS`` rows, so that it must not lie in one part.

    Rows are counted by slots of the key's hash, of which few move; keys only where a slot has too many rows.  Below Spark's
    number of shuffle partitions, which joins don't go under, the number divides it, so that a task fills one bucket."""
    slots = df.groupBy(F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    n = slots.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    if (n["most"] or 0) > BUCKET_ROWS and not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS).isEmpty():
        return None
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-(n["rows"] or 0) // PART_ROWS))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return next((p for p in range(parts, usual) if usual % p == 0), max(parts, usual))


def _full_keys(df: DataFrame, ks: Sequence[str], most: int) -> DataFrame:
    """The written keys with more than ``most`` rows."""
    counts = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return materialize(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)]), "full")


def _numbered(df: DataFrame, ks: Sequence[str]) -> DataFrame:
    return df.withColumn("_bk", F.pmod(F.xxhash64(*ks), F.lit(1 << 20)))


class Placed:
    """Rows that lie together by ``ks`` and are the input of several steps by them: ``df`` has the number of the range,
    which the steps leave in, so that those of one order share a sort, and keys are counted once for all steps."""

    def __init__(self, df: DataFrame, key: str | Sequence[str]):
        self.keys = _keys(key)
        self.df = _numbered(df, self.keys)
        self._counted: dict[int, tuple[DataFrame, bool]] = {}

    def full(self, most: int) -> tuple[DataFrame, bool]:
        """Keys with more than ``most`` rows, and whether there is none."""
        if most not in self._counted:
            found = _full_keys(self.df, self.keys, most)
            self._counted[most] = found, found.isEmpty()
        return self._counted[most]


def by_size(df: DataFrame, ks: Sequence[str], keys: Sequence[Key], whole: Callable[[DataFrame, WindowSpec], DataFrame],
             ranged: Callable[[DataFrame], DataFrame], like: DataFrame | Placed | None, most: int | None = None,
             parts: int | None = None) -> DataFrame:
    """``whole`` of the rows whose key has up to ``most`` (``BUCKET_ROWS``) rows, each key one range (numbered by its hash) and in
    one place, and ``ranged`` of all others.  ``like`` is an earlier input with the same rows a key, of which ``df`` is the result:
    keys are counted there (once, if it is ``Placed``), and the rows lie together already; else they are dealt into ``parts`` parts (Spark's number)."""
    most = BUCKET_ROWS if most is None else most
    placed = isinstance(like, Placed)
    if placed and list(ks) != like.keys:
        raise ValueError(f"rows are placed by {like.keys}, not {list(ks)}")
    if placed:
        full, none = like.full(most)
    else:
        full = _full_keys(df if like is None else like, ks, most)
        none = full.isEmpty()
    window = Window.partitionBy(*ks, "_bk").orderBy(*[k.order() for k in keys])

    def each(d: DataFrame) -> DataFrame:
        if placed:
            return whole(d, window)
        d = _numbered(d.repartition(*([parts] if parts else []), *ks) if like is None else d, ks)
        return whole(d, window).drop("_bk")

    if none:
        return each(df)
    cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(ks)])
    hot = df.join(full, cond, "left_semi")
    hot = _numbered(ranged(hot.drop("_bk")), ks) if placed else ranged(hot)
    return each(df.join(full, cond, "left_anti")).unionByName(hot)


def position(df: DataFrame, key: str | Sequence[str], keys: Sequence[Key], width: float,
             out: str = "pos", like: DataFrame | Placed | None = None) -> DataFrame:
    """0-based row number within ``key`` in the order of ``keys`` (a total order)."""
    number = lambda d, w: d.withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    return by_size(df, _keys(key), keys, number, lambda d: _position(d, _keys(key), keys, width, out), like)


def _position(df: DataFrame, ks: list[str], keys: Sequence[Key], width: float, out: str) -> DataFrame:
    d = _dealt(df, ks, keys, width)
    counts = d.groupBy(*ks, *RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*ks).orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*_ranges_of(ks), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    j = _join_back(d, offs, ks)
    w = Window.partitionBy(*ks, *RANGE).orderBy(*[k.order() for k in keys])
    return j.withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("int")).drop(*RANGE, "_off")


def neighbour(df: DataFrame, key: str | Sequence[str], keys: Sequence[Key], value: str, width: float, out: str,
              following: bool = True, like: DataFrame | Placed | None = None) -> DataFrame:
    """``value`` of the next (``following``) or previous row within ``key`` in the
    order of ``keys``; null at the end.  Like lead/lag over the whole key."""
    shifted = lambda d, w: d.withColumn(out, (F.lead if following else F.lag)(value).over(w))
    return by_size(df, _keys(key), keys, shifted, lambda d: _neighbour(d, _keys(key), keys, value, width, out, following), like)


def _neighbour(df: DataFrame, ks: list[str], keys: Sequence[Key], value: str, width: float, out: str,
               following: bool) -> DataFrame:
    dealt = _dealt(df, ks, keys, width)
    w = Window.partitionBy(*ks, *RANGE).orderBy(*[k.order() for k in keys])
    shift = F.lead if following else F.lag
    d = dealt.withColumn("_in", shift(value).over(w)).withColumn("_has", shift(F.lit(1)).over(w).isNotNull())
    rank = _rank_struct(df, keys)
    end = F.min_by(F.col(value), rank) if following else F.max_by(F.col(value), rank)
    ends = d.groupBy(*ks, *RANGE).agg(end.alias("_end"))
    wb = Window.partitionBy(*ks).orderBy(*RANGE)
    cross = ends.select(*_ranges_of(ks), shift("_end").over(wb).alias("_cross"))
    j = _join_back(d, cross, ks)
    return (j.withColumn(out, F.when(F.col("_has"), F.col("_in")).otherwise(F.col("_cross")))
             .drop(*RANGE, "_in", "_has", "_cross"))


def running_sum(df: DataFrame, key: str | Sequence[str], keys: Sequence[Key], value: str, width: float, out: str,
                suffix: bool = False, like: DataFrame | Placed | None = None) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to this row (or, with
    ``suffix``, from this row to the last), in the order of ``keys``."""
    total = lambda d, w: d.withColumn(out, F.sum(value).over(_frame(w, suffix)))
    return by_size(df, _keys(key), keys, total, lambda d: _running_sum(d, _keys(key), keys, value, width, out, suffix), like)


def _frame(w: WindowSpec, suffix: bool) -> WindowSpec:
    """From this row to the last, or from the first to this one."""
    return w.rowsBetween(0, Window.unboundedFollowing) if suffix else w.rowsBetween(Window.unboundedPreceding, 0)


def _running_sum(df: DataFrame, ks: list[str], keys: Sequence[Key], value: str, width: float, out: str,
                 suffix: bool) -> DataFrame:
    frame = _frame(Window.partitionBy(*ks, *RANGE).orderBy(*[k.order() for k in keys]), suffix)
    d = _dealt(df, ks, keys, width).withColumn("_in", F.sum(value).over(frame))
    tot = d.groupBy(*ks, *RANGE).agg(F.sum(value).alias("_tot"))
    wb = Window.partitionBy(*ks).orderBy(*RANGE)
    others = wb.rowsBetween(1, Window.unboundedFollowing) if suffix else wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*_ranges_of(ks), F.sum("_tot").over(others).alias("_carry"))
    j = _join_back(d, carry, ks)
    return (j.withColumn(out, F.when(F.col("_carry").isNull(), F.col("_in"))
                         .otherwise(F.coalesce(F.col("_in"), F.lit(0)) + F.col("_carry")))
             .drop(*RANGE, "_in", "_carry"))


def fill_nulls(df: DataFrame, key: str | Sequence[str], keys: Sequence[Key], value: str, width: float, out: str,
               backward: bool = False) -> DataFrame:
    """Last non-null ``value`` up to this row (forward fill) or, with
    ``backward``, first non-null from this row on, within the key."""
    ks = _keys(key)
    d = _dealt(df, ks, keys, width)
    w = Window.partitionBy(*ks, *RANGE).orderBy(*[k.order() for k in keys])
    if backward:
        d = d.withColumn("_in", F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    else:
        d = d.withColumn("_in", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col(value).isNotNull(), _rank_struct(df, keys))
    edge = F.min_by(F.col(value), rank) if backward else F.max_by(F.col(value), rank)
    ends = d.groupBy(*ks, *RANGE).agg(edge.alias("_end"))
    wb = Window.partitionBy(*ks).orderBy(*RANGE)
    if backward:
        c = F.first("_end", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing))
    else:
        c = F.last("_end", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*_ranges_of(ks), c.alias("_carry"))
    j = _join_back(d, carry, ks)
    return j.withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop(*RANGE, "_in", "_carry")


def in_ranges(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written with the number of the range
    as ``_pid``, so that all later steps see one and the same set of ranges (their
    sampled bounds would differ if the exchange ran twice)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranges")


def cumulative(df: DataFrame, order: Sequence[Column], cols: Sequence[str], keys: Sequence[str] = (),
               partitions: int | None = None) -> DataFrame:
    """``df`` with ``cum_<c>`` for each of ``cols``: the sum over all rows of the same
    ``keys`` up to this one in ``order`` (which must tell the key's rows apart).

    Rows are dealt by ranges of (keys, order); each range is summed up on its own
    and gets what its keys' earlier ranges hold from a table of one row per range
    and key, so neither a key nor the whole order is one task."""
    keys, order = list(keys), list(order)
    r = in_ranges(df, [*map(F.col, keys), *order], partitions)
    totals = r.groupBy(*keys, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_range"),
                         *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    cond = F.col("_pid") == F.col("_range")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(offs if keys else F.broadcast(offs), cond)  # without keys: one row per range
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(within))
    return out.drop("_pid", "_range", *[f"_k{i}" for i in range(len(keys))], *[f"_o_{c}" for c in cols])


def ranked(vals: DataFrame, order_col: str, out: str, partitions: int | None = None) -> DataFrame:
    """0-based rank of the (distinct) rows of ``vals`` by ``order_col``, for any
    orderable type (see ``cumulative``; by default one range per shuffle partition)."""
    ranks = cumulative(vals.withColumn("_one", F.lit(1)), [F.col(order_col).asc()], ["_one"], (), partitions)
    return ranks.withColumn(out, (F.col("cum__one") - 1).cast("long")).drop("_one", "cum__one")
