"""Irregular event sequences -> positions, dictionaries and padded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import strings, timefns
from ..functions.arrays import pad_array
from . import ordered, windows
from .aggregates import group_sizes, lump_rare
from ..session import materialize, materialize_by
from .events import stay_id_from_text
from .joins import left_join_many, lookup_join


def prescriptions(meds: DataFrame) -> DataFrame:
    """(icustay_id, valuecat, charttime) from raw prescriptions."""
    d = meds.na.drop("any")
    return d.select(stay_id_from_text("icustay_id").alias("icustay_id"),
                    strings.normalise_drug("drug", rules.DRUG_PREFIX).alias("valuecat"),
                    F.col("startdate").alias("charttime"))


def left_join_stay_events(stays: DataFrame, events: DataFrame, key: str = "icustay_id",
                           parts: int | None = None) -> DataFrame:
    """Every stay with its events; stays without events keep one null row (a
    skew-splittable form of the left outer join; ``parts`` as there)."""
    return left_join_many(stays, events, key, parts)


def charts_prescriptions_by_stay(cohort: DataFrame, chart_outputs: DataFrame, meds: DataFrame,
                                 min_count: int = rules.RARE_MIN_COUNT) -> tuple[DataFrame, int | None]:
    """``charts_prescriptions``, and the number of parts by stay in which its rows lie (None with a very long stay).

    Rows are counted by stay first.  If none has very many, stays and events move by
    the stay once and are written in buckets by it, so that steps by stay need no exchange."""
    ev = chart_outputs.select("icustay_id", "valuecat", "charttime").unionByName(prescriptions(meds))
    stays = cohort.select("icustay_id", "outtime")
    known = ev.select("icustay_id").filter(F.col("icustay_id").isNotNull())  # others meet no stay
    parts = ordered.parts_by(stays.select("icustay_id").unionByName(known), "icustay_id")
    d = left_join_stay_events(stays, ev, parts=parts)
    d = d.select("icustay_id", "valuecat",
                 timefns.fractional_hours("charttime", "outtime", clamp=True).alias("hours_to_out")).dropDuplicates()
    d = _written(d, "lump_input", "icustay_id", parts)
    return lump_rare(d, ["valuecat"], min_count, rules.RARE_CODE, materialize_input=False), parts


def charts_prescriptions(cohort: DataFrame, chart_outputs: DataFrame, meds: DataFrame,
                         min_count: int = rules.RARE_MIN_COUNT) -> DataFrame:
    """(icustay_id, valuecat, hours_to_out) for every cohort stay, deduplicated,
    rare categories lumped."""
    return charts_prescriptions_by_stay(cohort, chart_outputs, meds, min_count)[0]


def _written(df: DataFrame, name: str, key: str, parts: int | None) -> DataFrame:
    """``df`` as a written table, in buckets by ``key`` where its rows lie so in ``parts`` parts."""
    return materialize_by(df, name, key, parts) if parts else materialize(df, name)


def sequence_positions(df: DataFrame, key: str | Sequence[str], t: str, code: str, width: float = 24.0,
                       like: DataFrame | ordered.Placed | None = None) -> DataFrame:
    """0-based position per key by time ascending (nulls last), ties by code;
    ``width`` (in units of ``t``) splits a long sequence over several tasks.
    ``like``: see ``ordered``; ``df`` itself if its rows lie by key already."""
    return windows.sequence_position(df, key, t, code, "pos", width, like)


def truncate_sequences(df: DataFrame, key: str, q: float, pos: str = "pos") -> DataFrame:
    """Keep positions below the exact ``q`` quantile of the per-key row counts.

    The quantile is one aggregate over the lengths, whose state is the distinct
    lengths; its single value becomes a literal, so that the filter reaches the scan."""
    cut = group_sizes(df, key).agg(F.percentile("n", F.lit(float(q))).alias("q")).first()["q"]
    return df.filter(F.col(pos) < F.lit(cut))


def dictionary_encode(df: DataFrame, code: str, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Sorted distinct codes -> 1..n (0 is the pad / unknown code).

    Returns (encoded rows, dictionary(idx, code)).  The distinct codes are ranked
    in parallel (ranges numbered on their own plus offsets), so a large
    vocabulary is never ordered in one task, and looked up with ``lookup_join``,
    so the rows of a hot code are never gathered.  Reads ``df`` twice."""
    vocab = df.select(code).filter(F.col(code).isNotNull()).distinct()
    dictionary = ordered.ranked(vocab, code, "_r").select((F.col("_r") + 1).cast("int").alias(idx), code)
    dictionary = materialize(dictionary, "dictionary")
    enc = lookup_join(df, dictionary, code, rows=dictionary.count()).withColumn(idx, F.coalesce(F.col(idx), F.lit(0)))
    return enc, dictionary


def pad_sequences(entities: DataFrame, df: DataFrame, key: str, pos: str, idx: str, t: str,
                  codes_out: str, times_out: str, length: int | None = None, parts: int | None = None) -> DataFrame:
    """Equal-length 0-padded code and time arrays for every entity.  The length
    is that of the longest kept sequence (one number, read if not given).  A null time is 0.
    ``parts``: the rows lie by key in so many parts, to which the entities are dealt."""
    if length is None:
        length = df.agg(F.max(pos) + 1).first()[0]
    seq = df.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(idx).alias("c"),
                                             F.coalesce(F.col(t), F.lit(0.0)).alias("t")))).alias("_s"))
    seq = seq.select(key, F.col("_s.c").alias("_c"), F.col("_s.t").alias("_t"))
    return _padded(entities, seq, key, codes_out, times_out, length, parts)


def _padded(entities: DataFrame, seq: DataFrame, key: str, codes_out: str, times_out: str, length: int,
            parts: int | None = None) -> DataFrame:
    """Every entity with its arrays ``_c`` and ``_t`` of ``seq`` (one row a key), padded to ``length``."""
    longest = F.lit(length).cast("int")
    keys = entities.select(key).repartition(parts, key) if parts else entities.select(key)
    return (keys.join(seq, key, "left")
            .select(key,
                    pad_array(F.coalesce(F.col("_c"), F.array().cast("array<int>")), longest, 0).alias(codes_out),
                    pad_array(F.coalesce(F.col("_t"), F.array().cast("array<double>")), longest, 0.0)
                    .alias(times_out)))


def positioned(events: DataFrame, key: str, code: str, t: str, q: float, prefix: str, width: float = 24.0,
               parts: int | None = None) -> DataFrame:
    """Events with ``pos``, cut at the ``q`` quantile of lengths; the positions are written once, the cut is a filter
    on that table.  ``parts``: the events lie by key in so many parts, and so do the positions."""
    d = sequence_positions(events, key, t, code, width, events if parts else None)
    d = _written(d, f"{prefix}_positions", key, parts)
    return truncate_sequences(d, key, q) if q < 1.0 else d


def encoded_sequence(events: DataFrame, key: str, code: str, t: str, q: float, prefix: str,
                     width: float = 24.0, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events -> (rows with ``pos`` and ``idx``, code dictionary): positioned, cut and encoded.  The rows are a lookup
    over the written positions."""
    return dictionary_encode(positioned(events, key, code, t, q, prefix, width, parts), code)


def sequence_arrays(entities: DataFrame, events: DataFrame, key: str, code: str, t: str, q: float,
                    prefix: str, width: float = 24.0, parts: int | None = None,
                    lie: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events -> (key, <prefix>, <prefix>_times) padded arrays + code dictionary.

    Without a cut (``q`` 1) the dictionary is that of all events.  They are encoded first, and a key's rows
    meet once, in its array, which is sorted by time and by number, which rises as the code does: the place in the array is
    the position, so that rows are neither numbered nor counted by key for that.
    ``parts``: the events lie by key in so many parts, so that only the entities move.
    ``lie``: columns that tell keys apart by the caller's word and by the first of which the events lie; arrays are made there and move
    in place of the rows (without a cut)."""
    largest = F.max(F.coalesce(F.col(t), F.lit(0.0)))
    if q < 1.0:
        kept = positioned(events, key, code, t, q, prefix, width, parts)
        enc, dictionary = dictionary_encode(kept, code)
        top, length = kept.agg(largest, F.max("pos") + 1).first()
    else:
        enc, dictionary = dictionary_encode(events, code)
        by = list(lie or [key])
        top, length = events.groupBy(*by).agg(largest.alias("top"), F.count(F.lit(1)).alias("n")).agg(F.max("top"), F.max("n")).first()
        order = F.struct(F.col(t).isNull().alias("n"), F.col(t).alias("t"), F.col("idx").alias("c"))
        seq = enc.groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("_s"))
        share = lambda x: F.coalesce(F.try_divide(F.coalesce(x, F.lit(0.0)), F.lit(top).cast("double")), F.lit(0.0))
        seq = seq.select(key, F.col("_s.c").alias("_c"), F.transform("_s.t", share).alias("_t"))
        return _padded(entities, seq, key, prefix, f"{prefix}_times", length or 0, parts), dictionary
    # times are divided by the largest time before collecting (pads are 0 and
    # times are >= 0, so this equals dividing the padded arrays by their max)
    enc = enc.withColumn(t, F.try_divide(F.coalesce(F.col(t), F.lit(0.0)), F.lit(top).cast("double")))
    return pad_sequences(entities, enc, key, "pos", "idx", t, prefix, f"{prefix}_times", length or 0, parts), dictionary


def densify_grid(df: DataFrame, entities: DataFrame, key: str, pos: str, fill_cols: dict,
                 length: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Long form of the padded grid: every entity x position 0..L-1, absent cells and nulls
    filled.  L is by default the longest sequence in ``df``, else the one number in ``length``.

    Entities and cells meet in one aggregate (in a join where the rows lie, see ``parts``): a key's cells become a sorted array,
    the gaps between them are filled in that array, and it is unfolded again, so
    that the grid is never shuffled or joined.  Keys that are no entities are left
    out; an entity listed twice gets one grid.  ``parts``: the rows lie by key in so
    many parts, to which the entities are dealt."""
    n = (length if length is not None else df.agg(F.max(pos) + 1)).first()[0]
    kinds = dict(df.dtypes)
    names = list(fill_cols)
    if not n:
        return df.select(key, pos, *names).limit(0)
    cell = F.struct(F.col(pos).cast("int").alias("p"), *[F.col(c).alias(c) for c in names])
    as_array = F.sort_array(F.collect_list("_c")).alias("_s")

    def met(rows: DataFrame, listed: DataFrame) -> DataFrame:
        no_cell = F.lit(None).cast(f"struct<p:int,{','.join(f'{c}:{kinds[c]}' for c in names)}>").alias("_c")
        both = (rows.select(key, cell.alias("_c"), F.lit(None).cast("boolean").alias("_e"))
                .unionByName(listed.select(key, no_cell, F.lit(True).alias("_e"))))
        return both.groupBy(key).agg(as_array, F.max("_e").alias("_e")).filter("_e").select(key, "_s")

    if parts:  # where the rows lie; a null key equals nothing in a join
        arrays = df.select(key, cell.alias("_c")).groupBy(key).agg(as_array)
        listed = entities.select(key).filter(F.col(key).isNotNull()).repartition(parts, key).distinct()
        cells = listed.join(arrays, key, "left").select(key, F.coalesce("_s", F.array()).alias("_s"))
        cells = cells.unionByName(met(df.filter(F.col(key).isNull()), entities.filter(F.col(key).isNull())))
    else:
        cells = met(df, entities)
    empty = F.struct(*[F.lit(fill_cols[c]).cast(kinds[c]).alias(c) for c in names])
    value = lambda e: F.struct(*[F.coalesce(e[c], F.lit(fill_cols[c]).cast(kinds[c])).alias(c) for c in names])
    last = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_s")["p"], i - 1))
    pieces = F.transform("_s", lambda e, i: F.concat(F.array_repeat(empty, e["p"] - last(i) - 1), F.array(value(e))))
    behind = F.lit(int(n)) - 1 - F.coalesce(F.try_element_at(F.col("_s")["p"], F.lit(-1)), F.lit(-1))
    grid = F.concat(F.flatten(pieces), F.array_repeat(empty, behind))
    return cells.select(key, F.posexplode(grid).alias(pos, "_v")).select(key, pos, *[F.col(f"_v.{c}").alias(c) for c in names])


def unique_time_grid(df: DataFrame, t: str, out: str = "t_idx", partitions: int | None = None) -> DataFrame:
    """Sorted unique values of ``t`` with their 0-based index (parallel exact rank)."""
    vals = df.select(t).filter(F.col(t).isNotNull()).distinct()
    return ordered.ranked(vals, t, out, partitions)
