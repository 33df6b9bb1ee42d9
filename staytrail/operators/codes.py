"""Diagnosis/procedure codes known at the end of each stay (temporal history join)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import strings, timefns
from ..functions.timefns import MICROS_PER_DAY, epoch_micros
from ..session import materialize, materialize_by
from .aggregates import drop_duplicates, lump_rare


def union_tagged(tables: Mapping[str, DataFrame], code: str = "icd9_code") -> DataFrame:
    """Drop incomplete rows, prefix + normalise the code of each table, union all."""
    out = None
    for prefix, df in tables.items():
        d = df.na.drop("any").withColumn(code, strings.normalise_code(code, prefix))
        out = d if out is None else out.unionByName(d)
    return out


def join_codes_admissions(codes: DataFrame, admissions: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Attach the admission's start/end time to every code (inner, N:1)."""
    return codes.join(admissions.select(key, "admittime", "dischtime"), key, "inner").drop(key)


def known_by(df: DataFrame, known_at: str = "admittime", as_of: str = "outtime") -> DataFrame:
    """Keep a code if its admission began by ``as_of``, or if either time is unknown
    (this also keeps the single null row of a stay that has no codes)."""
    return df.filter(F.coalesce(F.col(known_at) <= F.col(as_of), F.lit(True)))


#: width of the time buckets of the history join
BUCKET_DAYS = 30
#: bucket of history rows without a time; it lies before all others
UNTIMED = -2 ** 62


def bucket_pairs(asked: DataFrame, hist: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, _list: buckets of its key, _sb: its own or null) with the rows of ``hist`` (key, _hb) in its own
    and earlier buckets."""
    upto = F.filter("_list", lambda b: F.col("_sb").isNull() | (b <= F.col("_sb")))
    return asked.withColumn("_hb", F.explode(upto)).drop("_list").join(hist, [key, "_hb"])


#: pairs of a key's stays and history rows beyond which the key is joined by time bucket
HOT_PAIRS = 4_000_000
#: pairs of stays and history rows that a task takes about (keys stay whole)
PART_PAIRS = 1_000_000


def point_in_time_history(stays: DataFrame, history: DataFrame, key: str = "subject_id",
                          known_at: str = "admittime", as_of: str = "outtime", bucket_days: int = BUCKET_DAYS,
                          hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Each stay with every history row of its key that was known by the stay's end.

    Rows are kept as by a left join on the key followed by the as-of filter: a stay
    whose rows are all in the future disappears, a stay without rows keeps one null
    row, rows or stays without a time match.  History rows are deduplicated first.

    The history is written as it is, and its rows and the stays are counted by key.
    Keys with up to ``hot_pairs`` pairs of both are deduplicated and joined where
    their rows lie by key, so that history moves once and the result still lies by
    key.  They are dealt into as many parts as the counted pairs ask for (``PART_PAIRS``): the
    rows grow in the join, so the size of what moves says little about a task's work.  All others are joined by time bucket: a key's non-empty buckets are a short list; a stay
    takes those up to its own from it and meets history by (key, bucket).  Rows of
    earlier buckets are known without a look at their times, only the stay's own
    bucket is filtered, and later ones are never joined.  A subject with very many
    codes is split by its buckets, and further by adaptive skew handling."""
    return _history(stays, history, key, known_at, as_of, bucket_days, hot_pairs)[0]


def _history(stays: DataFrame, history: DataFrame, key: str, known_at: str, as_of: str, bucket_days: int = BUCKET_DAYS,
             hot_pairs: int = HOT_PAIRS, counted: tuple | None = None) -> tuple[DataFrame, int | None]:
    """``point_in_time_history``, and the number of parts by ``key`` in which its rows lie (None with hot keys).
    ``counted``: what ``_counted`` found, if it ran already."""
    others = [c for c in history.columns if c != key]
    columns = [key, *[c for c in stays.columns if c != key]]
    hist, hot, parts = counted or _counted(stays, history, key, hot_pairs)

    def by_key(asked: DataFrame, rows: DataFrame) -> DataFrame:
        met = asked.repartition(parts, key).join(rows.repartition(parts, key).dropDuplicates(), key, "left")
        return known_by(met, known_at, as_of).select(*columns, *others)

    if hot is None:
        return by_key(stays, hist), parts
    light = by_key(stays.join(hot, key, "left_anti"), hist.join(hot, key, "left_anti"))
    return light.unionByName(_by_bucket(stays.join(hot, key, "left_semi"), hist.join(hot, key, "left_semi"), key, known_at, as_of,
                                        bucket_days).select(*columns, *others)), None


def _counted(stays: DataFrame, history: DataFrame, key: str, hot_pairs: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The written history, the keys with more than ``hot_pairs`` pairs (None: no key) and the number of parts for all others."""
    hist = materialize(history.filter(F.col(key).isNotNull()), "history")
    sizes = (hist.groupBy(key).agg(F.count(F.lit(1)).alias("_h"))
             .join(stays.groupBy(key).agg(F.count(F.lit(1)).alias("_s")), key)
             .select(key, (F.col("_h") * F.col("_s")).alias("_pairs")))
    is_hot = F.col("_pairs") > hot_pairs
    n = sizes.agg(F.sum(F.when(~is_hot, F.col("_pairs"))).alias("light"), F.count(F.when(is_hot, 1)).alias("hot")).first()
    parts = max(stays.sparkSession.sparkContext.defaultParallelism, -(-(n["light"] or 0) // PART_PAIRS))
    return hist, materialize(sizes.filter(is_hot).select(key), "hot_keys") if n["hot"] else None, parts


def _by_bucket(stays: DataFrame, history: DataFrame, key: str, known_at: str, as_of: str, bucket_days: int) -> DataFrame:
    """The same for keys that all have history, by time bucket."""
    bucket = lambda t: F.floor(epoch_micros(t) / F.lit(bucket_days * MICROS_PER_DAY)).cast("long")
    hist = materialize(history.dropDuplicates().withColumn("_hb", F.coalesce(bucket(known_at), F.lit(UNTIMED))), "history_hot")
    lists = hist.groupBy(key).agg(F.collect_set("_hb").alias("_list"))
    met = bucket_pairs(stays.join(lists, key).withColumn("_sb", bucket(as_of)), hist, key)
    return met.filter(F.col("_sb").isNull() | (F.col("_hb") < F.col("_sb")) | (F.col(known_at) <= F.col(as_of)))


def one_key(stays: DataFrame, key: str = "subject_id", stay: str = "icustay_id") -> bool:
    """Whether each stay id belongs to one key."""
    keys = stays.select(stay, F.struct(key).alias("_k")).groupBy(stay).agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    return keys.filter(~F.col("lo").eqNullSafe(F.col("hi"))).isEmpty()


def distinct_known(known: DataFrame, stays: DataFrame, cols: Sequence[str], key: str = "subject_id",
                   stay: str = "icustay_id") -> DataFrame:
    """Distinct ``cols`` (``stay`` is one) of the rows of ``point_in_time_history``, compared where they lie by ``key``.

    That takes each stay id to belong to one key; it is looked up in ``stays``, and where it is not
    so, rows meet by all of ``cols``."""
    together = one_key(stays, key, stay)
    return drop_duplicates(known.select(key, *cols), within=key) if together else drop_duplicates(known.select(*cols))


def _in_micros(stays: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their ends as numbers, which they become before the rows grow."""
    return stays.withColumn("_out", epoch_micros("outtime")), codes.withColumn("dischtime", epoch_micros("dischtime"))


def _days_known(known: DataFrame) -> DataFrame:
    days = timefns.days_of_micros(F.col("_out") - F.col("dischtime"))
    return known.select("subject_id", "icustay_id", "icd9_code", days.alias("days_to_out"))


def known_codes(stays: DataFrame, codes: DataFrame) -> tuple[DataFrame, int | None]:
    """Stays with the codes known at their end and ``days_to_out``, and the number of parts by subject in which
    the rows lie (see ``_history``)."""
    asked, history = _in_micros(stays, codes)
    known, parts = _history(asked, history, "subject_id", "admittime", "outtime")
    return _days_known(known), parts


KNOWN = ["icustay_id", "icd9_code", "days_to_out"]
#: microseconds under which different numbers of them are different days, as a double
EXACT_MICROS = 2 ** 52


def _known_once(asked: DataFrame, hist: DataFrame, parts: int) -> DataFrame | None:
    """The distinct rows of ``known_codes`` without a look at the rows after they grew, of inputs as ``_history`` has them
    written and counted; None where that can't be told from what is known before.

    It takes stays that are listed once each.  Of a subject's history rows with one code and one end the earliest
    is enough: if any is known, it is.  Those left have different ends, so that rows of a stay
    and a code are equal only where both ends are not before that of the stay (0 days), or where that is unknown.  Of the rows
    in order of their start those before a known one are known, so that a row is the first with 0 days if the
    latest end before it (``_before``) is earlier than the stay's."""
    listed = asked.groupBy("icustay_id").agg(F.count(F.lit(1)).alias("n"), F.max("_out").alias("out")).agg(
        F.max("n").alias("n"), F.max("out").alias("out")).first()
    earliest = hist.agg(F.min("dischtime")).first()[0]
    if (listed["n"] or 0) > 1 or (listed["out"] or 0) - (earliest or 0) >= EXACT_MICROS:
        return None
    begin = F.when(F.count("admittime") == F.count(F.lit(1)), F.min("admittime")).alias("admittime")  # null is earliest
    rows = hist.repartition(parts, "subject_id").groupBy("subject_id", "icd9_code", "dischtime").agg(begin)
    order = Window.partitionBy("subject_id", "icd9_code").orderBy(F.col("admittime").asc_nulls_first(), "dischtime")
    rows = (rows.withColumn("_before", F.max("dischtime").over(order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_first", F.row_number().over(order) == 1))
    met = known_by(asked.repartition(parts, "subject_id").join(rows, "subject_id", "left"))
    apart = F.coalesce(F.col("dischtime") < F.col("_out"), F.lit(True)) | F.coalesce(F.col("_before") < F.col("_out"), F.lit(True))
    return _days_known(met.filter(F.when(F.col("_out").isNull(), F.coalesce("_first", F.lit(True))).otherwise(apart)))


def diag_proc_by_subject(cohort: DataFrame, diagnoses: DataFrame, procedures: DataFrame, admissions: DataFrame,
                         min_count: int = rules.RARE_MIN_COUNT) -> tuple[DataFrame, list[str]]:
    """``diag_proc`` and the columns that tell stays apart, so that steps by stay need no exchange: the
    subject and the stay, where each stay belongs to one subject and the table is written by subject; else the stay."""
    codes = union_tagged({rules.DIAG_PREFIX: diagnoses.select("subject_id", "hadm_id", "icd9_code"),
                          rules.PROC_PREFIX: procedures.select("subject_id", "hadm_id", "icd9_code")})
    codes = join_codes_admissions(codes, admissions)
    stays = cohort.select("subject_id", "icustay_id", "outtime")
    asked, history = _in_micros(stays, codes)
    counted = _counted(asked, history, "subject_id", HOT_PAIRS)
    hist, hot, parts = counted
    once = _known_once(asked, hist, parts) if hot is None else None
    if once is None:
        known, parts = _history(asked, history, "subject_id", "admittime", "outtime", counted=counted)
        known = _days_known(known)
    keys = ["subject_id", "icustay_id"]
    if once is not None:
        known = materialize_by(once, "known", "subject_id", parts)
    elif parts and one_key(stays):
        known = materialize_by(drop_duplicates(known, ["subject_id", *KNOWN]), "known", "subject_id", parts)
    else:
        keys = ["icustay_id"]
        known = materialize(drop_duplicates(known.select(*KNOWN)), "known")
    return lump_rare(known, ["icd9_code"], min_count, rules.RARE_CODE, materialize_input=False), keys


def diag_proc(cohort: DataFrame, diagnoses: DataFrame, procedures: DataFrame, admissions: DataFrame,
              min_count: int = rules.RARE_MIN_COUNT) -> DataFrame:
    """(icustay_id, icd9_code, days_to_out): codes known at discharge, with the
    days from the code's admission end to the stay end (clamped at 0),
    deduplicated, rare codes lumped."""
    return diag_proc_by_subject(cohort, diagnoses, procedures, admissions, min_count)[0].select(*KNOWN)
