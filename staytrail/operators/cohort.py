"""Cohort building: stays + demographics -> labelled, filtered, enriched stays.

Step order matters (a filter on a derived column must not move across a
window on another key): deaths in the stay are removed first, the trailing
count is taken on the survivors, then the age filter, then the next-stay
label, then the eligibility filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import strings, timefns
from ..functions.mathfns import flag_to_int
from ..session import materialize, materialize_by
from . import ordered, windows
from .ordered import Key
from .aggregates import lump_rare


def join_stays_patients(stays: DataFrame, patients: DataFrame, key: str = "subject_id") -> DataFrame:
    """Inner equi-join of stays and patients (AQE picks broadcast or sort-merge)."""
    return stays.join(patients, key, "inner")


def died_in_stay(dod: Column | str = "dod", out: Column | str = "outtime") -> Column:
    dod = F.col(dod) if isinstance(dod, str) else dod
    out = F.col(out) if isinstance(out, str) else out
    return F.coalesce(dod <= out, F.lit(False))


def exclude_died_in_stay(df: DataFrame, dod: str = "dod", out: str = "outtime") -> DataFrame:
    """Drop stays that end at or after death; an unknown death date keeps the stay."""
    return df.filter(~died_in_stay(dod, out))


def with_birthdate_shift(df: DataFrame, dob: str = "dob", cutoff_year: int = 2000) -> DataFrame:
    return df.withColumn(dob, timefns.shift_obscured_birthdate(
        dob, cutoff_year, rules.OBSCURED_DOB_YEARS, rules.OBSCURED_DOB_DAYS))


def with_age(df: DataFrame, dob: str = "dob", at: str = "outtime", out: str = "age") -> DataFrame:
    return df.withColumn(out, timefns.age_years(dob, at))


def min_age(df: DataFrame, years: float = rules.MIN_AGE_YEARS, age: str = "age") -> DataFrame:
    return df.filter(F.col(age) >= F.lit(float(years)))


def early_death(dod: str = "dod", out: str = "outtime", days: int = rules.EARLY_DEATH_DAYS) -> Column:
    """Death within ``days`` whole days of leaving; unknown death -> False."""
    return F.coalesce(timefns.whole_days_between(out, dod) <= F.lit(days), F.lit(False))


def eligible(df: DataFrame, positive: str = "positive", dod: str = "dod", out: str = "outtime",
             days: int = rules.EARLY_DEATH_DAYS) -> DataFrame:
    """Keep positives, and negatives that did not die soon after leaving."""
    return df.filter(F.col(positive) | ~early_death(dod, out, days))


def next_gap_label(df: DataFrame, key: str = "subject_id", start: str = "intime", end: str = "outtime",
                   tie: str = "icustay_id", within_days: int = rules.READMIT_WITHIN_DAYS,
                   gap: str = "days_to_next", label: str = "positive",
                   bucket_us: int = 30 * timefns.MICROS_PER_DAY, like: DataFrame | None = None) -> DataFrame:
    """Whole days from this stay's end to the start of the next-ending stay of the
    same key; label = gap <= ``within_days`` (no next stay -> False).  The next
    stay is found per (key, 30-day range of end time) plus a carry across
    ranges, so a key with very many stays is not one task.  ``like``: see
    ``ordered``; ``df`` itself if its rows lie by key already."""
    nxt = windows.next_value(df, key, [Key(end), Key(tie, asc=False)], start, "_next_start", width=bucket_us, like=like)
    return (nxt.withColumn(gap, timefns.whole_days_between(end, "_next_start"))
               .withColumn(label, F.coalesce(F.col(gap) <= F.lit(within_days), F.lit(False)))
               .drop("_next_start"))


def link_stays_patients(stays: DataFrame, patients: DataFrame, *, dob_cutoff_year: int = 2000,
                        keep_dod: bool = False) -> DataFrame:
    """Stays x patients -> survivors, trailing count, adults, label, eligible.

    Stays are counted by subject first.  If none has very many, they move by the
    subject once and the adults are written where they lie, for their label."""
    parts = ordered.parts_by(stays.filter(F.col("subject_id").isNotNull()), "subject_id")
    df = join_stays_patients(stays, with_birthdate_shift(patients, "dob", dob_cutoff_year))
    df = exclude_died_in_stay(df)
    df = windows.trailing_count(df, "subject_id", "outtime", rules.RECENT_MIN_DAYS, rules.RECENT_MAX_DAYS,
                                out="num_recent_admissions", parts=parts)
    df = min_age(with_age(df))
    # the label reads the adults twice (next stay in the range, and across ranges)
    adults = materialize_by(df, "adults", "subject_id", parts) if parts else materialize(df, "adults")
    df = eligible(next_gap_label(adults, like=adults if parts else None))
    drop = ["dob", "days_to_next"] + ([] if keep_dod else ["dod"])
    return df.drop(*drop)


def attrition(stays: DataFrame, patients: DataFrame, *, dob_cutoff_year: int = 2000) -> DataFrame:
    """Funnel table: distinct subjects, distinct stays, positives and early deaths
    after each cohort step.

    Stays and patients are joined once and written; the adults among them get
    their label.  Every row carries its steps as bits, which are or-ed per stay and
    per subject (combined before the exchange) and counted by step, so that a
    distinct count costs one row a stay and subject and no row is expanded."""
    df = join_stays_patients(stays, with_birthdate_shift(patients, "dob", dob_cutoff_year))
    df = with_age(df).withColumn("_alive", ~died_in_stay())
    df = df.withColumn("_adult", F.col("_alive") & F.coalesce(F.col("age") >= F.lit(float(rules.MIN_AGE_YEARS)), F.lit(False)))
    df = materialize(df.select("subject_id", "icustay_id", "intime", "outtime", "dod", "_alive", "_adult"), "attrition")
    adults = next_gap_label(df.filter("_adult")).withColumn("_early", early_death())
    cols = ["subject_id", "icustay_id", "_alive", "_adult"]
    flags = adults.select(*cols, "positive", "_early", (F.col("positive") | ~F.col("_early")).alias("_eligible"))
    no = F.lit(False)
    flags = flags.unionByName(df.filter("not _adult").select(*cols, no.alias("positive"), no.alias("_early"), no.alias("_eligible")))
    distinct = {"joined": F.lit(True), "survived_stay": F.col("_alive"), "adult": F.col("_adult"), "eligible": F.col("_eligible")}
    bits = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(distinct.values())), F.lit(0))
    steps = materialize(flags.groupBy("subject_id", "icustay_id").agg(
        F.bit_or(bits).alias("bits"), F.sum(F.col("positive").cast("long")).alias("positive"),
        F.sum(F.col("_early").cast("long")).alias("early_death")), "attrition_steps")

    def counted(key: str) -> DataFrame:
        """(one row) how many values of ``key`` reach each step."""
        per_key = steps.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or("bits").alias("bits"))
        return per_key.agg(*[F.count(F.when(F.col("bits").bitwiseAND(1 << i) != 0, 1)).alias(f"{key}_{name}")
                             for i, name in enumerate(distinct)])

    one = (steps.agg(F.sum("positive").alias("positive"), F.sum("early_death").alias("early_death"))  # one row each
           .crossJoin(F.broadcast(counted("subject_id"))).crossJoin(F.broadcast(counted("icustay_id"))))
    rows = []
    for i, name in enumerate(["joined", "survived_stay", "adult", "positive", "early_death", "eligible"], 1):
        subjects = F.col(f"subject_id_{name}") if name in distinct else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), subjects.alias("subjects"),
                             F.col(f"icustay_id_{name}" if name in distinct else name).alias("stays")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def expect_counts(funnel: DataFrame, expected: dict[str, tuple[int | None, int]]) -> list[str]:
    """Compare a funnel (six rows) with expected (subjects, stays) per stage; returns
    problems.  ``Flow.check_attrition`` raises on them."""
    got = {r["stage"]: (r["subjects"], r["stays"]) for r in funnel.collect()}
    problems = []
    for stage, (subj, stays) in expected.items():
        g = got.get(stage)
        if g is None or (subj is not None and g[0] != subj) or g[1] != stays:
            problems.append(f"{stage}: expected {(subj, stays)}, got {g}")
    return problems


# -- enrichment with admissions and services --------------------------------

def left_join_admissions(cohort: DataFrame, admissions: DataFrame,
                         keys: Sequence[str] = ("subject_id", "hadm_id")) -> DataFrame:
    return cohort.join(admissions, list(keys), "left")


def canonicalise_categories(df: DataFrame) -> DataFrame:
    return (df.withColumn("ethnicity", strings.canonical_category("ethnicity", rules.ETHNICITY_RULES))
              .withColumn("marital_status", strings.canonical_category(
                  "marital_status", rules.MARITAL_RULES, null_as=rules.MARITAL_NULL_AS)))


def first_service(services: DataFrame, key: str = "hadm_id", order: str = "transfertime",
                  value: str = "curr_service", extra: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Earliest row per ``key`` by ``order`` (ties: smallest ``value``) with
    ``min_by`` over a struct: combined before the shuffle, so a hot key costs one
    row a task (Spark runs it as a sort-based aggregate, as structs can't be
    updated in place)."""
    cols = [order, value, *extra]
    rank = F.struct(F.col(order).isNull(), F.col(order), F.col(value).isNull(), F.col(value))  # nulls last
    picked = services.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("_f"))
    return picked.select(key, *[F.col(f"_f.{c}").alias(c) for c in cols])


def surgery_flag(service: Column | str = "curr_service", compat: bool = False) -> Column:
    """Service is surgical: contains SURG, or is ORTHO.  ``compat`` reproduces the
    operator-precedence slip of the original rule, which is never true."""
    s = F.col(service) if isinstance(service, str) else service
    if compat:
        return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return s.contains("SURG") | (s == F.lit("ORTHO"))


def left_join_first_service(cohort: DataFrame, services: DataFrame, keys: Sequence[str] = ("subject_id", "hadm_id"),
                            order_col: str = "transfertime", compat: bool = False) -> DataFrame:
    first = first_service(services, "hadm_id", order_col).withColumn("surgery", surgery_flag(compat=compat))
    return cohort.join(first, list(keys), "left")


def with_admissions(cohort: DataFrame, admissions: DataFrame) -> DataFrame:
    return canonicalise_categories(left_join_admissions(cohort, admissions.drop("dischtime")))


def finish_categories(df: DataFrame, min_count: int = rules.RARE_MIN_COUNT) -> DataFrame:
    df = lump_rare(df, rules.CATEGORY_COLUMNS, min_count, rules.RARE_CATEGORY)
    for c in rules.CATEGORY_COLUMNS:
        df = df.withColumn(c, strings.title_case(c))
    df = df.withColumn("pre_icu_los", timefns.fractional_days("admittime", "intime", clamp=True))
    return df.drop("admittime")


def link_admissions(cohort: DataFrame, admissions: DataFrame, min_count: int = rules.RARE_MIN_COUNT) -> DataFrame:
    return finish_categories(with_admissions(cohort, admissions), min_count)


def link_services(cohort: DataFrame, services: DataFrame, compat: bool = False) -> DataFrame:
    df = left_join_first_service(cohort, services, compat=compat)
    df = df.withColumn("elective_surgery",
                       flag_to_int((F.col("admission_type") == F.lit("ELECTIVE")) & F.col("surgery")))
    return df.drop("transfertime", "curr_service", "admission_type", "surgery")


COHORT_COLUMNS = ["subject_id", "hadm_id", "icustay_id", "intime", "outtime", "los", "gender",
                  "num_recent_admissions", "age", "positive", "admission_location", "insurance", "marital_status",
                  "ethnicity", "pre_icu_los", "elective_surgery"]


def build_cohort(stays: DataFrame, patients: DataFrame, admissions: DataFrame, services: DataFrame, *,
                 dob_cutoff_year: int = 2000, compat: bool = False) -> DataFrame:
    """The full labelled cohort, one row per eligible stay.

    Admissions and services are joined by the same keys, one after the other, so
    that the stays move once for both; categories are lumped after that."""
    df = link_stays_patients(stays, patients, dob_cutoff_year=dob_cutoff_year)
    df = link_services(with_admissions(df, admissions), services, compat=compat)
    return finish_categories(df).select(*COHORT_COLUMNS)
