"""Measured events: select, convert, check, type, sum, derive, bin, compress.

All rules come from ``staytrail.rules``; the per-item ones are a fixed table of
116 rows that is broadcast, so cleaning is one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import timefns
from ..session import materialize
from . import windows
from .ordered import Key
from .aggregates import daily_sum, pivot_mean


def stay_id_from_text(c: str) -> Column:
    """Ids stored as float text ('123.0') -> integer id."""
    return F.col(c).cast("double").cast("long")


def observed(df: DataFrame, items: Sequence[int], stay: str = "icustay_id", value: str = "valuenum",
             item: str = "itemid", compat: bool = False) -> DataFrame:
    """Rows with a stay, a value, a listed item and a positive value.  ``compat``
    keeps the original precedence slip that only drops zero values."""
    positive = (F.col(value) != F.lit(0.0)) if compat else (F.col(value) > F.lit(0.0))
    return df.filter(F.col(stay).isNotNull() & F.col(value).isNotNull() & F.col(item).isin(list(items)) & positive)


ITEM_RULES_SCHEMA = "itemid INT, ce_type STRING, unit_op STRING, lo DOUBLE, hi DOUBLE, selected BOOLEAN"


def item_rules(spark) -> DataFrame:
    """The fixed per-item rule table (116 rows).  Built with ``createDataFrame``:
    measured faster than an equivalent literal-array expression, whose large
    generated code costs seconds per query."""
    return spark.createDataFrame(rules.item_rule_rows(), ITEM_RULES_SCHEMA)


def convert_by_op(op: Column | str, v: Column | str) -> Column:
    """Metric value from a unit operation name (fractions only when <= 1)."""
    op = F.col(op) if isinstance(op, str) else op
    v = F.col(v) if isinstance(v, str) else v
    return (F.when(op == "f_to_c", (v - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0))
             .when(op == "lb_to_kg", v / F.lit(2.205))
             .when(op == "oz_to_kg", v / F.lit(35.274))
             .when(op == "inch_to_cm", v * F.lit(2.54))
             .when((op == "frac_to_perc") & (v <= F.lit(1.0)), v * F.lit(100.0))
             .otherwise(v))


def label_items(df: DataFrame) -> DataFrame:
    """Rows with the event type of their item, ``ce_type`` (null when the id is in no list)."""
    types = item_rules(df.sparkSession).select("itemid", "ce_type")
    return df.join(F.broadcast(types), "itemid", "left")


def converted(df: DataFrame, value: str = "valuenum", out: str = "converted") -> DataFrame:
    """Rows of listed items with ``value`` in metric units."""
    ops = item_rules(df.sparkSession).select("itemid", "unit_op")
    return df.join(F.broadcast(ops), "itemid").withColumn(out, convert_by_op("unit_op", value)).drop("unit_op")


def clean_chart_events(df: DataFrame, items: Sequence[int] = tuple(rules.RELEVANT_IDS)) -> DataFrame:
    """Raw chart events -> (subject_id, hadm_id, icustay_id, charttime, valuenum, ce_type).

    The listed-item filter is pushed to the scan; the per-item rules (type, unit
    operation, plausible range) come from a broadcast of the fixed 116-row rule
    table, so conversion and range check are a few column expressions in the
    same codegen stage (no shuffle, and no large CASE repeated per reference).
    Row-local only, so the same function serves batch and streaming ingest."""
    d = observed(df, items).join(F.broadcast(item_rules(df.sparkSession)), "itemid")
    d = d.withColumn("valuenum", convert_by_op("unit_op", "valuenum"))
    v = F.col("valuenum")
    ok = (v > F.lit(0.0)) & F.coalesce(v >= F.col("lo"), F.lit(True)) & F.coalesce(v <= F.col("hi"), F.lit(True))
    return d.filter(ok).select("subject_id", "hadm_id", stay_id_from_text("icustay_id").alias("icustay_id"),
                               "charttime", "valuenum", "ce_type")


# -- output events ------------------------------------------------------------

def select_items(d_items: DataFrame, ids: Sequence[int] = tuple(rules.URINE_OUTPUT)) -> DataFrame:
    """Listed items; labels lower-cased; per-hour / per-kg measures dropped unless
    they are nephrostomy outputs."""
    d = d_items.filter(F.col("itemid").isin(list(ids))).withColumn("label", F.lower("label"))
    bad = None
    for part in rules.ITEM_LABEL_DROP:
        e = F.col("label").contains(part)
        bad = e if bad is None else (bad | e)
    return d.filter(~bad | F.col("label").contains(rules.ITEM_LABEL_KEEP))


def restrict_to_items(events: DataFrame, items: DataFrame, key: str = "itemid") -> DataFrame:
    """Semi-join events to a (small) item dictionary."""
    return events.join(items.select(key), key, "left_semi")


def daily_outputs(outputs: DataFrame, items: DataFrame, cap: float = rules.OUTPUT_CAP,
                  compat: bool = False) -> DataFrame:
    """(icustay_id, chartday, valuenum, ce_type): plausible urine output summed per
    stay and calendar day, rows and daily sums above ``cap`` removed."""
    d = outputs.withColumnRenamed("value", "valuenum")
    d = observed(restrict_to_items(d, items), rules.URINE_OUTPUT, compat=compat)
    d = d.withColumn("icustay_id", stay_id_from_text("icustay_id"))
    d = d.filter(~(F.col("valuenum") > F.lit(cap)))
    d = daily_sum(d, "icustay_id", "charttime", "valuenum")
    d = d.filter(~(F.col("valuenum") > F.lit(cap)))
    return d.withColumn("ce_type", F.lit("URINE_OUTPUT"))


def exclude_boundary_days(events: DataFrame, stays: DataFrame, key: str = "icustay_id", day: str = "chartday",
                          start: str = "intime", end: str = "outtime") -> DataFrame:
    """Remove events on the first or last calendar day of their stay (one anti-join
    against the distinct (stay, boundary day) pairs)."""
    bounds = (stays.select(key, F.to_date(start).alias(day))
              .unionByName(stays.select(key, F.to_date(end).alias(day))).dropDuplicates())
    return events.join(bounds, [key, day], "left_anti")


def reduce_outputs(outputs: DataFrame, d_items: DataFrame, stays: DataFrame, compat: bool = False) -> DataFrame:
    """(icustay_id, charttime, valuenum, ce_type) with charttime at midday."""
    d = daily_outputs(outputs, select_items(d_items), compat=compat)
    d = exclude_boundary_days(d, stays)
    return d.select("icustay_id", timefns.midday(F.col("chartday")).alias("charttime"), "valuenum", "ce_type")


# -- derived events -----------------------------------------------------------

def derive_bmi(chart: DataFrame) -> DataFrame:
    """BMI from weight and height at the same time point; height filled forward
    then backward within subject (ordered by stay, then time)."""
    wh = chart.filter(F.col("ce_type").isin("WEIGHT", "HEIGHT"))
    p = pivot_mean(wh, ["subject_id", "icustay_id", "charttime"], "ce_type", "valuenum", ["HEIGHT", "WEIGHT"])
    p = materialize(p, "weights")  # each fill reads it several times
    p = windows.fill_both(p, "subject_id", ["icustay_id", "charttime"], "HEIGHT")
    p = p.na.drop("any")
    return p.select("subject_id", "icustay_id", "charttime",
                    (F.col("WEIGHT") / F.col("HEIGHT") / F.col("HEIGHT") * F.lit(10000.0)).alias("valuenum"),
                    F.lit("BMI").alias("ce_type"))


GCS_PARTS = ["GCS_EYE_OPENING", "GCS_VERBAL_RESPONSE", "GCS_MOTOR_RESPONSE"]


def derive_total_if_missing(chart: DataFrame, total: str = "GCS_TOTAL", parts: Sequence[str] = tuple(GCS_PARTS)) -> DataFrame:
    """Total = recorded total, else sum of the parts at the same time point; rows
    where it is still unknown are dropped."""
    types = [*parts, total]
    g = chart.filter(F.col("ce_type").isin(types))
    p = pivot_mean(g, ["subject_id", "icustay_id", "charttime"], "ce_type", "valuenum", types)
    parts_sum = None
    for c in parts:
        parts_sum = F.col(c) if parts_sum is None else parts_sum + F.col(c)
    return (p.withColumn("valuenum", F.coalesce(F.col(total), parts_sum)).filter(F.col("valuenum").isNotNull())
             .select("subject_id", "icustay_id", "charttime", "valuenum", F.lit(total).alias("ce_type")))


def replace_with_derived(chart: DataFrame, include_bmi_source: bool = True) -> DataFrame:
    """Derived BMI and GCS totals replace their source rows; other types pass.  Reads
    ``chart`` three times: give it a written table."""
    sources = ["WEIGHT", "HEIGHT", *GCS_PARTS, "GCS_TOTAL"]
    base = chart.select("subject_id", "icustay_id", "charttime", "valuenum", "ce_type")
    others = base.filter(~F.col("ce_type").isin(sources))
    out = derive_bmi(base).unionByName(derive_total_if_missing(base)).unionByName(others)
    return out.drop("subject_id")


# -- binning and run compression ---------------------------------------------

def bin_right_closed(ce_type: Column | str = "ce_type", v: Column | str = "valuenum",
                     include_bmi: bool = False) -> Column:
    """Label of the (lo, hi] bin of the value's type; null outside every bin."""
    t = F.col(ce_type) if isinstance(ce_type, str) else ce_type
    v = F.col(v) if isinstance(v, str) else v
    expr = None
    for typ, lo, hi, label in rules.bin_rules(include_bmi):
        cond = (t == F.lit(typ)) & (v > F.lit(lo)) & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def binned_events(charts: DataFrame, outputs: DataFrame, include_bmi: bool = False) -> DataFrame:
    """Union charts and outputs, keep binned types, add ``valuecat``."""
    types = rules.BINNED_TYPES + (["BMI"] if include_bmi else [])
    cols = ["icustay_id", "charttime", "valuenum", "ce_type"]
    d = charts.select(*cols).unionByName(outputs.select(*cols)).filter(F.col("ce_type").isin(types))
    return d.withColumn("valuecat", bin_right_closed("ce_type", "valuenum", include_bmi))


def run_order() -> list[Key]:
    """Latest first; equal times ordered by category (nulls first)."""
    return [Key("charttime", asc=False), Key("valuecat", nulls_first=True)]


def compress_runs(binned: DataFrame, bucket_us: int = timefns.MICROS_PER_DAY) -> DataFrame:
    """Per (type, stay), read latest first, keep only category change points
    (two-level: per (type, stay, day) plus a carry across days).  Reads ``binned``
    twice: give it a written table."""
    d = windows.drop_consecutive_repeats(binned, ["ce_type", "icustay_id"], run_order(), "valuecat", bucket_us)
    return d.select("icustay_id", "charttime", "valuecat", "ce_type")


def last_only(runs: DataFrame) -> DataFrame:
    """Most recent category per (type, stay)."""
    return windows.latest_per_group(runs, ["ce_type", "icustay_id"], "charttime", "valuecat")
