"""Event operators: flags, right-closed bins, run compression, fills and BMI."""

import pytest
from conftest import ts
from pyspark.sql import functions as F

from staytrail.operators import cohort, events, windows


def test_surgery_flag(spark):
    df = spark.createDataFrame([("CSURG",), ("ORTHO",), ("MED",)], "curr_service string")
    assert [r[0] for r in df.select(cohort.surgery_flag()).collect()] == [True, True, False]
    assert [r[0] for r in df.select(cohort.surgery_flag(compat=True)).collect()] == [False, False, False]


def test_output_value_filter(spark):
    df = spark.createDataFrame([("1.0", 40055, 1.0), ("1.0", 40055, -2.0), ("1.0", 40055, 0.0),
                                ("1.0", 40055, None)], "icustay_id string, itemid int, valuenum double")
    assert [r.valuenum for r in events.observed(df, [40055]).collect()] == [1.0]
    assert sorted(r.valuenum for r in events.observed(df, [40055], compat=True).collect()) == [-2.0, 1.0]


@pytest.mark.parametrize("typ,vals,want", [
    ("GCS_TOTAL", [-1, 7, 7.5, 13, 15, 16], [None, "CHART_GC_m3", "CHART_GC_m2", "CHART_GC_m2", "CHART_GC_n", None]),
    ("BODY_TEMPERATURE", [-1, 33.21, 33.22, 40], [None, "CHART_BT_m3", "CHART_BT_m2", "CHART_BT_p2"]),
])
def test_bins_right_closed(spark, typ, vals, want):
    df = spark.createDataFrame([(typ, float(v)) for v in vals], "ce_type string, valuenum double")
    assert [r[0] for r in df.select(events.bin_right_closed()).collect()] == want


def test_runs(spark):
    rows = [(1, 6, "n"), (1, 5, "n"), (1, 4, "p1"), (1, 3, "n"), (1, 2, None), (2, 9, "n"), (2, 8, "n")]
    df = spark.createDataFrame([(s, ts(f"2100-01-0{t} 00:00"), c, "T") for s, t, c in rows],
                               "icustay_id long, charttime timestamp_ntz, valuecat string, ce_type string")
    out = events.compress_runs(df)
    got = sorted((r.icustay_id, r.charttime.day, r.valuecat) for r in out.collect())
    assert got == [(1, 2, None), (1, 3, "n"), (1, 4, "p1"), (1, 6, "n"), (2, 9, "n")]
    again = sorted((r.icustay_id, r.charttime.day, r.valuecat) for r in events.compress_runs(out).collect())
    assert again == got  # idempotent
    last = {r.icustay_id: r.charttime.day for r in events.last_only(out).collect()}
    assert last == {1: 6, 2: 9}


def test_fill_and_bmi(spark):
    rows = [(1, 1, 1, None, 70.0), (1, 1, 2, 170.0, 71.0), (1, 2, 3, None, None), (1, 2, 4, 180.0, 90.0),
            (1, 3, 5, None, 81.0), (2, 4, 6, None, 60.0)]
    long_rows = []
    for s, k, t, h, w in rows:
        for typ, v in (("HEIGHT", h), ("WEIGHT", w)):
            if v is not None:
                long_rows.append((s, k, ts(f"2100-01-0{t} 00:00"), v, typ))
    df = spark.createDataFrame(long_rows, "subject_id long, icustay_id long, charttime timestamp_ntz, valuenum double,"
                                          " ce_type string")
    got = sorted((r.charttime.day, round(r.valuenum, 6)) for r in events.derive_bmi(df).collect())
    assert got == [(1, 24.221453), (2, 24.567474), (4, 27.777778), (5, 25.0)]


def test_derive_total(spark):
    rows = [(1, 1, "GCS_EYE_OPENING", 4.0), (1, 1, "GCS_VERBAL_RESPONSE", 5.0), (1, 1, "GCS_MOTOR_RESPONSE", 6.0),
            (1, 2, "GCS_TOTAL", 9.0), (1, 2, "GCS_EYE_OPENING", 1.0), (1, 3, "GCS_EYE_OPENING", 2.0)]
    df = spark.createDataFrame([(s, 7, ts(f"2100-01-0{t} 00:00"), v, c) for s, t, c, v in rows],
                               "subject_id long, icustay_id long, charttime timestamp_ntz, valuenum double, ce_type string")
    got = sorted((r.charttime.day, r.valuenum) for r in events.derive_total_if_missing(df).collect())
    assert got == [(1, 15.0), (2, 9.0)]


def test_boundary_days(spark):
    stays = spark.createDataFrame([(1, ts("2100-01-01 08:00"), ts("2100-01-04 10:00"))],
                                  "icustay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    rows = [("1.0", 40055, ts(f"2100-01-0{d} 0{h}:00"), v) for d, h, v in
            [(1, 1, 5.0), (2, 1, 300.0), (2, 2, 400.0), (3, 1, 9000.0), (3, 2, 2000.0), (4, 1, 7.0)]]
    outs = spark.createDataFrame(rows, "icustay_id string, itemid int, charttime timestamp_ntz, value double")
    items = spark.createDataFrame([(40055, "Foley", "ml", "outputevents")], "itemid int, label string, unitname string,"
                                                                           " linksto string")
    got = [(r.icustay_id, r.charttime, r.valuenum) for r in events.reduce_outputs(outs, items, stays).collect()]
    assert got == [(1, ts("2100-01-02 12:00"), 700.0)]


def test_latest_per_group_ties(spark):
    df = spark.createDataFrame([("T", 1, ts("2100-01-02 00:00"), "b"), ("T", 1, ts("2100-01-02 00:00"), "a"),
                                ("T", 1, ts("2100-01-01 00:00"), "z")],
                               "ce_type string, icustay_id long, charttime timestamp_ntz, valuecat string")
    r = windows.latest_per_group(df, ["ce_type", "icustay_id"], "charttime", "valuecat").collect()
    assert [(x.valuecat, x.charttime.day) for x in r] == [("a", 2)]
