"""Scalar functions against the hand-checked values of the fixtures."""

import pytest
from conftest import ts
from pyspark.sql import functions as F

from staytrail import rules
from staytrail.functions import arrays, mathfns, strings, timefns
from staytrail.operators import events


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_title_case(spark):
    got = one(spark, strings.title_case("s"), [("MARRIED/LIFE PARTNER",), ("**INFO NOT AVAILABLE**",),
                                               ("O'NEIL-X 2ND",), (None,)], "s string")
    assert got == ["Married/Life Partner", "**Info Not Available**", "O'Neil-X 2Nd", None]


def test_normalise(spark):
    assert one(spark, strings.normalise_drug("s", "PRESC_"), [(" A b\t",), ("X  y",)], "s string") == \
        ["PRESC_ab", "PRESC_xy"]
    assert one(spark, strings.normalise_code("s", "DIAGN_"), [("  V12 ",)], "s string") == ["DIAGN_v12"]


def test_canonical_category(spark):
    got = one(spark, strings.canonical_category("s", rules.ETHNICITY_RULES),
              [("WHITE - OTHER EUROPEAN",), ("PATIENT DECLINED TO ANSWER",), ("ASIAN - OTHER",), (None,)], "s string")
    assert got == ["WHITE", "OTHER/UNKNOWN", "ASIAN", None]
    got = one(spark, strings.canonical_category("s", rules.MARITAL_RULES, "UNKNOWN"),
              [(None,), ("SEPARATED",), ("LIFE PARTNER",)], "s string")
    assert got == ["OTHER/UNKNOWN", "WIDOWED/DIVORCED/SEPARATED", "MARRIED/LIFE PARTNER"]


def test_dates(spark):
    got = one(spark, timefns.shift_obscured_birthdate("d", 2000, 209, 146), [(ts("1812-02-29 00:00"),)],
              "d timestamp_ntz")
    assert got == [ts("2020-10-05 00:00")]
    df = spark.createDataFrame([(ts("2100-01-01 01:00"), ts("2100-01-01 00:00")),
                                (ts("2100-01-01 00:00"), ts("2100-01-02 01:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(timefns.whole_days_between("a", "b")).collect()] == [-1, 1]
    got = [r[0] for r in df.select(timefns.fractional_days("a", "b")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(25 / 24)
    assert one(spark, timefns.midday("d"), [(ts("2100-03-04 17:45"),)], "d timestamp_ntz") == [ts("2100-03-04 12:00")]


def test_clamp_keeps_null(spark):
    assert one(spark, timefns.clamp_negative(F.col("x")), [(-0.5,), (None,), (2.0,)], "x double") == [0.0, None, 2.0]


def test_convert_units(spark):
    rows = [(678, 98.6), (3581, 154.0), (3582, 352.0), (1394, 70.0), (189, 1.0), (189, 1.01), (211, 80.0)]
    df = events.converted(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, itemid int, valuenum double"))
    got = [r.converted for r in df.orderBy("k").collect()]
    assert got == pytest.approx([37.0, 69.841270, 9.979021, 177.8, 100.0, 1.01, 80.0], abs=1e-6)


def test_round_times_half_even(spark):
    assert one(spark, mathfns.round_times("x", 3), [(0.0005,), (0.0015,)], "x double") == [0.0, 0.002]


def test_time_delta_array(spark):
    got = one(spark, arrays.time_delta_array("t"), [([0.1, 0.4, 0.4, 0.0],)], "t array<double>")[0]
    assert got == pytest.approx([0.1, 0.3, 0.0, 0.0])


def test_bce(spark):
    got = one(spark, mathfns.bce_with_logits("x", "y", 3.0), [(0.0, 1), (2.0, 0)], "x double, y int")
    assert got == pytest.approx([2.079442, 2.126928], abs=1e-6)
