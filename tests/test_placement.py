"""Rows that lie by their key move once, keys of any size give the same rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import ts
from staytrail.operators import cohort, joins, ordered, sequences

COHORT = [(1, ts("2020-01-05 00:00")), (2, ts("2020-01-06 00:00")), (2, ts("2020-01-07 00:00")), (3, ts("2020-01-08 00:00")),
          (None, ts("2020-01-09 00:00"))]
CHART = [(1, "HR low", ts("2020-01-01 00:00")), (1, "HR low", ts("2020-01-01 00:00")), (1, None, ts("2020-01-02 00:00")),
         (2, "HR high", None), (2, "HR low", ts("2020-01-03 00:00")), (9, "HR low", ts("2020-01-01 00:00")),
         (None, "HR low", ts("2020-01-01 00:00"))]
MEDS = [("1.0", "ASPIRIN ", ts("2020-01-02 00:00")), ("2.0", "ASPIRIN ", ts("2020-01-02 00:00")), (None, "ASPIRIN ", ts("2020-01-02 00:00")),
        ("7.0", "ASPIRIN ", ts("2020-01-02 00:00")), ("2.0", None, ts("2020-01-02 00:00"))]


def exchanges(df) -> list[str]:
    """The exchanges by hash in the plan (before it runs)."""
    return re.findall(r"Exchange hashpartitioning\([^\n]*", df._jdf.queryExecution().executedPlan().toString())


def stay_tables(spark):
    return (spark.createDataFrame(COHORT, "icustay_id long, outtime timestamp_ntz"),
            spark.createDataFrame(CHART, "icustay_id long, valuecat string, charttime timestamp_ntz"),
            spark.createDataFrame(MEDS, "icustay_id string, drug string, startdate timestamp_ntz"))


def rows(df) -> Counter:
    return Counter(map(tuple, df.collect()))


def test_parts_follow_the_rows_and_stop_at_a_hot_key(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert ordered.parts_by(df.limit(0), "k") == ordered.parts_by(df, "k") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ordered, "PART_ROWS", 9)
    assert ordered.parts_by(df, "k") == 12
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 10)
    monkeypatch.setattr(ordered, "SLOTS", 1)
    assert ordered.parts_by(df, "k") == 12  # the one slot has too many rows, no key has
    hot = df.unionByName(spark.createDataFrame([(None,)] * 11, "k long"))
    assert ordered.parts_by(hot, "k") is None


def test_parts_divide_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10")
        assert ordered.parts_by(spark.range(5), "id") == 5
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert ordered.parts_by(spark.range(5), "id") == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_left_join_in_parts_gives_the_same_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, x string")
    right = spark.createDataFrame([(1, 10), (1, 10), (3, 30), (None, 40)], "k long, y int")
    got = joins.left_join_many(left, right, "k", 3)
    assert got.columns == joins.left_join_many(left, right, "k").columns
    assert rows(got) == rows(joins.left_join_many(left, right, "k"))


def test_events_of_a_stay_move_once(spark, monkeypatch):
    stays, chart, meds = stay_tables(spark)
    cp, parts = sequences.charts_prescriptions_by_stay(stays, chart, meds, 2)
    assert parts
    monkeypatch.setattr(ordered, "SLOTS", 1)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 1)
    plain, none = sequences.charts_prescriptions_by_stay(stays, chart, meds, 2)
    assert none is None and rows(cp) == rows(plain) and sum(rows(cp).values()) == 10
    monkeypatch.undo()
    placed = sequences.sequence_positions(cp, "icustay_id", "hours_to_out", "valuecat", like=cp)
    assert not exchanges(placed)


@pytest.mark.parametrize("q", [1.0, 0.5])
def test_arrays_and_grid_of_placed_events_move_entities_only(spark, q):
    stays, chart, meds = stay_tables(spark)
    cp, parts = sequences.charts_prescriptions_by_stay(stays, chart, meds, 2)
    ids = stays.select("icustay_id")
    found = sequences.sequence_arrays(ids, cp, "icustay_id", "valuecat", "hours_to_out", q, "cp", parts=parts)
    want = sequences.sequence_arrays(ids, cp, "icustay_id", "valuecat", "hours_to_out", q, "cp")
    assert len(exchanges(found[0])) == 1 and "REPARTITION_BY_NUM" in exchanges(found[0])[0]
    assert "ENSURE_REQUIREMENTS" in exchanges(want[0])[0]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, want[0].collect()))
    assert sorted(found[1].collect()) == sorted(want[1].collect())
    enc, _ = sequences.encoded_sequence(cp, "icustay_id", "valuecat", "hours_to_out", q, "cp", parts=parts)
    grid = sequences.densify_grid(enc, ids, "icustay_id", "pos", {"idx": 0}, parts=parts)
    first, *others = exchanges(grid)  # the others are of null keys
    assert "REPARTITION_BY_NUM" in first and len(others) == 1
    plain = sequences.densify_grid(enc, ids, "icustay_id", "pos", {"idx": 0})
    assert rows(grid) == rows(plain)


def test_stays_move_once_by_subject_for_count_and_label(spark, monkeypatch):
    stay = [(s, 10 * s + i, ts(f"2020-0{i}-01 00:00"), ts(f"2020-0{i}-03 00:00")) for s in (1, 2, 3) for i in range(1, 6)]
    stays = spark.createDataFrame([*stay, (None, 99, ts("2020-01-01 00:00"), ts("2020-01-03 00:00"))],
                                  "subject_id long, icustay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    pats = spark.createDataFrame([(s, ts("1950-01-01 00:00"), None) for s in (1, 2, 2, 3)],
                                 "subject_id long, dob timestamp_ntz, dod timestamp_ntz")
    base = cohort.link_stays_patients(stays, pats, dob_cutoff_year=1900)
    assert not exchanges(base)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 2)
    monkeypatch.setattr(ordered, "SLOTS", 1)
    assert rows(cohort.link_stays_patients(stays, pats, dob_cutoff_year=1900)) == rows(base) and base.count() == 20


def test_admissions_and_services_share_the_move_of_stays(spark):
    stays = spark.createDataFrame([(1, 10, 100, ts("2020-01-02 00:00")), (1, 11, 101, ts("2020-02-02 00:00")), (2, 12, 102, ts("2020-03-02 00:00"))],
                                  "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz")
    adm = spark.createDataFrame(
        [(1, 10, "A", "I", "SINGLE", "WHITE", ts("2020-01-01 00:00"), "ELECTIVE", None), (1, 10, "B", "I", None, "ASIAN", ts("2020-01-01 06:00"), "URGENT", None),
         (2, 12, "A", "I", "SINGLE", "WHITE", ts("2020-03-01 00:00"), "ELECTIVE", None)],
        "subject_id long, hadm_id long, admission_location string, insurance string, marital_status string, ethnicity string,"
        " admittime timestamp_ntz, admission_type string, dischtime timestamp_ntz")
    serv = spark.createDataFrame([(1, 10, ts("2020-01-01 00:00"), "CSURG"), (2, 12, ts("2020-03-01 00:00"), "MED")],
                                 "subject_id long, hadm_id long, transfertime timestamp_ntz, curr_service string")
    before = cohort.link_services(cohort.link_admissions(stays, adm, 2), serv)
    after = cohort.finish_categories(cohort.link_services(cohort.with_admissions(stays, adm), serv), 2)
    assert rows(after.select(*before.columns)) == rows(before) and after.count() == 4
