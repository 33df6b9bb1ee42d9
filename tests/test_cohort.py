"""Cohort fixture: null-safe death filter, floored days, step order, negative gaps."""

from conftest import ts
from pyspark.sql import functions as F

from staytrail.operators import cohort, windows

STAYS = [
    (1, "a", "2100-01-01 00:00", "2100-01-05 12:00"),
    (1, "b", "2100-02-04 11:00", "2100-02-06 00:00"),
    (1, "c", "2101-02-06 00:00", "2101-02-06 23:59"),
    (2, "d", "2100-01-01 00:00", "2100-01-03 00:00"),
    (3, "e", "2100-01-01 00:00", "2100-01-03 00:00"),
    (4, "f", "2100-01-01 00:00", "2100-01-03 00:00"),
    (5, "g", "2100-01-01 00:00", "2100-01-03 00:00"),
    (6, "h", "2100-01-01 00:00", "2100-01-03 00:00"),
    (7, "i", "2100-01-01 00:00", "2100-01-03 00:00"),
    (7, "j", "2100-01-02 23:00", "2100-01-04 00:00"),
]
DOD = {2: "2100-01-03 00:00", 4: "2100-02-02 23:00", 5: "2100-02-03 00:00"}


def frames(spark):
    stays = spark.createDataFrame(
        [(s, ord(k), ts(i), ts(o), 1.0) for s, k, i, o in STAYS],
        "subject_id long, icustay_id long, intime timestamp_ntz, outtime timestamp_ntz, los double")
    stays = stays.withColumn("hadm_id", F.col("icustay_id"))
    pats = spark.createDataFrame(
        [(s, "M", ts("2082-01-08 00:00") if s == 6 else ts("2050-01-01 00:00"), ts(DOD.get(s))) for s in range(1, 8)],
        "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz")
    return stays, pats


def test_cohort_fixture(spark):
    stays, pats = frames(spark)
    out = cohort.link_stays_patients(stays, pats, keep_dod=True)
    got = {chr(r["icustay_id"]): r for r in out.collect()}
    assert sorted(got) == ["a", "b", "c", "e", "g", "i", "j"]
    assert got["a"]["num_recent_admissions"] == 0 and got["a"]["positive"] is True
    assert got["b"]["num_recent_admissions"] == 1 and got["b"]["positive"] is False
    assert got["c"]["num_recent_admissions"] == 1 and got["c"]["positive"] is False
    assert got["i"]["positive"] is True
    assert got["j"]["num_recent_admissions"] == 1


def test_gaps_are_floored(spark):
    stays, pats = frames(spark)
    df = cohort.join_stays_patients(stays, pats)
    df = cohort.next_gap_label(cohort.exclude_died_in_stay(df))
    gaps = {chr(r["icustay_id"]): r["days_to_next"] for r in df.collect()}
    assert gaps["a"] == 29 and gaps["b"] == 365 and gaps["c"] is None and gaps["i"] == -1


def test_plain_not_would_drop_survivors(spark):
    stays, pats = frames(spark)
    df = cohort.join_stays_patients(stays, pats)
    kept = {chr(r["icustay_id"]) for r in cohort.exclude_died_in_stay(df).collect()}
    plain = {chr(r["icustay_id"]) for r in df.filter(~(F.col("dod") <= F.col("outtime"))).collect()}
    assert "d" not in kept and "e" in kept and "e" not in plain


def test_attrition_monotone(spark):
    stays, pats = frames(spark)
    f = {r["stage"]: r for r in cohort.attrition(stays, pats).collect()}
    assert f["joined"]["stays"] == 10
    assert f["joined"]["stays"] >= f["survived_stay"]["stays"] >= f["adult"]["stays"] >= f["eligible"]["stays"]
    assert f["eligible"]["stays"] == 7 and f["early_death"]["stays"] == 1


def test_attrition_counts_a_repeated_stay_and_subject_once(spark):
    stays, pats = frames(spark)
    once = {r["stage"]: (r["subjects"], r["stays"]) for r in cohort.attrition(stays, pats).collect()}
    rows = stays.crossJoin(spark.createDataFrame([(1,), (2,)], "copy int")).drop("copy")
    twice = {r["stage"]: (r["subjects"], r["stays"]) for r in cohort.attrition(rows, pats).collect()}
    assert all(once[k] == twice[k] for k in ("joined", "survived_stay"))


def test_trailing_count_matches_plain_window(spark):
    """Bucketed (hot-key-safe) count equals a plain range window, for several
    shuffle partition counts."""
    from pyspark.sql import Window
    rows = [(k % 3, i, ts("2100-01-01 00:00")) for i, k in enumerate(range(60))]
    df = spark.createDataFrame(rows, "subject_id long, icustay_id long, t timestamp_ntz")
    df = df.withColumn("outtime", F.timestamp_add("HOUR", (F.col("icustay_id") * 997 % 20000).cast("int"), "t"))
    us = F.unix_micros(F.col("outtime").cast("timestamp"))
    w = Window.partitionBy("subject_id").orderBy(us).rangeBetween(-(366 * 86400000000 - 1), -86400000000)
    want = {r["icustay_id"]: r["n"] for r in df.select("icustay_id", F.count("*").over(w).alias("n")).collect()}
    for parts, bucket_days in (("1", None), ("4", 30), ("37", 100), ("4", 366)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["icustay_id"]: r["n"] for r in
               windows.trailing_count(df, "subject_id", "outtime", 1, 365, "n", bucket_days).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trailing_count_equals_brute_force(spark):
    """Null keys are one key, null times count nothing, repeated rows count each, and frame ends are exact."""
    import random
    from datetime import timedelta
    rnd = random.Random(4)
    zero = ts("2100-01-01 00:00")
    when = lambda: zero + timedelta(days=rnd.randrange(12), seconds=rnd.choice([0, 0, 1, 43200]))
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, None if rnd.random() < 0.1 else when()) for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k long, id long, t timestamp_ntz")
    for lo, hi, bucket in ((1, 5, None), (0, 3, 1), (2, 2, 4), (1, 365, 30)):
        got = sorted(((r.k, r.id, r.t, r.n) for r in windows.trailing_count(df, "k", "t", lo, hi, "n", bucket).collect()), key=str)
        want = [(k, i, t, sum(kk == k and t is not None and tt is not None and lo <= (t - tt).total_seconds() // 86400 <= hi
                              for kk, _, tt in rows)) for k, i, t in rows]
        assert got == sorted(want, key=str)
    assert windows.trailing_count(df.filter("id < 0"), "k", "t").count() == 0


def test_trailing_count_of_a_hot_subject_is_dealt_by_day(spark):
    """200,000 stays of one subject in a year: no (subject, bucket) holds more than a few of them."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_add("SECOND", (F.col("id") * 157).cast("int"),
                                                                    F.lit("2100-01-01").cast("timestamp_ntz")).alias("t"))
    got = windows.trailing_count(df, "k", "t", 1, 30, "n").agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    day, frame = 86400 / 157, 31 * 86400 / 157
    assert abs(got.most - (frame - day)) <= 1
    lags = [j for j in range(1, n) if 1 <= j * 157 // 86400 <= 30]
    assert got["all"] == sum(n - j for j in lags)


def test_trailing_count_moves_rows_of_ordinary_keys_once(spark, monkeypatch):
    """Keys with few rows are one range window, without a prefix count joined back; larger ones beside them count the same."""
    df = (spark.range(400).select((F.col("id") % 7).alias("k"), "id", F.timestamp_add("HOUR", (F.col("id") * 37 % 2400).cast("int"),
                                                                                    F.lit("2100-01-01").cast("timestamp_ntz")).alias("t"))
          .withColumn("k", F.when(F.col("id") < 300, F.lit(0)).when(F.col("k") > 5, None).otherwise(F.col("k")))
          .withColumn("t", F.when(F.col("id") % 23 != 0, F.col("t"))))
    want = sorted(map(str, windows.trailing_count(df, "k", "t", 1, 30, "n", bucket_days=1).collect()))
    assert any("n=0" not in r for r in want)
    for most in (0, 50, 256, 1000):
        monkeypatch.setattr(windows, "WINDOW_ROWS", most)
        got = windows.trailing_count(df, "k", "t", 1, 30, "n")
        assert got.columns == ["k", "id", "t", "n"]
        assert sorted(map(str, got.collect())) == want
    plan = windows.trailing_count(df, "k", "t", 1, 30, "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
