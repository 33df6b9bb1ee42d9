"""Point-in-time history join (D21) and stream = batch for the event cleaner."""

import os

from conftest import ts
from pyspark.sql import functions as F

from staytrail.operators import codes, events
from staytrail.session import scratch_path
from staytrail.sources import files
from staytrail.streaming import ingest


def test_history_join(spark):
    stays = spark.createDataFrame([(1, "S1", ts("2100-01-10 00:00")), (2, "S2", ts("2100-01-10 00:00")),
                                   (3, "S3", ts("2100-01-10 00:00"))],
                                  "subject_id long, icustay_id string, outtime timestamp_ntz")
    hist = spark.createDataFrame([(1, "future", ts("2100-02-01 00:00")), (3, "past", ts("2100-01-01 00:00")),
                                  (3, "future", ts("2100-03-01 00:00"))],
                                 "subject_id long, icd9_code string, admittime timestamp_ntz")
    got = sorted((r.icustay_id, r.icd9_code) for r in codes.point_in_time_history(stays, hist).collect())
    assert got == [("S2", None), ("S3", "past")]


def history_tables(spark, n=60):
    import random
    from datetime import datetime, timedelta
    rnd = random.Random(2)
    when = lambda: None if rnd.random() < 0.1 else datetime(2100, 1, 1) + timedelta(hours=rnd.randrange(24 * 200))
    key = lambda: rnd.choice([None, 1, 1, 1, 1, 2, 3, 4])
    stays = [(key(), f"S{i}", when()) for i in range(n)] + [(9, "alone", when())]
    hist = [(key(), f"c{rnd.randrange(30)}", when()) for _ in range(4 * n)] + [(5, "unasked", when())]
    return stays, hist + hist[:20]


def test_history_join_equals_brute_force(spark):
    stays, hist = history_tables(spark)
    want = set()
    for k, s, out in stays:
        mine = {h for h in hist if h[0] == k and k is not None}
        want |= {(k, s, out, c, at) for _, c, at in mine if at is None or out is None or at <= out} or ({(k, s, out, None, None)} if not mine else set())
    left = spark.createDataFrame(stays, "subject_id long, icustay_id string, outtime timestamp_ntz")
    right = spark.createDataFrame(hist, "subject_id long, icd9_code string, admittime timestamp_ntz")
    for days in (1, 30, 1000):
        got = codes.point_in_time_history(left, right, bucket_days=days)
        assert got.columns == ["subject_id", "icustay_id", "outtime", "icd9_code", "admittime"]
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_hot_keys_join_by_bucket_and_give_the_same_rows(spark):
    stays, hist = history_tables(spark)
    left = spark.createDataFrame(stays, "subject_id long, icustay_id string, outtime timestamp_ntz")
    right = spark.createDataFrame(hist, "subject_id long, icd9_code string, admittime timestamp_ntz")
    want = sorted(map(str, codes.point_in_time_history(left, right).collect()))
    for pairs in (0, 500):  # all keys with both, then key 1 alone
        assert sorted(map(str, codes.point_in_time_history(left, right, hot_pairs=pairs).collect())) == want


def test_known_rows_move_once_and_are_distinct_by_stay(spark):
    """Known rows are compared where they were joined: no row moves by stay and code; ids of two keys are compared all the same."""
    stays, hist = history_tables(spark)
    right = spark.createDataFrame(hist, "subject_id long, icd9_code string, admittime timestamp_ntz")
    for rows in (stays, stays + [(2, "S1", None), (None, "S2", None), (3, "S1", None)]):
        left = spark.createDataFrame(rows, "subject_id long, icustay_id string, outtime timestamp_ntz")
        known = codes.point_in_time_history(left, right)
        got = codes.distinct_known(known, left, ["icustay_id", "icd9_code"])
        assert got.columns == ["icustay_id", "icd9_code"]
        found = [tuple(r) for r in got.collect()]
        assert sorted(found, key=str) == sorted({(r.icustay_id, r.icd9_code) for r in known.collect()}, key=str)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(icustay_id" in plan) == (rows is not stays)


def test_no_pair_from_a_later_bucket_is_made(spark):
    asked = spark.createDataFrame([(1, [1, 2, 3], 2), (2, [5], 4), (3, [7, 8], None)], "k long, _list array<long>, _sb long")
    hist = spark.createDataFrame([(1, b, x) for b in (1, 2, 3) for x in "ab"] + [(2, 5, "a"), (3, 7, "a"), (3, 8, "b")],
                                 "k long, _hb long, c string")
    met = sorted((r.k, r._hb, r.c) for r in codes.bucket_pairs(asked, hist, "k").collect())
    assert met == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "b"), (3, 7, "a"), (3, 8, "b")]


def test_stream_equals_batch(spark):
    rows = [(1, 1, f"{s}.0" if s % 5 else None, item, ts(f"2100-01-0{1 + s % 8} 0{s % 9}:00"), float(v))
            for s, (item, v) in enumerate([(211, 80), (678, 98.6), (198, 2), (198, 12), (3581, 154), (189, 0.5),
                                           (211, 300), (226707, 70), (220045, 0), (723, 4)] * 3)]
    raw = spark.createDataFrame(rows, "subject_id long, hadm_id long, icustay_id string, itemid int, "
                                      "charttime timestamp_ntz, valuenum double")
    src, out, ck = (scratch_path(spark, n) for n in ("t_raw", "t_out", "t_ck"))
    files.write_csv(raw.repartition(3), src)
    schema = ("subject_id BIGINT, hadm_id BIGINT, icustay_id STRING, itemid INT, charttime TIMESTAMP_NTZ, "
              "valuenum DOUBLE")
    streamed = ingest.ingest_once(spark, src, out, ck, schema, events.clean_chart_events, max_files_per_trigger=1)
    batch = events.clean_chart_events(raw)
    key = lambda r: (r.icustay_id, r.charttime, r.ce_type, round(r.valuenum, 9))
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))
    assert len([f for f in os.listdir(out) if f.endswith(".parquet")]) >= 2  # several micro-batches


def test_left_join_many_equals_left_join(spark):
    from staytrail.operators.joins import left_join_many
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "k long, l string")
    right = spark.createDataFrame([(1, 10)] * 50 + [(3, 30), (4, 40), (None, 0)], "k long, r int")
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    got = left_join_many(left, right, "k")
    assert got.columns == left.join(right, "k", "left").columns
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_clinical_csv_sources_give_same_cohort(spark):
    """The source CSV layout (upper-case headers, text timestamps) read by the
    fixed-schema readers yields the same cohort and codes as the views."""
    from staytrail.plans.flow import Flow
    from staytrail.plans.views import TestViews
    from staytrail.sources.clinical import TABLES, clinical_sources
    sf = "/root/testdata/sf0.001"
    v = TestViews(spark, sf)
    root = scratch_path(spark, "clinical_csv")
    for role, (fname, cols) in TABLES.items():
        df = getattr(v, role)
        files.write_csv(df.select(*[F.col(c.lower()).alias(c) for c, _ in cols]), os.path.join(root, fname))
    src = clinical_sources(spark, root)
    a = Flow(spark, sources=src, dob_cutoff_year=1900)
    b = Flow(spark, sf)
    for stage in ("cohort", "codes"):
        x = sorted(map(tuple, getattr(a, stage).collect()), key=str)
        y = sorted(map(tuple, getattr(b, stage).collect()), key=str)
        assert x == y and len(x) > 0


def code_tables(spark, shared=False):
    """Stays of 7 subjects, their codes by admission, and the admissions; S00 belongs to two subjects if ``shared``."""
    from datetime import datetime, timedelta
    day = lambda d: datetime(2100, 1, 1) + timedelta(days=d)
    stays = [(s, f"S{s}{i}", day(20 * i + 5)) for s in range(7) for i in range(6)] + ([(2, "S00", day(30))] if shared else [])
    adms = [(100 * s + i, day(20 * i), day(20 * i + 4 + i % 3)) for s in range(7) for i in range(6)]
    rows = [(s, 100 * s + i, f" C{(3 * s + i * j) % 11} ") for s in range(6) for i in range(6) for j in range(5)]
    return (spark.createDataFrame(stays, "subject_id long, icustay_id string, outtime timestamp_ntz"),
            spark.createDataFrame(rows, "subject_id long, hadm_id long, icd9_code string"),
            spark.createDataFrame(adms, "hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz"))


def test_steps_by_stay_need_no_exchange_where_codes_lie_by_subject(spark, monkeypatch):
    """Known codes are dealt by counted pairs and written by subject; positions and the first rows of a stay are taken
    there, and give what plain windows over the stay give."""
    from collections import defaultdict

    from staytrail.operators import sequences, windows
    monkeypatch.setattr(codes, "PART_PAIRS", 50)
    for shared in (False, True):
        stays, rows, adms = code_tables(spark, shared)
        df, keys = codes.diag_proc_by_subject(stays, rows, rows, adms, min_count=20)
        assert keys == (["icustay_id"] if shared else ["subject_id", "icustay_id"])
        like = None if shared else df
        first = windows.first_n(df, keys, "days_to_out", "icd9_code", 3)
        pos = sequences.sequence_positions(df, keys, "days_to_out", "icd9_code", like=like)
        if not shared:
            for d in (first, pos):
                assert "Exchange hashpartitioning" not in d._jdf.queryExecution().toString()
            pairs = 6 * 6 * 6 * 5 * 2  # of the six subjects with codes
            assert first.rdd.getNumPartitions() == -(-pairs // 50)
        by_stay = defaultdict(list)
        for r in codes.diag_proc(stays, rows, rows, adms, min_count=20).collect():
            by_stay[r.icustay_id].append(((r.days_to_out is None, r.days_to_out or 0.0), r.icd9_code or "", tuple(r)))
        want = {s: [t for *_, t in sorted(v)] for s, v in by_stay.items()}
        assert len(want) == 42 and any(len(v) > 20 for v in want.values())
        got = defaultdict(list)
        for r in pos.select(*codes.KNOWN, "pos").orderBy("pos").collect():
            got[r.icustay_id].append(tuple(r)[:3])
        assert got == want
        assert sorted(map(str, map(tuple, first.select(*codes.KNOWN).collect()))) == sorted(str(t) for v in want.values() for t in v[:3])


def test_known_codes_are_distinct_before_the_rows_grow(spark, monkeypatch):
    """Overlapping admissions, several with one end, unknown starts and ends, and stays without an end: the rows are
    those that a comparison of all rows leaves, and the plan compares none of them."""
    import random
    from datetime import datetime, timedelta
    monkeypatch.setattr(codes, "PART_PAIRS", 100)
    rnd = random.Random(5)
    day = lambda n: datetime(2150, 1, 1) + timedelta(days=n)
    some = lambda n: None if rnd.random() < 0.15 else day(n)
    rows = [(rnd.randrange(5), f"c{rnd.randrange(3)}", some(s := rnd.randrange(30)), some(s + rnd.randrange(4, 12))) for _ in range(400)]
    rows += rows[:60]
    history = spark.createDataFrame(rows, "subject_id long, icd9_code string, admittime timestamp_ntz, dischtime timestamp_ntz")
    listed = [(k % 6, 100 + k, None if k % 9 == 0 else day(rnd.randrange(45))) for k in range(60)] + [(None, 99, day(3)), (7, None, day(3))]
    stays = spark.createDataFrame(listed, "subject_id long, icustay_id long, outtime timestamp_ntz")
    asked, hist = codes._in_micros(stays, history)
    hist, hot, parts = codes._counted(asked, hist, "subject_id", codes.HOT_PAIRS)
    once = codes._known_once(asked, hist, parts)
    every = codes.known_codes(stays, history)[0]
    cols = ["subject_id", *codes.KNOWN]
    got = sorted(map(str, once.select(*cols).collect()))
    assert got == sorted(map(str, every.select(*cols).distinct().collect())) and len(got) < every.count()
    assert hot is None and once.rdd.getNumPartitions() == parts > 8
    # a stay that is listed twice, or ends too far apart to be told apart as days
    assert codes._known_once(asked.unionByName(asked.limit(1)), hist, parts) is None
    monkeypatch.setattr(codes, "EXACT_MICROS", 1)
    assert codes._known_once(asked, hist, parts) is None
