"""Lumping, encoding, padding, quantiles, split and pooling fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from staytrail.operators import aggregates, pooling, sequences, split


def test_lump_encode_pad(spark):
    cohort = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    rows = [(1, "x", 0.5), (1, "x", 2.0), (1, "y", 3.0), (2, "x", 1.0), (4, None, None)]
    df = spark.createDataFrame(rows, "k long, code string, t double")
    df = aggregates.lump_rare(df, ["code"], 2, "other")
    d = sequences.sequence_positions(df, "k", "t", "code")
    enc, dictionary = sequences.dictionary_encode(d, "code")
    assert sorted((r.idx, r.code) for r in dictionary.collect()) == [(1, "other"), (2, "x")]
    arr = sequences.pad_sequences(cohort, enc, "k", "pos", "idx", "t", "codes", "times")
    got = {r.k: (r.codes, r.times) for r in arr.collect()}
    assert got[1] == ([2, 2, 1], [0.5, 2.0, 3.0])
    assert got[2] == ([2, 0, 0], [1.0, 0.0, 0.0])
    assert got[3] == ([0, 0, 0], [0.0, 0.0, 0.0])
    assert got[4] == ([0, 0, 0], [0.0, 0.0, 0.0])
    assert len({len(v[0]) for v in got.values()}) == 1
    q = aggregates.exact_quantile(aggregates.group_sizes(df, "k"), "n", 0.95).first()[0]
    assert q == pytest.approx(2.8)


def test_uncut_arrays_meet_once(spark):
    """Arrays of all events: positions by number equal those by code, and rows move by key once."""
    rows = [(1, "b", 2.0), (1, "a", 2.0), (1, None, 2.0), (1, "a", None), (2, "c", 0.5), (4, None, None), (9, "d", 4.0)]
    df = spark.createDataFrame(rows, "k long, code string, t double")
    ent = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    arr, dictionary = sequences.sequence_arrays(ent, df, "k", "code", "t", 1.0, "dp")
    assert arr._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # rows and entities, by key
    assert sorted((r.idx, r.code) for r in dictionary.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    got = {r.k: (r.dp, r.dp_times) for r in arr.collect()}
    assert got == {1: ([0, 1, 2, 1], [0.5, 0.5, 0.5, 0.0]), 2: ([3, 0, 0, 0], [0.125, 0.0, 0.0, 0.0]),
                   3: ([0] * 4, [0.0] * 4), 4: ([0] * 4, [0.0] * 4)}


def test_wide_rows_do_not_move(spark):
    """The split is looked up before the arrays come in: nothing is dealt by subject after that."""
    cohort = spark.createDataFrame([(1, 10, True, "x"), (1, 11, False, None), (2, 20, False, "y"), (None, 30, True, "x")],
                                   "subject_id long, icustay_id long, positive boolean, insurance string")
    for c in (*split.SPARSE_STATIC, "admission_location", "marital_status", "ethnicity"):
        cohort = cohort.withColumn(c, F.lit(1.0) if c in split.SPARSE_STATIC else F.lit("z"))
    dp = spark.createDataFrame([(10, [1, 2]), (20, [3, 0])], "icustay_id long, dp array<int>")
    cp = spark.createDataFrame([(11, [7]), (30, [8])], "icustay_id long, cp array<int>")
    feats, _ = split.sparse_features(cohort, dp, cp)
    assert feats.columns[:3] == ["subject_id", "icustay_id", "label"] and feats.columns[-3:] == ["dp", "cp", "split"]
    assert {r.icustay_id: (r.dp, r.cp) for r in feats.collect()} == {10: ([1, 2], None), 11: (None, [7]), 20: ([3, 0], None), 30: (None, [8])}
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    first_join = plan[plan.index("Join"):].split("\n")[0]
    assert "icustay_id" in first_join and "subject_id" not in first_join


def test_lump_keeps_nulls_and_hot_values(spark):
    rows = [("hot",)] * 50 + [("rare",)] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    got = sorted((r.c or "∅") for r in aggregates.lump_rare(df, ["c"], 2, "other").collect())
    assert got.count("hot") == 50 and got.count("other") == 1 and got.count("∅") == 1


def test_split_disjoint_and_sized(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(40)], "subject_id long, stay long")
    s = split.grouped_split(df, "subject_id", (0.7, 0.8), 123)
    parts = {r.subject_id: r.split for r in s.collect()}
    assert len(parts) == 10
    counts = {p: list(parts.values()).count(p) for p in ("train", "validate", "test")}
    assert counts == {"train": 7, "validate": 1, "test": 2}


def test_hashed_rank_equals_global_order(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "subject_id long")
    r = split.hashed_rank(df, "subject_id", 123, "r")
    want = df.select("subject_id", F.md5(F.concat(F.col("subject_id").cast("string"), F.lit(":123"))).alias("h"))
    order = [x.subject_id for x in want.orderBy("h", "subject_id").collect()]
    got = {x.subject_id: x.r for x in r.collect()}
    assert [got[s] for s in order] == list(range(500))


def test_unique_time_grid(spark):
    df = spark.createDataFrame([(float(i % 37) / 3,) for i in range(300)], "t double")
    got = sorted((r.t, r.t_idx) for r in sequences.unique_time_grid(df, "t", "t_idx", partitions=8).collect())
    assert [i for _, i in got] == list(range(37))


def test_softmax_pool(spark):
    df = spark.createDataFrame([(1, math.log(1.0), [1.0, 0.0], True), (1, math.log(3.0), [0.0, 1.0], True),
                                (1, 5.0, [9.0, 9.0], False)], "g int, s double, v array<double>, m boolean")
    pooled, weights = pooling.masked_softmax_pool(df, "g", "s", "v", "m")
    w = sorted(round(r.weight, 6) for r in weights.collect())
    assert w == [0.0, 0.25, 0.75]
    got = {r.dim: r.pooled for r in pooled.collect()}
    assert got[0] == pytest.approx(0.25) and got[1] == pytest.approx(0.75)


def test_densify(spark):
    ent = spark.createDataFrame([(1,), (2,)], "k long")
    df = spark.createDataFrame([(1, 0, 5), (1, 2, 6)], "k long, pos int, idx int")
    got = sorted((r.k, r.pos, r.idx) for r in sequences.densify_grid(df, ent, "k", "pos", {"idx": 0}).collect())
    assert got == [(1, 0, 5), (1, 1, 0), (1, 2, 6), (2, 0, 0), (2, 1, 0), (2, 2, 0)]


def test_densify_gaps_nulls_and_strangers(spark):
    ent = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k long")
    rows = [(1, 2, 7, None), (3, 0, None, 1.5), (3, 3, 4, 2.0), (9, 1, 8, 8.0)]
    df = spark.createDataFrame(rows, "k long, pos int, idx int, t double")
    grid = sequences.densify_grid(df, ent, "k", "pos", {"idx": 0, "t": -1.0})
    cells = {(r[0], r[1]): r[2:] for r in rows}
    want = sorted((k, p, *[d if v is None else v for v, d in zip(cells.get((k, p), (None, None)), (0, -1.0))])
                  for k in (1, 2, 3) for p in range(4))
    assert sorted(map(tuple, grid.collect())) == want
    assert sequences.densify_grid(df.limit(0), ent, "k", "pos", {"idx": 0, "t": -1.0}).collect() == []
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_lumping_looks_many_values_up_as_it_compares_few(spark):
    rows = [(i % 7, f"v{i % 5}" if i % 11 else None, "rare" if i == 3 else "often") for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    few = aggregates.lump_rare(df, ["b", "c"], 11, "other")
    many = aggregates.lump_rare(df, ["b", "c"], 11, "other", literal_values=0)
    assert few.columns == many.columns == df.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    assert {r.c for r in few.collect()} == {"often", "other"}


def test_gender_encoding_optional(spark):
    from pyspark.sql import functions as F
    cohort = spark.createDataFrame(
        [(1, 10, "M", True, 2.0, 0, 30.0, 0.1, 0, "Emergency Room Admit", "Medicare", "Single", "White"),
         (2, 20, "F", False, 1.0, 1, 40.0, 0.0, 1, "Clinic Referral/Premature", "Private", "Single", "Asian")],
        "subject_id long, icustay_id long, gender string, positive boolean, los double, num_recent_admissions long,"
        " age double, pre_icu_los double, elective_surgery int, admission_location string, insurance string,"
        " marital_status string, ethnicity string")
    arr = spark.createDataFrame([(10,), (20,)], "icustay_id long")
    cats = split.category_values(cohort, ["admission_location", "insurance", "marital_status", "ethnicity"])
    plain = split.build_features(cohort, arr, arr, cats)
    with_g = split.build_features(cohort, arr, arr, cats, encode_gender=True)
    assert "GENDER_M" not in plain.columns and "GENDER_M" in with_g.columns
    assert {r.icustay_id: r.GENDER_M for r in with_g.collect()} == {10: 1.0, 20: 0.0}
    assert "ADMISSION_LOCATION_Emergency_Room_Admit" not in plain.columns


def test_arrays_are_made_where_the_rows_lie_without_numbering_them(spark):
    """Ties, null times and codes, negative times; keys told apart by two columns, by the first of which the rows lie."""
    from staytrail.session import materialize_by
    rows = [(k % 3, k, c, t) for k in range(12) for i, (c, t) in enumerate(
        [("b", 2.0), ("a", 2.0), (None, 1.0), ("c", None), ("a", -1.0), ("b", 0.0), ("b", 2.0)]) if (k + i) % 4]
    events = spark.createDataFrame(rows, "s long, k long, code string, t double").repartition(4, "s")
    events = materialize_by(events, "arrays", "s", 4)
    ent = spark.createDataFrame([(k,) for k in range(14)], "k long")
    arr, dictionary = sequences.sequence_arrays(ent, events, "k", "code", "t", 1.0, "dp", lie=["s", "k"])
    plan = arr._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning(s" not in plan
    idx = {r.code: r.idx for r in dictionary.collect()}
    assert idx == {"a": 1, "b": 2, "c": 3}
    want = {}
    for k in range(14):
        seq = sorted(((t is None, t or 0.0, idx.get(c, 0)) for _, key, c, t in rows if key == k))
        want[k] = [x[2] for x in seq], [x[1] / 2.0 for x in seq]
    longest = max(len(a) for a, _ in want.values())
    want = {k: (a + [0] * (longest - len(a)), b + [0.0] * (longest - len(b))) for k, (a, b) in want.items()}
    assert {r.k: (r.dp, r.dp_times) for r in arr.collect()} == want


def test_doubles_as_text_are_those_of_single_formats(spark):
    from pyspark.sql import functions as F
    from staytrail.plans.catalog import fmt_doubles, fmt_ints
    nan, inf = float("nan"), float("inf")
    odd = [[0.0, -0.0, 1e-7, 5e-7, 1.5e-6, 2.5e-6, 0.1234565, 0.1234575, 1 / 3, 0.9999995], [1e8 + 0.1234565, 999999999.9999995, 0.0],
           [1e9, 0.5, 0.0], [1e300], [-1e-9, -1.5, 0.0, 0.0], [nan, 0.0], [inf, 0.0], [0.5, -inf], [], None, [0.0], [0.0, 0.0], [-0.0],
           [None, 0.0], [0.0, None], [None], [1.0, None, 0.0], [1.0, 0.0, 2.0, 0.0, -0.0]]
    df = spark.createDataFrame([(a, None if a is None else [None if x is None else int(i % 3) for i, x in enumerate(a)]) for a in odd],
                               "a array<double>, b array<int>")
    one = F.array_join(F.transform("a", lambda x: F.format_string("%.6f", F.bround(x, 6))), ",")
    ints = F.array_join(F.transform("b", lambda x: x.cast("string")), ",")
    for r in df.select(fmt_doubles("a").alias("got"), one.alias("want"), fmt_ints("b").alias("got_b"), ints.alias("want_b")).collect():
        assert r.got == r.want and r.got_b == r.want_b
