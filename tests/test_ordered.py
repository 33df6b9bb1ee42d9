"""Two-level ordered helpers equal the single-window versions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from staytrail.operators import ordered
from staytrail.operators.ordered import Key, neighbour, position


@pytest.fixture(autouse=True, params=[ordered.BUCKET_ROWS, 40])
def bucket_rows(request, monkeypatch):
    """Every test runs uncut and with buckets cut from 41 rows on."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", request.param)
    return request.param


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        k = 0 if i < 300 else rnd.randint(1, 6)          # key 0 is hot (half the rows)
        t = None if rnd.random() < 0.05 else float(rnd.randint(0, 400)) / 4
        rows.append((k, i, t, rnd.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "k long, id long, t double, c string")


@pytest.mark.parametrize("width", [0.5, 7.0, 1e9])
def test_position_matches_window(spark, data, width):
    keys = [Key("t"), Key("id")]
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "id")
    want = {r.id: r.p for r in data.select("id", (F.row_number().over(w) - 1).alias("p")).collect()}
    got = {r.id: r.pos for r in position(data, "k", keys, width).collect()}
    assert got == want


@pytest.mark.parametrize("width,following", [(0.5, True), (7.0, False), (1e9, True), (3.0, False)])
def test_neighbour_matches_lead_lag(spark, data, width, following):
    keys = [Key("t", asc=False), Key("c", nulls_first=True), Key("id")]
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_last(), F.col("c").asc_nulls_first(), "id")
    fn = F.lead if following else F.lag
    want = {r.id: r.v for r in data.select("id", fn("c").over(w).alias("v")).collect()}
    got = {r.id: r.v for r in neighbour(data, "k", keys, "c", width, "v", following).collect()}
    assert got == want


@pytest.mark.parametrize("width,suffix", [(0.5, False), (7.0, True), (1e9, True)])
def test_running_sum(spark, data, width, suffix):
    from staytrail.operators.ordered import running_sum
    d = data.withColumn("x", F.col("id") % 7)
    keys = [Key("t"), Key("id")]
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "id")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if suffix else w.rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in d.select("id", F.sum("x").over(frame).alias("s")).collect()}
    got = {r.id: r.s for r in running_sum(d, "k", keys, "x", width, "s", suffix).collect()}
    assert got == want


@pytest.mark.parametrize("width,backward", [(0.5, False), (7.0, True), (3.0, False), (1e9, True)])
def test_fill_nulls(spark, data, width, backward):
    from staytrail.operators.ordered import fill_nulls
    keys = [Key("t"), Key("id")]
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "id")
    if backward:
        e = F.first("c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        e = F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    want = {r.id: r.f for r in data.select("id", e.alias("f")).collect()}
    got = {r.id: r.f for r in fill_nulls(data, "k", keys, "c", width, "f", backward).collect()}
    assert got == want


def test_ranked_strings(spark):
    from staytrail.operators.ordered import ranked
    vals = spark.createDataFrame([(f"code{i:05d}",) for i in range(0, 3000, 3)], "c string")
    got = sorted((r.r, r.c) for r in ranked(vals, "c", "r", 7).collect())
    assert [c for _, c in got] == sorted(f"code{i:05d}" for i in range(0, 3000, 3))
    assert [r for r, _ in got] == list(range(1000))


def test_one_time_for_all_rows_is_cut(spark, bucket_rows):
    """A key whose rows all share one time: ranges follow the tie column, and all helpers stay exact."""
    from staytrail.operators.ordered import fill_nulls, running_sum
    n = 2000
    same = spark.range(n).select(F.lit(7).cast("long").alias("k"), F.lit(1.5).alias("t"), F.format_string("r%05d", "id").alias("id"),
                                 F.when(F.col("id") % 9 == 0, F.col("id")).alias("v"), (F.col("id") % 5).alias("x"))
    keys = [Key("t"), Key("id")]
    dealt = ordered._dealt(same, ["k"], keys, 1.0).groupBy("k", *ordered.RANGE).count().collect()
    if bucket_rows < n:
        assert len(dealt) > 20 and max(r["count"] for r in dealt) < n / 10 and sum(r["count"] for r in dealt) == n
    else:
        assert len(dealt) == 1
    d = position(same, "k", keys, 1.0, "p")
    d = running_sum(d, "k", keys, "x", 1.0, "s")
    d = neighbour(d, "k", keys, "p", 1.0, "nxt")
    d = fill_nulls(d, "k", keys, "v", 1.0, "f")
    rows = sorted(d.collect(), key=lambda r: r.id)
    assert [r.p for r in rows] == list(range(n))
    assert [r.nxt for r in rows] == [*range(1, n), None]
    assert [r.f for r in rows] == [i - i % 9 for i in range(n)]
    total = 0
    for r in rows:
        total += r.x
        assert r.s == total


def test_cut_with_null_key_null_time_and_extra_columns(spark):
    rows = [(None if i % 2 else 1, None if i % 3 else 0.0, i, f"e{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t double, id long, extra string")
    keys = [Key("t", asc=False, nulls_first=True), Key("id", asc=False)]
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_first(), F.col("id").desc())
    want = {r.id: (r.p, r.extra) for r in df.select("id", "extra", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert {r.id: (r.pos, r.extra) for r in position(df, "k", keys, 1.0).collect()} == want
    empty = position(df.filter("id < 0"), "k", keys, 1.0)
    assert empty.columns == [*df.columns, "pos"] and empty.count() == 0


def test_rows_of_ordinary_keys_move_once(spark, data, bucket_rows):
    """Positions, deltas and recency of one key: one exchange of the rows, and the same results with hot keys."""
    from staytrail.operators import windows
    d = windows.sequence_position(data.withColumn("t", F.coalesce("t", F.lit(0.0))), "k", "t", "id")
    d = windows.time_delta(d, "k", "pos", "t", "delta", like=data)
    r = windows.exp_decay_recency(d, "k", "pos", "delta", "c", None, 0.01, like=data)
    if bucket_rows > 600:
        assert r._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    w = Window.partitionBy("k").orderBy("pos")
    plain = d.select("k", "pos", "c", "t").withColumn("x", F.greatest(F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0)), F.lit(0.0)))
    plain = plain.withColumn("s", F.sum("x").over(w.rowsBetween(0, Window.unboundedFollowing)))
    want = {(x.k, x.c): x.w for x in plain.groupBy("k", "c").agg(F.sum(F.exp(-0.01 * F.col("s"))).alias("w")).collect()}
    got = {(x.k, x.c): x.recency for x in r.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_placed_rows_are_counted_once_and_sorted_twice_for_recency(spark, data, bucket_rows, monkeypatch):
    """Positions, deltas and recency of rows that lie by the first of two keys: no exchange, one count of the keys and two sorts,
    one in each direction; results of plain windows, also with hot keys."""
    from staytrail.operators import ordered, windows
    made = []
    monkeypatch.setattr(ordered, "_full_keys", lambda *a, f=ordered._full_keys: made.append(a) or f(*a))
    df = data.withColumn("t", F.coalesce("t", F.lit(0.0))).withColumn("s", F.col("id") % 4).repartition(4, "k")
    placed = ordered.Placed(df, ["k", "s"])
    d = windows.sequence_position(placed.df, ["k", "s"], "t", "id", like=placed)
    d = windows.time_delta(d, ["k", "s"], "pos", "t", "delta", like=placed)
    r = windows.exp_decay_recency(d, ["k", "s"], "pos", "delta", "c", None, 0.01, like=placed)
    assert len(made) == 1
    if bucket_rows > 600:
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    w = Window.partitionBy("k", "s")
    plain = df.withColumn("pos", F.row_number().over(w.orderBy("t", "id")))
    plain = plain.withColumn("x", F.greatest(F.col("t") - F.coalesce(F.lag("t").over(w.orderBy("pos")), F.lit(0.0)), F.lit(0.0)))
    plain = plain.withColumn("y", F.sum("x").over(w.orderBy("pos").rowsBetween(0, Window.unboundedFollowing)))
    want = {(x.k, x.s, x.c): x.w for x in plain.groupBy("k", "s", "c").agg(F.sum(F.exp(-0.01 * F.col("y"))).alias("w")).collect()}
    got = {(x.k, x.s, x.c): x.recency for x in r.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError, match="placed by"):
        windows.time_delta(d, "k", "pos", "t", "delta", like=placed)
