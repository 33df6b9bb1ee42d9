"""Lookups and ranks: the same rows whichever way they run, and no hot value is gathered."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from staytrail.operators import aggregates, evaluate, sequences
from staytrail.operators.joins import lookup_join
from staytrail.operators.ordered import Key, cumulative, neighbour, ranked


@pytest.fixture()
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.execution.reuseSubquery", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")
    spark.conf.unset("spark.sql.execution.reuseSubquery")


def test_ranks_do_not_need_exchange_reuse(spark, no_reuse):
    n = 400_000
    vals = spark.range(0, n, 1, 8).select(F.md5(F.col("id").cast("string")).alias("c"))
    got = ranked(vals, "c", "r", 16)
    one = got.agg(F.countDistinct("r").alias("d"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    assert (one.d, one.lo, one.hi) == (n, 0, n - 1)
    some = got.filter(F.col("r") % 50_000 == 0).collect()
    want = sorted(r.c for r in vals.collect())
    assert len(some) == 8 and all(want[r.r] == r.c for r in some)


def test_score_metrics_do_not_need_exchange_reuse(spark, no_reuse):
    df = spark.range(0, 300_000, 1, 8).select((F.xxhash64("id") % 1_000_003 / 7.0).alias("p"), (F.xxhash64(F.col("id") + 1) % 3 == 0).cast("int").alias("y"))
    rows = df.toPandas()  # noqa: F841  (read by DuckDB)
    want = duckdb.sql("""
        WITH g AS (SELECT p, sum(y) AS tp, count(*) AS n FROM rows GROUP BY p),
             c AS (SELECT *, sum(tp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g)
        SELECT sum(tp * ctp / cn) / sum(tp)::DOUBLE, sum((n - tp) * (2 * ctp - tp)) / (2.0::DOUBLE * sum(tp) * sum(n - tp)) FROM c""").fetchall()[0]
    got = evaluate.ranking_metrics(df, "p", "y").first()
    assert got.average_precision == pytest.approx(want[0], abs=1e-9) and got.roc_auc == pytest.approx(want[1], abs=1e-12)


def test_cumulative_per_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "a", None]), i, rnd.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    got = {r.t: r.cum_x for r in cumulative(df, [F.col("t").desc()], ["x"], ["k"], 7).collect()}
    for k, t, _ in rows:
        assert got[t] == sum(x for kk, tt, x in rows if kk == k and tt >= t)


def test_tie_rank_of_large_ids(spark):
    """Ids above 2**53 keep their order under a descending tie."""
    big = 2 ** 53
    rows = [(1, 0.0, big + i, i) for i in range(4)] + [(1, 1.0, big, 9)]
    df = spark.createDataFrame(rows, "k long, t double, id long, v long")
    got = {(r.t, r.id): r.nxt for r in neighbour(df, "k", [Key("t"), Key("id", asc=False)], "v", 0.5, "nxt").collect()}
    assert [got[0.0, big + i] for i in (3, 2, 1, 0)] == [2, 1, 0, 9]


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_both_ways(spark, limit, how):
    rows = [(i % 7 if i % 2 else 0, i) for i in range(300)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k int, v int")
    table = spark.createDataFrame([(i, f"n{i}") for i in range(0, 6)], "k int, name string")
    want = sorted(map(str, df.join(table, "k", how).collect()))
    assert sorted(map(str, lookup_join(df, table, "k", how, limit, 4).collect())) == want


def test_hot_code_rows_are_not_shuffled_by_code(spark):
    rows = [(i, "hot" if i % 2 else f"c{i % 40}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "icustay_id long, code string, t double")
    lumped = aggregates.lump_rare(df, ["code"], 100, "other")
    enc, _ = sequences.dictionary_encode(lumped, "code")
    for out in (lumped, enc):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(code" not in plan and "BroadcastHashJoin" in plan
    kept = {r.code for r in lumped.select("code").distinct().collect()}
    assert kept == {"hot", "other"}


def test_exact_quantile(spark):
    rnd = random.Random(5)
    values = [rnd.randrange(50) for _ in range(333)] + [7] * 500
    for q in (0.0, 0.25, 0.95, 0.951, 1.0):
        (got,) = aggregates.exact_quantile(spark.createDataFrame([(v,) for v in values] + [(None,)], "v long"), "v", q).first()
        (want,) = duckdb.sql(f"SELECT quantile_cont(v, {q}) FROM (SELECT unnest({values}) AS v)").fetchall()[0]
        assert got == pytest.approx(want, abs=1e-12)
    assert aggregates.exact_quantile(spark.createDataFrame([], "v long"), "v", 0.5).first()[0] is None
