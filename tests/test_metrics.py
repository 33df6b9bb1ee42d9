"""Exact metrics with ties, both ranking modes."""

import pytest
from pyspark.sql import functions as F

from staytrail.operators import evaluate


def scored(spark):
    import math
    ps = [0.9, 0.6, 0.4, 0.1]
    return spark.createDataFrame([(y, math.log(p / (1 - p))) for y, p in zip([1, 0, 1, 0], ps)], "y int, logit double")


def test_fixture_metrics(spark):
    m = evaluate.evaluate(scored(spark), "logit", "y", weight=1.0).first()
    assert m.accuracy == pytest.approx(0.5) and m.f1 == pytest.approx(0.5)
    assert m.roc_auc == pytest.approx(0.75) and m.average_precision == pytest.approx(0.833333, abs=1e-6)
    t = evaluate.evaluate(scored(spark), "logit", "y", weight=1.0, mode="thresholded").first()
    assert t.roc_auc == pytest.approx(0.5) and t.average_precision == pytest.approx(0.5)


def test_half_is_negative(spark):
    df = spark.createDataFrame([(1, 0.5)], "y int, p double")
    c = evaluate.confusion(df, "p", "y").first()
    assert (c.tp, c.fn) == (0, 1)


def test_auc_matches_pair_count(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = evaluate.roc_auc(df, "s", "y").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_grouped_metrics_equal_per_group(spark):
    import random
    rnd = random.Random(3)
    rows = [(g, rnd.randint(0, 1), rnd.uniform(-2, 2)) for g in ("a", "b") for _ in range(100)]
    df = spark.createDataFrame(rows, "g string, y int, logit double")
    grouped = {r.g: r for r in evaluate.evaluate(df, "logit", "y", weight=2.0, keys=["g"]).collect()}
    for g in ("a", "b"):
        single = evaluate.evaluate(df.filter(F.col("g") == g), "logit", "y", weight=2.0).first()
        for k in ("accuracy", "f1", "average_precision", "roc_auc", "loss"):
            assert grouped[g][k] == pytest.approx(single[k])


def test_pos_weight_and_bce(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 2.0), (0, 0.0), (0, 1.0)], "y int, logit double")
    assert evaluate.pos_weight(df, "y").first()[0] == pytest.approx(3.0)
    out = evaluate.weighted_bce(df, "logit", "y", 3.0).first()
    assert out.total_loss == pytest.approx(2.079442 + 2.126928 + 0.693147 + 1.313262, abs=1e-5)
