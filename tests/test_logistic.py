"""Newton steps against plain arithmetic."""

import math
import random

import numpy as np
import pytest

from staytrail.operators import logistic


def plain(x, y, steps=logistic.STEPS, ridge=logistic.RIDGE):
    x = np.column_stack([np.ones(len(x)), x])
    cw = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    pen = np.full(x.shape[1], ridge)
    pen[0] = 0
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (cw * p * (1 - p))[:, None]) + np.diag(pen), x.T @ (cw * (y - p)) - pen * b)
    return b


def rows(n=300, seed=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(rnd.random() < 0.3), rnd.gauss(0, 2), 0.0, float(rnd.randint(0, 3))]
        out.append((i, int(rnd.random() < 1 / (1 + math.exp(1.5 - x[0] - 0.7 * x[1]))), *x))
    return out


SCHEMA = "id int, label int, a double, `b c` double, never double, d double"
COLS = ["a", "b c", "never", "d"]


def test_equals_plain_arithmetic(spark):
    data = rows()
    got = logistic.fit(spark.createDataFrame(data, SCHEMA).repartition(7), COLS)
    want = plain(np.array([r[2:] for r in data]), np.array([r[1] for r in data]))
    assert got == pytest.approx(want.tolist(), abs=1e-9)
    assert got[3] == 0.0 and got[2] > 0.3
    scored = {r["id"]: r["logit"] for r in logistic.score(spark.createDataFrame(data, SCHEMA), COLS, got).collect()}
    assert scored[5] == pytest.approx(want[0] + float(np.dot(want[1:], data[5][2:])))


def test_nulls_and_one_class(spark):
    data = rows(80)
    odd = [(900, None, 1.0, 1.0, 0.0, 1.0), (901, 0, None, None, None, None)]
    got = logistic.fit(spark.createDataFrame(data + odd, SCHEMA), COLS)
    zero = [r if r[0] != 901 else (901, 0, 0.0, 0.0, 0.0, 0.0) for r in data + odd[1:]]
    assert got == pytest.approx(plain(np.array([r[2:] for r in zero]), np.array([r[1] for r in zero])).tolist(), abs=1e-9)
    assert logistic.fit(spark.createDataFrame([(*r[:1], 0, *r[2:]) for r in data], SCHEMA), COLS) == [0.0] * 5
    assert logistic.fit(spark.createDataFrame([], SCHEMA), COLS) == [0.0] * 5
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame([], SCHEMA), ["a"] * (logistic.MAX_FEATURES + 1))
