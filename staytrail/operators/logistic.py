"""Weighted logistic regression by Newton steps.

Rows hold their non-zero features only (an array of (position, value)).  A step is one distributed sum: every row gives
its part of the gradient and of the upper triangle of X'WX, which are added up by position (combined before the
exchange), and the driver solves the ridge-regularised system of as many unknowns as there are features.  The number of
steps is fixed, so that the result is a function of the rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .evaluate import pos_weight

#: fixed number of Newton steps, penalty on every coefficient but the intercept
STEPS, RIDGE = 8, 1.0
#: most features: the driver holds a matrix of so many rows and columns
MAX_FEATURES = 2000


def sparse_row(cols: Sequence[str]) -> Column:
    """The intercept (position 0) and the non-zero ones of ``cols`` (positions 1, 2 ...) as an array of (i, v)."""
    pairs = [F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("v"))]
    pairs += [F.struct(F.lit(k).alias("i"), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("v"))
              for k, c in enumerate(cols, 1)]
    return F.filter(F.array(*pairs), lambda e: e["v"] != 0.0)


def linear(x: Column | str, beta: Sequence[float]) -> Column:
    """Sum of coefficient times value over a sparse row."""
    b = F.array(*map(F.lit, map(float, beta)))
    return F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(b, e["i"]))


def newton_step(rows: DataFrame, beta: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The coefficients after one step over ``rows`` (x, y, weight)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear("x", beta)))
    d = rows.withColumn("_p", p).select("x", (F.col("weight") * F.col("_p") * (1 - F.col("_p"))).alias("w"),
                                        (F.col("weight") * (F.col("y") - F.col("_p"))).alias("r"))
    products = F.flatten(F.transform("x", lambda a: F.transform(
        F.filter("x", lambda b: b["i"] >= a["i"]),
        lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (F.col("w") * a["v"] * b["v"]).alias("s")))))
    gradient = F.transform("x", lambda a: F.struct(a["i"].alias("i"), F.lit(-1).alias("j"), (F.col("r") * a["v"]).alias("s")))
    sums = (d.select(F.explode(F.concat(products, gradient)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.s").alias("s")))
    n = len(beta)
    penalty = np.full(n, float(ridge))
    penalty[0] = 0.0
    h, g = np.diag(penalty), -penalty * beta
    for i, j, s in sums.collect():  # at most one row a pair of features
        if j < 0:
            g[i] += s
        else:
            h[i, j] += s
            if i != j:
                h[j, i] += s
    return beta + np.linalg.solve(h, g)


def fit(features: DataFrame, cols: Sequence[str], label: str = "label", steps: int = STEPS, ridge: float = RIDGE) -> list[float]:
    """Intercept and one coefficient for each of ``cols``; positives weigh negatives / positives.

    A null feature is 0 and rows without a label are left out.  Without a positive or a negative row all coefficients
    are 0.  A feature that no row has keeps 0.
    """
    if len(cols) > MAX_FEATURES:
        raise ValueError(f"{len(cols)} features: the system of equations is solved by the driver, up to {MAX_FEATURES}")
    known = features.filter(F.col(label).isNotNull())
    w = pos_weight(known, label).first()["pos_weight"]
    beta = np.zeros(len(cols) + 1)
    if not w:
        return beta.tolist()
    y = F.col(label).cast("double")
    rows = materialize(known.select(sparse_row(cols).alias("x"), y.alias("y"),
                                    F.when(y == 1, F.lit(float(w))).otherwise(F.lit(1.0)).alias("weight")), "newton")
    for _ in range(steps):
        beta = newton_step(rows, beta, ridge)
    return beta.tolist()


def score(df: DataFrame, cols: Sequence[str], beta: Sequence[float], out: str = "logit") -> DataFrame:
    """``df`` with its linear score."""
    return df.withColumn(out, linear(sparse_row(cols), beta))
