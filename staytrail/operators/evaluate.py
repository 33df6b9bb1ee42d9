"""Scoring: class weight, loss, confusion counts and exact ranking metrics.

Average precision and ROC AUC need cumulative counts over scores in
descending order.  They are computed without a one-task global window: rows
are first pre-aggregated per distinct score (hash aggregate, so a hot score
is combined map-side), the distinct scores are dealt by ranges that are written
once, per-range totals are prefix-summed, and running sums inside each range
add their range offset (``ordered.cumulative``).  One such table serves both
metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathfns import bce_with_logits, sigmoid
from ..session import materialize
from .ordered import cumulative


def pos_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """negatives / positives (one row)."""
    return df.agg(F.try_divide((F.count(F.lit(1)) - F.sum(F.col(y))).cast("double"),
                               F.sum(F.col(y)).cast("double")).alias("pos_weight"))


def weighted_bce(df: DataFrame, logit: str, y: str, weight: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and total per-row BCE-with-logits with a positive-class weight."""
    loss = bce_with_logits(logit, y, weight)
    return df.groupBy(*keys).agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("total_loss"))


def predicted(p: Column | str, threshold: float = 0.5) -> Column:
    """Class 1 only when strictly above the threshold."""
    p = F.col(p) if isinstance(p, str) else p
    return (p > F.lit(threshold)).cast("int")


def confusion(df: DataFrame, p: str, y: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    pr, yv = predicted(p, threshold), F.col(y)
    return df.groupBy(*keys).agg(
        F.sum(F.when((pr == 1) & (yv == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((pr == 1) & (yv == 0), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((pr == 0) & (yv == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((pr == 0) & (yv == 1), 1).otherwise(0)).cast("long").alias("fn"))


def accuracy_f1(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    denom = 2 * tp + fp + fn
    return conf.select(*keys, ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
                       F.when(denom == 0, F.lit(0.0)).otherwise(2 * tp / denom).alias("f1"))


def score_table(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: tp, n, and cumulative tp / n over all scores >= it."""
    g = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    return cumulative(g, [F.col(score).desc()], ["tp", "n"], keys)


def ranking_metrics(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """average_precision (sum over distinct scores, descending, of recall step x
    precision) and roc_auc (trapezoidal, one point per distinct score) per group,
    from one pass over one score table."""
    t = score_table(df, score, y, keys).withColumn("fp", F.col("n") - F.col("tp"))
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp").cast("double")).alias("average_precision"),
        F.try_divide(F.sum(F.col("fp") * (2 * F.col("cum_tp") - F.col("tp"))).cast("double"),
                     F.lit(2.0) * F.sum("tp") * F.sum("fp")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, y, keys).drop("roc_auc")


def roc_auc(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, y, keys).drop("average_precision")


def evaluate(df: DataFrame, logit: str = "logit", y: str = "y", weight: float | DataFrame | None = None,
             mode: str = "score", threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics per group of a scored part (one row per group).  ``weight`` is
    the positive-class weight: a number, a one-row DataFrame with ``pos_weight``,
    or None to use this part's own negatives/positives.  ``mode='thresholded'``
    ranks the 0/1 predictions instead of the scores (the original behaviour)."""
    keys = list(keys)
    d = df.withColumn("_p", sigmoid(logit)).withColumn("_pred", predicted("_p", threshold).cast("double"))
    rank_col = "_p" if mode == "score" else "_pred"
    if weight is None:
        w = pos_weight(d, y)
    elif isinstance(weight, DataFrame):
        w = weight.select("pos_weight")
    else:
        w = d.sparkSession.range(1).select(F.lit(float(weight)).alias("pos_weight"))
    pr, yv = F.col("_pred"), F.col(y)
    d = materialize(d.crossJoin(F.broadcast(w)), "scored")  # one row; the table serves both aggregates below
    cells = {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}
    flat = d.groupBy(*keys).agg(
        *[F.sum(F.when((pr == p) & (yv == c), 1).otherwise(0)).cast("long").alias(name) for name, (p, c) in cells.items()],
        F.sum(bce_with_logits(logit, y, F.col("pos_weight"))).alias("loss"))
    acc = accuracy_f1(flat, [*keys, "loss"])
    ranks = ranking_metrics(d, rank_col, y, keys)
    order = [*keys, "accuracy", "f1", "average_precision", "roc_auc", "loss"]
    if not keys:
        return acc.crossJoin(F.broadcast(ranks)).select(*order)  # one row each
    return acc.join(ranks, keys).select(*order)


# -- result tables ------------------------------------------------------------

METRIC_COLUMNS = ["training_losses", "validation_losses", "accuracy_scores", "precision_scores", "roc_auc_scores",
                  "f1_scores"]


def mean_metrics(df: DataFrame, model: str = "model") -> DataFrame:
    """Mean of every metric column per model."""
    cols = [c for c in df.columns if c != model and c != "epoch"]
    return df.groupBy(model).agg(*[F.avg(c).alias(c) for c in cols])


def union_results(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def model_phase_table(df: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "roc_auc", "f1", "loss")) -> DataFrame:
    """Mean per (model, phase) in a fixed column order, model asc / phase desc."""
    return (df.groupBy("model", "phase").agg(*[F.avg(m).alias(m) for m in metrics])
              .orderBy(F.col("model").asc(), F.col("phase").desc()))
