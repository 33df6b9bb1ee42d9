"""Numeric and flag functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column | str) -> Column:
    """Logistic function of a logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softplus_neg(x: Column | str) -> Column:
    """log(1 + exp(-x)) in its overflow-safe form."""
    x = _c(x)
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(logit: Column | str, y: Column | str, pos_weight: Column | float = 1.0) -> Column:
    """Per-row binary cross entropy on a logit with a positive-class weight."""
    x, y = _c(logit), _c(y).cast("double")
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    sp = softplus_neg(x)
    return w * y * sp + (F.lit(1.0) - y) * (x + sp)


def round_times(c: Column | str, decimals: int = 3) -> Column:
    """Round half to even, as tensor rounding does."""
    return F.bround(_c(c), decimals)


def flag_to_int(c: Column | str) -> Column:
    """Boolean flag -> 0/1 with null -> 0."""
    return F.coalesce(_c(c), F.lit(False)).cast("int")


def fill_null(c: Column | str, value) -> Column:
    return F.coalesce(_c(c), F.lit(value))

