"""Array-column functions (Column -> Column) for padded sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_delta_array(times: Column | str) -> Column:
    """Difference to the previous element; the first keeps its own value; <0 -> 0."""
    t = _c(times)
    return F.transform(t, lambda x, i: F.greatest(
        x - F.when(i == 0, F.lit(0.0)).otherwise(F.element_at(t, i)), F.lit(0.0)))


def reverse_sequence(c: Column | str) -> Column:
    """Reversed array (deltas are flipped, not recomputed)."""
    return F.reverse(_c(c))


def pad_array(c: Column | str, length: Column | int, fill) -> Column:
    """Cut to ``length`` and right-pad with ``fill`` up to ``length``."""
    c = _c(c)
    n = length if isinstance(length, Column) else F.lit(length)
    cut = F.slice(c, 1, n)
    return F.concat(cut, F.array_repeat(F.lit(fill), (n - F.size(cut)).cast("int")))

