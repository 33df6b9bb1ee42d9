"""String functions (Column -> Column), all built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_EDGES = r"^\s+|\s+$"


def normalise_code(c: Column | str, prefix: str) -> Column:
    """``prefix`` + lower-cased code stripped of surrounding whitespace."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(c), _WS_EDGES, ""))


def normalise_drug(c: Column | str, prefix: str) -> Column:
    """``prefix`` + lower-cased name with every whitespace run removed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(c), r"\s+", ""))


def apply_rules(value: str, rules: Sequence[tuple[str, str]]) -> str:
    """Sequential substring rules on one Python string (each rule sees the
    output of the previous ones)."""
    for needle, result in rules:
        if needle in value:
            value = result
    return value


def canonical_category(c: Column | str, rules: Sequence[tuple[str, str]], null_as: str | None = None) -> Column:
    """Apply ordered substring rules ``(needle, result)`` sequentially.

    Every rule rewrites the *current* value, so a later rule sees the output of
    the earlier ones.  Because a rule's output is a constant, what the later
    rules make of it is known when the plan is built: the sequential chain is
    one flat CASE (first matching rule -> its precomputed final value), linear
    in the number of rules.  ``null_as`` replaces a null before the rules run.
    """
    c = F.col(c) if isinstance(c, str) else c
    cur = F.coalesce(c, F.lit(null_as)) if null_as is not None else c
    expr = None
    for i, (needle, result) in enumerate(rules):
        final = apply_rules(result, rules[i + 1:])
        cond = cur.contains(needle)
        expr = F.when(cond, F.lit(final)) if expr is None else expr.when(cond, F.lit(final))
    return cur if expr is None else expr.otherwise(cur)


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter after any non-letter, lower-case the rest.

    ``initcap`` only splits on spaces; splitting after every non-letter and
    capitalising each piece gives the per-word behaviour of Python's
    ``str.title`` for ASCII text.
    """
    c = F.col(c) if isinstance(c, str) else c
    pieces = F.split(c, r"(?<=[^A-Za-z])")
    return F.array_join(
        F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))),
        "")


def contains_any(c: Column | str, parts: Sequence[str]) -> Column:
    """True when any of ``parts`` occurs in ``c`` (null stays null)."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for p in parts:
        e = c.contains(p)
        out = e if out is None else (out | e)
    return out


def lower(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c)
