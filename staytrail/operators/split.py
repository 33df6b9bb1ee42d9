"""Grouped train/validate/test split, one-hot statics and the feature table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..session import materialize
from .joins import lookup_join
from .ordered import ranked


def hashed_rank(keys: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """0-based rank of distinct keys in md5(key:seed) order, computed in two levels:
    buckets by the leading bits of the hash (uniform by construction, 16 a shuffle
    partition, 2**20 at most), a prefix sum over the bucket counts, then a row
    number inside each bucket plus its offset.  Exact, and no single task sees
    all keys."""
    bits = min(20, max(8, (16 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    h = keys.select(key).distinct().withColumn(
        "_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    h = h.withColumn("_bk", F.shiftright(F.conv(F.substring("_h", 1, 5), 16, 10).cast("int"), 20 - bits))
    counts = h.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_bk", F.coalesce(F.sum("_n").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_bk").orderBy("_h", key)
    return (h.join(offs, "_bk")
             .withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
             .drop("_bk", "_off", "_h"))


def grouped_split(df: DataFrame, key: str = "subject_id", cuts: Sequence[float] = rules.SPLIT_CUTS,
                  seed: int = rules.SPLIT_SEED, out: str = "split") -> DataFrame:
    """(key, split): shuffled distinct keys cut at floor(c1*n) and floor(c2*n)."""
    order = hashed_rank(df, key, seed, "_r")
    n = order.agg(F.count(F.lit(1)).alias("_cnt"))
    c1, c2 = float(cuts[0]), float(cuts[1])
    part = (F.when(F.col("_r") < F.floor(F.lit(c1) * F.col("_cnt")), F.lit("train"))
            .when(F.col("_r") < F.floor(F.lit(c2) * F.col("_cnt")), F.lit("validate"))
            .otherwise(F.lit("test")))
    return order.crossJoin(F.broadcast(n)).select(key, part.alias(out))  # one row


def attach_split(df: DataFrame, split_table: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(split_table, key, "left")


def subset(df: DataFrame, part: str, col: str = "split") -> DataFrame:
    return df.filter(F.col(col) == F.lit(part))


def test_subjects(features: DataFrame, key: str = "icustay_id", subject: str = "subject_id") -> DataFrame:
    return subset(features, "test").select(key, subject)


def category_values(df: DataFrame, cols: Sequence[str], max_categories: int = 1000) -> dict[str, list[str]]:
    """Distinct values per categorical column, all columns in one job (a bounded
    driver read: the column names of a one-hot encoding must be known when the
    plan is built; more than ``max_categories`` values per column is an error)."""
    cols = list(cols)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                          for c in cols])).alias("p")).select("p.c", "p.v")
    distinct = pairs.filter(F.col("v").isNotNull()).distinct()
    rows = distinct.limit(max_categories * len(cols) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, vals in out.items():
        if len(vals) > max_categories:
            raise ValueError(f"{c}: more than {max_categories} categories for one column each; use index arrays (sparse_features)")
        vals.sort()
    return out


def dummy_name(col: str, value: str) -> str:
    """``<COL>_<value>``, the value as it is."""
    return f"{col.upper()}_{value}"


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]], baselines: Mapping[str, str] | None = None,
            drop_source: bool = True) -> DataFrame:
    """One 0/1 column ``<COL>_<value>`` per category (null -> all 0), baseline
    categories dropped.  Column names that differ in case only are an error."""
    baselines = baselines or {}
    names = {c.lower() for c in df.columns}
    for name in [dummy_name(c, v) for c, vals in categories.items() for v in vals if baselines.get(c) != v]:
        if name.lower() in names:
            raise ValueError(f"column {name} would exist twice")
        names.add(name.lower())
    cols = []
    for c, vals in categories.items():
        for v in vals:
            if baselines.get(c) == v:
                continue
            cols.append(F.when(F.col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(dummy_name(c, v)))
    out = df.select("*", *cols)
    return out.drop(*categories.keys()) if drop_source else out


def one_hot_indices(df: DataFrame, cols: Sequence[str], baselines: Mapping[str, str] | None = None,
                    out: str = "hot") -> tuple[DataFrame, DataFrame]:
    """The same encoding for any number of categories: ``out`` is the sorted array of
    the positions that are 1, and the second table names the positions
    (``idx``, ``feature``).  Nothing is read by the driver."""
    baselines = dict(baselines or {})
    pairs = lambda d: F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "one_hot")
    long = rows.select("_row", F.explode(pairs(rows)).alias("p")).select("_row", "p.c", "p.v").filter(F.col("v").isNotNull())
    for c, v in baselines.items():
        long = long.filter((F.col("c") != c) | (F.col("v") != v))
    long = long.select("_row", F.concat(F.upper("c"), F.lit("_"), F.col("v")).alias("feature"))
    names = ranked(long.select("feature").distinct(), "feature", "idx").select(F.col("idx").cast("int").alias("idx"), "feature")
    hot = lookup_join(long, names, "feature", "inner").groupBy("_row").agg(F.sort_array(F.collect_list("idx")).alias(out))
    encoded = rows.join(hot, "_row", "left").withColumn(out, F.coalesce(out, F.array().cast("array<int>")))
    return encoded.drop("_row"), names


def select_regex(df: DataFrame, pattern: str, ignore_case: bool = True) -> list[str]:
    """Column names matching ``pattern`` (metadata only, no job)."""
    rx = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    return [c for c in df.columns if rx.search(c)]


def build_features(cohort: DataFrame, dp_arrays: DataFrame, cp_arrays: DataFrame,
                   categories: Mapping[str, Sequence[str]], seed: int = rules.SPLIT_SEED,
                   encode_gender: bool = False) -> DataFrame:
    """One row per stay: key, subject, label, static features, both sequences, split.

    By default gender does not reach the static features (the static pattern
    asks for ``GENDER_M`` but gender is not one-hot encoded); ``encode_gender``
    adds the ``GENDER_M`` indicator."""
    cats = dict(categories)
    baselines = dict(rules.ONE_HOT_BASELINES)
    if encode_gender:
        cats["gender"] = ["F", "M"]
        baselines["gender"] = "F"
    oh = one_hot(cohort, cats, baselines)
    static = select_regex(oh.drop("subject_id", "hadm_id", "icustay_id", "intime", "outtime", "gender", "positive"),
                          rules.STATIC_PATTERN)
    split = grouped_split(cohort, "subject_id", rules.SPLIT_CUTS, seed)
    rows = oh.select("icustay_id", "subject_id", F.col("positive").cast("double").alias("label"),
                     *[F.col(_quoted(c)).cast("double").alias(c) for c in static])
    return _with_arrays(rows, dp_arrays, cp_arrays, split)


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _with_arrays(rows: DataFrame, dp_arrays: DataFrame, cp_arrays: DataFrame, split: DataFrame) -> DataFrame:
    """``rows`` with both sequences and the split.  The split is looked up before the
    arrays come in, whose joins are all by the stay: the wide rows never move."""
    names = ["subject_id", *[c for c in rows.columns if c != "subject_id"],
             *[c for c in [*dp_arrays.columns, *cp_arrays.columns] if c != "icustay_id"], "split"]
    wide = attach_split(rows, split).join(dp_arrays, "icustay_id", "left").join(cp_arrays, "icustay_id", "left")
    return wide.select(*map(_quoted, names))


SPARSE_STATIC = ["los", "num_recent_admissions", "age", "pre_icu_los", "elective_surgery"]


def sparse_features(cohort: DataFrame, dp_arrays: DataFrame, cp_arrays: DataFrame, seed: int = rules.SPLIT_SEED,
                    encode_gender: bool = False, cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The feature table for any number of categories, and the names of the encoded positions (``idx``, ``feature``).

    As ``build_features``, but the one-hot part is one column ``hot`` with the sorted
    positions that are 1 (baselines and nulls have none), so that neither the plan
    nor a row grows with the number of categories and the driver reads none of them."""
    cols, baselines = list(cols or rules.CATEGORY_COLUMNS), dict(rules.ONE_HOT_BASELINES)
    if encode_gender:
        cols, baselines = [*cols, "gender"], baselines | {"gender": "F"}
    hot, names = one_hot_indices(cohort.select("icustay_id", *cols), cols, {c: v for c, v in baselines.items() if c in cols})
    split = grouped_split(cohort, "subject_id", rules.SPLIT_CUTS, seed)
    rows = (cohort.select("icustay_id", "subject_id", F.col("positive").cast("double").alias("label"),
                          *[F.col(c).cast("double").alias(c) for c in SPARSE_STATIC])
            .join(hot.select("icustay_id", "hot"), "icustay_id", "left"))
    return _with_arrays(rows, dp_arrays, cp_arrays, split), names


def is_unique(df: DataFrame, key: str) -> bool:
    """Whether no two rows share a value of ``key``; nulls don't count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def last_category_features(stays: DataFrame, last_only: DataFrame, labels: Sequence[str],
                           key: str = "icustay_id", category: str = "valuecat") -> DataFrame:
    """(key, one 0/1 column per label): whether the stay's most recent category of some
    type is the label.  ``labels`` is the fixed list of bin labels."""
    found = last_only.filter(F.col(category).isin(list(labels))).select(key, category)
    wide = found.groupBy(key).agg(*[F.max((F.col(category) == v).cast("int")).alias(v) for v in labels])
    return stays.select(key).join(wide, key, "left").na.fill(0, list(labels))
