"""Registered queries: one per operator of the inventory, plus the flagship.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
DuckDB SQL that computes the same table independently (``None`` where the
result is not SQL-expressible, e.g. a fitted model).  Queries run on the
whole test tables; floating aggregates whose summation order differs
between engines are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import arrays as arrfn
from ..functions import mathfns, strings, timefns
from ..operators import aggregates as agg_ops
from ..operators import codes as code_ops
from ..operators import cohort as cohort_ops
from ..operators import evaluate as eval_ops
from ..operators import events as event_ops
from ..operators import logistic
from ..operators import sequences as seq_ops
from ..operators import split as split_ops
from ..operators import windows
from ..operators.ordered import Placed
from ..session import materialize, scratch_path
from ..sources import files
from ..streaming import ingest
from . import oracle as O
from .flow import Flow
from .views import OBSCURE_CUTOFF_YEAR, TestViews

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def fmt_ints(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fmt_doubles(c: Column | str) -> Column:
    """Elements with six decimals, rounded half to even.  The zeros at the end, with which sequences are padded,
    are one repeated text, and where nothing is null, negative or large the others are cast as one array, as the
    formatting of single numbers costs far more than the arrays themselves."""
    c = F.col(c) if isinstance(c, str) else c
    n, pad = F.size(c), F.lit(",0.000000")

    def zeros_behind(r: Column) -> Column:  # of the reversed array
        last = F.array_position(r, F.get(F.array_remove(r, F.lit(0.0)), F.lit(0)))
        return F.coalesce((last - 1).cast("int"), F.when(F.size(F.array_compact(r)) == n, n).otherwise(0))

    def text(a: Column) -> Column:
        rounded = F.transform(a, lambda x: F.bround(x, 6))
        plain = (F.size(F.array_compact(a)) == F.size(a)) & (F.array_min(a) >= 0) & (F.array_max(a) < 1e9)
        each = F.transform(rounded, lambda x: F.format_string("%.6f", x))
        return F.array_join(F.when(plain, rounded.cast("array<decimal(16,6)>").cast("array<string>")).otherwise(each), ",")

    def joined(k: Column) -> Column:
        pads = F.repeat(pad, k)
        return F.concat(_bound(F.slice(c, 1, n - k), text), F.when(k == n, F.substr(pads, F.lit(2))).otherwise(pads))

    return F.when(c.isNotNull(), _bound(zeros_behind(F.reverse(c)), joined))


B = O.build

# schemas of the raw clinical-shaped tables (sources take them explicitly)
STAYS_SCHEMA = ("subject_id BIGINT, hadm_id BIGINT, icustay_id BIGINT, intime TIMESTAMP_NTZ, "
                "outtime TIMESTAMP_NTZ, los DOUBLE")
CHART_SCHEMA = ("subject_id BIGINT, hadm_id BIGINT, icustay_id STRING, itemid INT, charttime TIMESTAMP_NTZ, "
                "valuenum DOUBLE")
CODES_SCHEMA = "icustay_id BIGINT, icd9_code STRING, days_to_out DOUBLE"
METRIC_SCHEMA = ("epoch STRING, accuracy_scores DOUBLE, precision_scores DOUBLE, roc_auc_scores DOUBLE, "
                 "f1_scores DOUBLE, validation_losses DOUBLE")
PHASE_SCHEMA = "model STRING, phase STRING, accuracy DOUBLE, precision DOUBLE, roc_auc DOUBLE, f1 DOUBLE, loss DOUBLE"


# =============================================================================
# flagship
# =============================================================================
@register("readmission_cohort", B("SELECT * FROM cohort", "cohort"))
def readmission_cohort(spark, sf):
    """Labelled, enriched cohort: who returns within 30 days (one row per stay)."""
    return Flow(spark, sf).cohort


# =============================================================================
# 2.1 sources and sinks
# =============================================================================
@register("scan_typed_csv", B("SELECT * FROM v_stays", "v_stays"))
def scan_typed_csv(spark, sf):
    path = scratch_path(spark, "stays_csv")
    s = TestViews(spark, sf).stays
    wide = s.select("outtime", F.lit("x").alias("first_careunit"), "icustay_id", "subject_id", F.lit(1).alias("row_id"), "los",
                    "hadm_id", F.lit(None).cast("string").alias("last_careunit"), "intime")
    files.write_csv(wide, path)  # more columns, in another order
    return files.read_events_csv(spark, path, STAYS_SCHEMA)


# The header of a raw chart file.
CHART_HEADER = ["ROW_ID", "SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "ITEMID", "CHARTTIME", "STORETIME", "CGID", "VALUE", "VALUENUM",
                "VALUEUOM", "WARNING", "ERROR", "RESULTSTATUS", "STOPPED"]


def as_chart_file(chart: DataFrame) -> DataFrame:
    """The rows in the layout of a raw chart file: all its columns, unused ones as some text or empty."""
    have = {c.upper() for c in chart.columns}
    fill = {"ROW_ID": F.lit("1"), "VALUE": F.lit("as, text"), "VALUEUOM": F.lit("bpm")}
    return chart.select(*[F.col(c.lower()).alias(c) if c in have else fill.get(c, F.lit(None).cast("string")).alias(c)
                          for c in CHART_HEADER])


def _chart_ingest(spark, sf, per_trigger):
    raw, out, ckpt = (scratch_path(spark, n) for n in ("chart_raw", "chart_clean", "chart_ckpt"))
    files.write_csv(as_chart_file(TestViews(spark, sf).chart).repartition(4), raw)
    return ingest.ingest_once(spark, raw, out, ckpt, CHART_SCHEMA, event_ops.clean_chart_events, per_trigger)


@register("chunked_append_ingest", B("SELECT * FROM chart_clean", "chart_clean"))
def chunked_append_ingest(spark, sf):
    """Raw chart files cleaned and appended by the file stream (all files, one batch)."""
    return _chart_ingest(spark, sf, None)


@register("mixed_header_ingest", B("SELECT * FROM chart_clean", "chart_clean"))
def mixed_header_ingest(spark, sf):
    """Raw chart files in two column orders in one folder, cleaned by the stream of file names."""
    raw, out, ckpt = (scratch_path(spark, n) for n in ("chart_mixed", "chart_clean", "chart_ckpt"))
    rows = as_chart_file(TestViews(spark, sf).chart)
    later = F.pmod(F.xxhash64("ITEMID", "CHARTTIME", "VALUENUM"), F.lit(2)) == 1
    files.write_csv(rows.filter(~later).repartition(2), raw)
    files.write_csv(rows.filter(later).select(*reversed(rows.columns)).repartition(2), raw, mode="append")
    return ingest.ingest_mixed_once(spark, raw, out, ckpt, CHART_SCHEMA, event_ops.clean_chart_events, 2)


@register("stage_table_read", B("SELECT * FROM cohort", "cohort"))
def stage_table_read(spark, sf):
    path = scratch_path(spark, "cohort_stage")
    files.write_stage(Flow(spark, sf).cohort, path)
    return files.read_stage(spark, path)


@register("stage_table_write", B("SELECT * FROM codes", "codes"))
def stage_table_write(spark, sf):
    path = scratch_path(spark, "codes_stage")
    files.write_stage(Flow(spark, sf).codes, path, fmt="csv")
    return files.read_events_csv(spark, path, CODES_SCHEMA)


def _feature_text(df: DataFrame, *more: str) -> DataFrame:
    return df.select("icustay_id", "subject_id", "label", "split", fmt_ints("dp").alias("dp"),
                     fmt_doubles("dp_times").alias("dp_times"), fmt_ints("cp").alias("cp"),
                     fmt_doubles("cp_times").alias("cp_times"), *more)


FEATURE_TEXT_SQL = f"""
SELECT c.icustay_id, c.subject_id, CAST(c.positive AS DOUBLE) AS label, s.split,
       {O.fmt_list_sql('d.dp')} AS dp, {O.fmt_list_sql('d.dp_times', True)} AS dp_times,
       {O.fmt_list_sql('p.cp')} AS cp, {O.fmt_list_sql('p.cp_times', True)} AS cp_times
FROM cohort c JOIN dp_arrays d ON c.icustay_id = d.icustay_id JOIN cp_arrays p ON c.icustay_id = p.icustay_id
LEFT JOIN split s ON c.subject_id = s.subject_id"""


@register("feature_bundle_write", B(FEATURE_TEXT_SQL, "cohort", "dp_arrays", "cp_arrays", "split"))
def feature_bundle_write(spark, sf):
    f = Flow(spark, sf)
    out = scratch_path(spark, "features")
    files.write_features(f.features, f.dp_arrays[1], f.cp_arrays[1], out)
    return _feature_text(spark.read.parquet(f"{out}/features"))


@register("feature_bundle_dictionaries", B("SELECT 'dp' AS which, idx, icd9_code AS code FROM dict_dp UNION ALL "
                                           "SELECT 'cp', idx, valuecat FROM dict_cp", "dict_dp", "dict_cp"))
def feature_bundle_dictionaries(spark, sf):
    """Both code dictionaries as the bundle holds them."""
    f = Flow(spark, sf)
    out = scratch_path(spark, "features")
    files.write_features(f.features, f.dp_arrays[1], f.cp_arrays[1], out)
    d, c = spark.read.parquet(f"{out}/dict_dp"), spark.read.parquet(f"{out}/dict_cp")
    return d.select(F.lit("dp").alias("which"), "idx", F.col("icd9_code").alias("code")).unionByName(
        c.select(F.lit("cp").alias("which"), "idx", F.col("valuecat").alias("code")))


# -- metric tables (per model = document language, per epoch = document source) --
def _metric_history(spark, sf) -> DataFrame:
    s = TestViews(spark, sf).scores
    w = eval_ops.pos_weight(s, "y")
    m = eval_ops.evaluate(s, "logit", "y", weight=w, keys=["lang", "source"])
    return m.select(F.col("lang").alias("model"), F.col("source").alias("epoch"),
                    F.col("accuracy").alias("accuracy_scores"), F.col("average_precision").alias("precision_scores"),
                    F.col("roc_auc").alias("roc_auc_scores"), F.col("f1").alias("f1_scores"),
                    F.col("loss").alias("validation_losses"))


O.cte("pw", ["v_scores"], "SELECT (count(*) - sum(y)) / NULLIF(sum(y), 0)::DOUBLE AS pos_weight FROM v_scores")
O.cte("mh_g", ["scored"], "SELECT lang, source, p, sum(y) AS tp, count(*) AS n FROM scored GROUP BY lang, source, p")
O.cte("mh_c", ["mh_g"], """
SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM mh_g
WINDOW w AS (PARTITION BY lang, source ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
O.cte("mh_rank", ["mh_c"], """
SELECT lang, source, sum(tp * ctp / cn) / NULLIF(sum(tp), 0)::DOUBLE AS ap,
       sum((n - tp) * (2 * ctp - tp)) / NULLIF(2.0::DOUBLE * sum(tp) * sum(n - tp), 0) AS auc
FROM mh_c GROUP BY lang, source""")
O.cte("mh_cls", ["scored_pred", "pw"], """
SELECT lang, source, avg(CAST(pred = y AS INTEGER)) AS acc,
       CASE WHEN 2 * sum(pred * y) + sum(pred * (1 - y)) + sum((1 - pred) * y) = 0 THEN 0.0::DOUBLE
            ELSE 2 * sum(pred * y) / (2 * sum(pred * y) + sum(pred * (1 - y)) + sum((1 - pred) * y))::DOUBLE END AS f1,
       sum(pos_weight * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
           + (1 - y) * (logit + greatest(-logit, 0) + ln(1 + exp(-abs(logit))))) AS loss
FROM scored_pred, pw GROUP BY lang, source""")
O.cte("metric_history", ["mh_rank", "mh_cls"], """
SELECT c.lang AS model, c.source AS epoch, c.acc AS accuracy_scores, r.ap AS precision_scores,
       r.auc AS roc_auc_scores, c.f1 AS f1_scores, c.loss AS validation_losses
FROM mh_cls c JOIN mh_rank r ON c.lang = r.lang AND c.source = r.source""")

HISTORY_ROUNDED = ("SELECT model, epoch, round(accuracy_scores, 6) AS accuracy_scores, round(precision_scores, 6) AS "
                   "precision_scores, round(roc_auc_scores, 6) AS roc_auc_scores, round(f1_scores, 6) AS f1_scores, "
                   "round(validation_losses, 6) AS validation_losses FROM metric_history")


def _round_history(df: DataFrame) -> DataFrame:
    return df.select("model", "epoch", *[r6(c).alias(c) for c in
                                         ["accuracy_scores", "precision_scores", "roc_auc_scores", "f1_scores",
                                          "validation_losses"]])


@register("metrics_csv_scan", B(HISTORY_ROUNDED, "metric_history"))
def metrics_csv_scan(spark, sf):
    """Metric files of several models read back, the model taken from the folder's name."""
    root = scratch_path(spark, "metrics")
    runs = _metric_history(spark, sf).withColumn("run", F.concat("model", F.lit("_training_results"))).drop("model")
    files.write_stage(runs, root, fmt="csv", partition_by=["run"])
    return _round_history(files.read_metrics(spark, [f"{root}/*"], METRIC_SCHEMA, r"([^/=]+?)_training_results"))


@register("metrics_epoch_numbers", B("""
SELECT model, epoch AS name, row_number() OVER (PARTITION BY model ORDER BY epoch) AS epoch,
       round(accuracy_scores, 6) AS accuracy_scores FROM metric_history""", "metric_history"))
def metrics_epoch_numbers(spark, sf):
    """A metric history that grew by two appends, its epochs numbered."""
    path = scratch_path(spark, "metric_history")
    h = materialize(_metric_history(spark, sf), "metric_history")
    for part in (0, 1):
        files.append_metrics(h.filter(F.length("epoch") % 2 == part), path)
    back = files.read_events_csv(spark, path, "model STRING, " + METRIC_SCHEMA)
    return files.number_epochs(back.withColumnRenamed("epoch", "name"), "name").select(
        "model", "name", "epoch", r6("accuracy_scores").alias("accuracy_scores"))


# phases: documents split into train/validate/test by the grouped split on doc_id
O.cte("doc_split", ["v_scores"], f"""
SELECT doc_id, CASE WHEN r < floor(0.7::DOUBLE * n) THEN 'train' WHEN r < floor(0.8::DOUBLE * n) THEN 'validate'
                    ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{rules.SPLIT_SEED}'), doc_id) - 1 AS r,
             count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM v_scores))""")
O.cte("phased", ["scored_pred", "doc_split", "pw"], """
SELECT s.*, CASE d.split WHEN 'validate' THEN 'Validation' ELSE 'Testing' END AS phase, pw.pos_weight
FROM scored_pred s JOIN doc_split d ON s.doc_id = d.doc_id, pw WHERE d.split IN ('validate', 'test')""")
O.cte("ph_g", ["phased"], "SELECT lang, phase, source, p, sum(y) AS tp, count(*) AS n FROM phased GROUP BY ALL")
O.cte("ph_c", ["ph_g"], """
SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM ph_g
WINDOW w AS (PARTITION BY lang, phase, source ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
O.cte("phase_rows", ["ph_c", "phased"], """
SELECT a.lang AS model, a.phase, a.source AS epoch, a.acc AS accuracy, r.ap AS precision, r.auc AS roc_auc, a.f1, a.loss
FROM (SELECT lang, phase, source, avg(CAST(pred = y AS INTEGER)) AS acc,
             CASE WHEN 2 * sum(pred * y) + sum(pred * (1 - y)) + sum((1 - pred) * y) = 0 THEN 0.0::DOUBLE
                  ELSE 2 * sum(pred * y) / (2 * sum(pred * y) + sum(pred * (1 - y)) + sum((1 - pred) * y))::DOUBLE END AS f1,
             sum(pos_weight * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
                 + (1 - y) * (logit + greatest(-logit, 0) + ln(1 + exp(-abs(logit))))) AS loss
      FROM phased GROUP BY lang, phase, source) a
JOIN (SELECT lang, phase, source, sum(tp * ctp / cn) / NULLIF(sum(tp), 0)::DOUBLE AS ap,
             sum((n - tp) * (2 * ctp - tp)) / NULLIF(2.0::DOUBLE * sum(tp) * sum(n - tp), 0) AS auc
      FROM ph_c GROUP BY lang, phase, source) r ON a.lang = r.lang AND a.phase = r.phase AND a.source = r.source""")
O.cte("phase_table", ["phase_rows"], """
SELECT model, phase, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(roc_auc) AS roc_auc, avg(f1) AS f1,
       avg(loss) AS loss FROM phase_rows GROUP BY model, phase""")


def _phase_rows(spark, sf) -> DataFrame:
    s = TestViews(spark, sf).scores
    w = eval_ops.pos_weight(s, "y")
    parts = split_ops.grouped_split(s, "doc_id", rules.SPLIT_CUTS, rules.SPLIT_SEED)
    d = s.join(parts, "doc_id")
    out = []
    for part, phase in (("validate", "Validation"), ("test", "Testing")):
        m = eval_ops.evaluate(split_ops.subset(d, part), "logit", "y", weight=w, keys=["lang", "source"])
        out.append(m.select(F.col("lang").alias("model"), F.lit(phase).alias("phase"), F.col("source").alias("epoch"),
                            "accuracy", F.col("average_precision").alias("precision"), "roc_auc", "f1", "loss"))
    return eval_ops.union_results(*out)


PHASE_METRICS = ["accuracy", "precision", "roc_auc", "f1", "loss"]
PHASE_ROUNDED = ("SELECT model, phase, " + ", ".join(f"round({m}, 6) AS {m}" for m in PHASE_METRICS)
                 + " FROM phase_table")


@register("metrics_write", B(PHASE_ROUNDED, "phase_table"))
def metrics_write(spark, sf):
    path = scratch_path(spark, "phase_metrics")
    files.write_metrics(eval_ops.model_phase_table(_phase_rows(spark, sf), PHASE_METRICS), path)
    back = files.read_events_csv(spark, path, PHASE_SCHEMA)
    return back.select("model", "phase", *[r6(m).alias(m) for m in PHASE_METRICS])


# =============================================================================
# 2.2 projections, filters, predicates
# =============================================================================
@register("filter_observed_items", B("SELECT * FROM chart_obs", "chart_obs"))
def filter_observed_items(spark, sf):
    return event_ops.observed(TestViews(spark, sf).chart, rules.RELEVANT_IDS)


@register("drop_null_rows", B("SELECT * FROM v_meds WHERE icustay_id IS NOT NULL AND drug IS NOT NULL "
                              "AND startdate IS NOT NULL", "v_meds"))
def drop_null_rows(spark, sf):
    return TestViews(spark, sf).meds.na.drop("any")


@register("filter_not_died_in_stay", B("SELECT * FROM alive", "alive"))
def filter_not_died_in_stay(spark, sf):
    v = TestViews(spark, sf)
    pj = cohort_ops.join_stays_patients(v.stays, cohort_ops.with_birthdate_shift(v.patients, "dob", OBSCURE_CUTOFF_YEAR))
    return cohort_ops.exclude_died_in_stay(pj)


def _adults(spark, sf) -> DataFrame:
    df = filter_not_died_in_stay(spark, sf)
    df = windows.trailing_count(df, "subject_id", "outtime", rules.RECENT_MIN_DAYS, rules.RECENT_MAX_DAYS,
                                out="num_recent_admissions")
    return materialize(cohort_ops.min_age(cohort_ops.with_age(df)), "adults")


@register("filter_min_age", B("SELECT * FROM adult", "adult"))
def filter_min_age(spark, sf):
    return _adults(spark, sf)


@register("filter_eligible_label", B("SELECT * FROM cbase", "cbase"))
def filter_eligible_label(spark, sf):
    return Flow(spark, sf).cohort_base


def _codes_adm(spark, sf) -> DataFrame:
    v = TestViews(spark, sf)
    codes = code_ops.union_tagged({rules.DIAG_PREFIX: v.diagnoses, rules.PROC_PREFIX: v.procedures})
    return code_ops.join_codes_admissions(codes, v.admissions)


@register("filter_known_at_discharge", B("SELECT DISTINCT icustay_id, icd9_code, admittime, dischtime FROM hist", "hist"))
def filter_known_at_discharge(spark, sf):
    stays = Flow(spark, sf).cohort.select("subject_id", "icustay_id", "outtime")
    h = code_ops.point_in_time_history(stays, _codes_adm(spark, sf))
    return code_ops.distinct_known(h, stays, ["icustay_id", "icd9_code", "admittime", "dischtime"])


@register("filter_plausible_range", B("SELECT * FROM chart_clean", "chart_clean"))
def filter_plausible_range(spark, sf):
    return Flow(spark, sf).chart_clean


@register("filter_cap_before_after_sum",
          B("SELECT icustay_id, chartday, round(valuenum, 6) AS valuenum, ce_type FROM out_daily", "out_daily"))
def filter_cap_before_after_sum(spark, sf):
    v = TestViews(spark, sf)
    d = event_ops.daily_outputs(v.outputs, event_ops.select_items(v.items))
    return d.select("icustay_id", "chartday", r6("valuenum").alias("valuenum"), "ce_type")


@register("filter_item_dictionary", B(f"""
SELECT itemid, lower(label) AS label, unitname, linksto FROM v_items WHERE itemid IN {O._in(rules.URINE_OUTPUT)}
AND (NOT (contains(lower(label), 'hr') OR contains(lower(label), 'kg')) OR contains(lower(label), 'nephro'))""", "v_items"))
def filter_item_dictionary(spark, sf):
    return event_ops.select_items(TestViews(spark, sf).items)


@register("filter_by_type", B("SELECT * FROM chart_clean WHERE ce_type IN ('HEART_RATE', 'MEAN_BP')", "chart_clean"))
def filter_by_type(spark, sf):
    return Flow(spark, sf).chart_clean.filter(F.col("ce_type").isin("HEART_RATE", "MEAN_BP"))


@register("truncate_long_sequences", B("SELECT * FROM cp_trunc", "cp_trunc"))
def truncate_long_sequences(spark, sf):
    cp, parts = Flow(spark, sf).cp_by_stay
    d = materialize(seq_ops.sequence_positions(cp, "icustay_id", "hours_to_out", "valuecat", like=cp if parts else None), "positions")
    return seq_ops.truncate_sequences(d, "icustay_id", rules.CP_QUANTILE)


@register("rename_drop_select", B("SELECT icustay_id AS stay_id, subject_id, intime AS start_time, outtime AS end_time "
                                  "FROM v_stays", "v_stays"))
def rename_drop_select(spark, sf):
    s = TestViews(spark, sf).stays
    return (s.withColumnRenamed("icustay_id", "stay_id").drop("los", "hadm_id")
             .select("stay_id", "subject_id", F.col("intime").alias("start_time"), F.col("outtime").alias("end_time")))


O.cte("cats", ["cohort"], "\nUNION ALL\n".join(
    f"SELECT '{c.upper()}' AS col, {c} AS val FROM cohort WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in rules.CATEGORY_COLUMNS))
O.cte("one_hot_long", ["cohort", "cats"], """
SELECT c.icustay_id, k.col || '_' || k.val AS feature,
       CASE WHEN (CASE k.col """ + " ".join(f"WHEN '{c.upper()}' THEN c.{c}" for c in rules.CATEGORY_COLUMNS) + """ END) = k.val
            THEN 1 ELSE 0 END AS value
FROM cohort c CROSS JOIN cats k
WHERE NOT (""" + " OR ".join(f"(k.col = '{c.upper()}' AND k.val = {O._q(v)})"
                             for c, v in rules.ONE_HOT_BASELINES.items()) + ")")


def _one_hot_long(spark, sf) -> tuple[DataFrame, list[str]]:
    f = Flow(spark, sf)
    oh = split_ops.one_hot(f.cohort, f.categories, rules.ONE_HOT_BASELINES)
    dummies = [c for c in oh.columns if c not in f.cohort.columns]
    return oh, dummies


def _melt(df: DataFrame, cols: list[str], value_type: str) -> DataFrame:
    return df.unpivot(["icustay_id"], [F.col(f"`{c}`").cast(value_type).alias(c) for c in cols], "feature", "value")


@register("one_hot_reference_drop", B("SELECT * FROM one_hot_long", "one_hot_long"))
def one_hot_reference_drop(spark, sf):
    oh, dummies = _one_hot_long(spark, sf)
    return _melt(oh, dummies, "int")


O.cte("hot_names", ["one_hot_long"], """
SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT feature FROM one_hot_long WHERE value = 1)""")
O.cte("hot", ["one_hot_long", "hot_names", "cohort"], """
SELECT c.icustay_id, coalesce(string_agg(CAST(n.idx AS VARCHAR), ',' ORDER BY n.idx), '') AS hot
FROM cohort c LEFT JOIN (SELECT * FROM one_hot_long WHERE value = 1) o ON c.icustay_id = o.icustay_id
LEFT JOIN hot_names n ON o.feature = n.feature GROUP BY c.icustay_id""")


@register("one_hot_indices", B("SELECT * FROM hot", "hot"))
def one_hot_indices(spark, sf):
    """The encoding as sorted positions (rendered as text), for any number of categories."""
    hot, _ = split_ops.one_hot_indices(Flow(spark, sf).cohort.select("icustay_id", *rules.CATEGORY_COLUMNS),
                                       rules.CATEGORY_COLUMNS, rules.ONE_HOT_BASELINES)
    return hot.select("icustay_id", fmt_ints("hot").alias("hot"))


@register("one_hot_names", B("SELECT idx, feature FROM hot_names", "hot_names"))
def one_hot_names(spark, sf):
    """The names of the positions."""
    return split_ops.one_hot_indices(Flow(spark, sf).cohort.select("icustay_id", *rules.CATEGORY_COLUMNS),
                                     rules.CATEGORY_COLUMNS, rules.ONE_HOT_BASELINES)[1]


STATIC_SQL = """
SELECT icustay_id, feature, CAST(value AS DOUBLE) AS value FROM one_hot_long
UNION ALL SELECT icustay_id, 'los', los FROM cohort
UNION ALL SELECT icustay_id, 'num_recent_admissions', CAST(num_recent_admissions AS DOUBLE) FROM cohort
UNION ALL SELECT icustay_id, 'age', age FROM cohort
UNION ALL SELECT icustay_id, 'pre_icu_los', pre_icu_los FROM cohort
UNION ALL SELECT icustay_id, 'elective_surgery', CAST(elective_surgery AS DOUBLE) FROM cohort"""


@register("select_columns_regex", B(STATIC_SQL, "one_hot_long", "cohort"))
def select_columns_regex(spark, sf):
    oh, _ = _one_hot_long(spark, sf)
    static = split_ops.select_regex(oh.drop("subject_id", "hadm_id", "icustay_id", "intime", "outtime", "gender",
                                            "positive"), rules.STATIC_PATTERN)
    return _melt(oh, static, "double")


@register("constant_type_column", B("SELECT *, 'PRESCRIPTIONS' AS source FROM meds_clean", "meds_clean"))
def constant_type_column(spark, sf):
    return seq_ops.prescriptions(TestViews(spark, sf).meds).withColumn("source", F.lit("PRESCRIPTIONS"))


# =============================================================================
# 2.3 joins
# =============================================================================
@register("join_stays_patients", B("SELECT s.*, p.gender, p.dob, p.dod FROM v_stays s JOIN v_patients p "
                                   "ON s.subject_id = p.subject_id", "v_stays", "v_patients"))
def join_stays_patients(spark, sf):
    v = TestViews(spark, sf)
    return cohort_ops.join_stays_patients(v.stays, v.patients)


@register("left_join_admissions", B("""
SELECT b.*, a.admission_location, a.insurance, a.marital_status, a.ethnicity, a.admittime, a.admission_type, a.dischtime
FROM cbase b LEFT JOIN v_admissions a ON b.subject_id = a.subject_id AND b.hadm_id = a.hadm_id""", "cbase", "v_admissions"))
def left_join_admissions(spark, sf):
    f = Flow(spark, sf)
    return cohort_ops.left_join_admissions(f.cohort_base, f.v.admissions)


@register("left_join_first_service", B("""
SELECT b.subject_id, b.hadm_id, b.icustay_id, f.transfertime, f.curr_service, f.surgery
FROM cbase b LEFT JOIN fserv f ON b.subject_id = f.subject_id AND b.hadm_id = f.hadm_id""", "cbase", "fserv"))
def left_join_first_service(spark, sf):
    f = Flow(spark, sf)
    j = cohort_ops.left_join_first_service(f.cohort_base.select("subject_id", "hadm_id", "icustay_id"), f.v.services)
    return j.select("subject_id", "hadm_id", "icustay_id", "transfertime", "curr_service", "surgery")


@register("elective_surgery_compat", B("""
SELECT b.icustay_id, CASE WHEN f.curr_service IS NULL THEN NULL ELSE false END AS surgery
FROM cbase b LEFT JOIN fserv f ON b.subject_id = f.subject_id AND b.hadm_id = f.hadm_id""", "cbase", "fserv"))
def elective_surgery_compat(spark, sf):
    """The service flag as the original rule's precedence gives it: never true."""
    f = Flow(spark, sf)
    return cohort_ops.left_join_first_service(f.cohort_base, f.v.services, compat=True).select("icustay_id", "surgery")


@register("join_codes_admissions", B("SELECT * FROM codes_adm", "codes_adm"))
def join_codes_admissions(spark, sf):
    return _codes_adm(spark, sf)


@register("point_in_time_history_join", B("SELECT * FROM codes_dedup", "codes_dedup"))
def point_in_time_history_join(spark, sf):
    stays = Flow(spark, sf).cohort.select("subject_id", "icustay_id", "outtime")
    known, _ = code_ops.known_codes(stays, _codes_adm(spark, sf))  # by point_in_time_history
    return code_ops.distinct_known(known, stays, code_ops.KNOWN)


@register("anti_join_boundary_days", B("SELECT icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type "
                                       "FROM out_reduced", "out_reduced"))
def anti_join_boundary_days(spark, sf):
    return Flow(spark, sf).outputs_reduced.withColumn("valuenum", r6("valuenum"))


O.cte("out_obs_c", ["v_outputs", "items_sel"], O.CTES["out_obs"][1].replace("AND value > 0", "AND value <> 0"))
O.cte("out_daily_c", ["out_obs_c"], O.CTES["out_daily"][1].replace("FROM out_obs ", "FROM out_obs_c "))
O.cte("out_reduced_c", ["out_daily_c", "v_stays"], O.CTES["out_reduced"][1].replace("FROM out_daily o", "FROM out_daily_c o"))


@register("outputs_compat", B("SELECT icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type FROM out_reduced_c",
                              "out_reduced_c"))
def outputs_compat(spark, sf):
    """Output events as the original rule's precedence keeps them: negative values count."""
    return Flow(spark, sf, compat=True).outputs_reduced.withColumn("valuenum", r6("valuenum"))


@register("left_join_stay_events", B("""
SELECT c.icustay_id, e.valuecat, e.charttime FROM cohort c LEFT JOIN cp_events e ON c.icustay_id = e.icustay_id""",
                                     "cohort", "cp_events"))
def left_join_stay_events(spark, sf):
    f = Flow(spark, sf)
    ev = f.runs.select("icustay_id", "valuecat", "charttime").unionByName(seq_ops.prescriptions(f.v.meds))
    return seq_ops.left_join_stay_events(f.cohort.select("icustay_id"), ev)


@register("semi_join_item_dictionary", B("SELECT * FROM v_outputs WHERE itemid IN (SELECT itemid FROM items_sel)",
                                         "v_outputs", "items_sel"))
def semi_join_item_dictionary(spark, sf):
    v = TestViews(spark, sf)
    return event_ops.restrict_to_items(v.outputs, event_ops.select_items(v.items))


@register("membership_flags", B("SELECT c.icustay_id, c.subject_id, s.split FROM cohort c LEFT JOIN split s "
                                "ON c.subject_id = s.subject_id", "cohort", "split"))
def membership_flags(spark, sf):
    f = Flow(spark, sf)
    return split_ops.attach_split(f.cohort.select("icustay_id", "subject_id"), f.split)


@register("densify_sequence_grid", B("""
SELECT c.icustay_id, g.pos, coalesce(e.idx, 0) AS idx, coalesce(round(e.t, 6), 0.0::DOUBLE) AS t
FROM cohort c CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(pos) + 1 FROM cp_enc))) AS INTEGER) AS pos) g
LEFT JOIN cp_enc e ON c.icustay_id = e.icustay_id AND g.pos = e.pos""", "cohort", "cp_enc"))
def densify_sequence_grid(spark, sf):
    f = Flow(spark, sf)
    cp, parts = f.cp_by_stay
    enc, _ = seq_ops.encoded_sequence(cp, "icustay_id", "valuecat", "hours_to_out", rules.CP_QUANTILE, "cp", parts=parts)
    enc = enc.select("icustay_id", "pos", "idx", r6(F.coalesce("hours_to_out", F.lit(0.0))).alias("t"))
    return seq_ops.densify_grid(enc, f.cohort, "icustay_id", "pos", {"idx": 0, "t": 0.0}, parts=parts)


# =============================================================================
# 2.4 aggregations
# =============================================================================
@register("daily_sum_per_stay", B(f"""
SELECT CAST(CAST(icustay_id AS DOUBLE) AS BIGINT) AS icustay_id, CAST(charttime AS DATE) AS chartday,
       round(sum(value), 6) AS value
FROM v_outputs WHERE icustay_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""", "v_outputs"))
def daily_sum_per_stay(spark, sf):
    o = TestViews(spark, sf).outputs.filter(F.col("icustay_id").isNotNull() & F.col("value").isNotNull())
    o = o.withColumn("icustay_id", event_ops.stay_id_from_text("icustay_id"))
    return agg_ops.daily_sum(o, "icustay_id", "charttime", "value").withColumn("value", r6("value"))


GCS_TYPES = ["GCS_EYE_OPENING", "GCS_VERBAL_RESPONSE", "GCS_MOTOR_RESPONSE", "GCS_TOTAL"]


@register("pivot_mean", B("SELECT subject_id, icustay_id, charttime, round(e, 6) AS GCS_EYE_OPENING, round(vr, 6) AS "
                          "GCS_VERBAL_RESPONSE, round(m, 6) AS GCS_MOTOR_RESPONSE, round(t, 6) AS GCS_TOTAL FROM gcs_p",
                          "gcs_p"))
def pivot_mean(spark, sf):
    c = Flow(spark, sf).chart_clean.filter(F.col("ce_type").isin(GCS_TYPES))
    p = agg_ops.pivot_mean(c, ["subject_id", "icustay_id", "charttime"], "ce_type", "valuenum", GCS_TYPES)
    return p.select("subject_id", "icustay_id", "charttime", *[r6(t).alias(t) for t in GCS_TYPES])


@register("value_counts", B("SELECT icd9_code, count(*) AS n FROM codes_dedup WHERE icd9_code IS NOT NULL "
                            "GROUP BY icd9_code", "codes_dedup"))
def value_counts(spark, sf):
    return agg_ops.value_counts(point_in_time_history_join(spark, sf), "icd9_code")


@register("lump_rare_values", B("SELECT * FROM codes", "codes"))
def lump_rare_values(spark, sf):
    return Flow(spark, sf).codes


@register("group_sizes", B("SELECT icustay_id, count(*) AS n FROM cp GROUP BY icustay_id", "cp"))
def group_sizes(spark, sf):
    return agg_ops.group_sizes(Flow(spark, sf).cp, "icustay_id")


@register("exact_quantile", B("SELECT q FROM cp_q", "cp_q"))
def exact_quantile(spark, sf):
    return agg_ops.exact_quantile(agg_ops.group_sizes(Flow(spark, sf).cp, "icustay_id"), "n", rules.CP_QUANTILE)


@register("global_max_normalise", B("SELECT icustay_id, icd9_code, days_to_out / (SELECT max(days_to_out) FROM codes) "
                                    "AS days_to_out FROM codes", "codes"))
def global_max_normalise(spark, sf):
    return agg_ops.max_normalise(Flow(spark, sf).codes, "days_to_out")


@register("attrition_counts", B("""
SELECT 1 AS step, 'joined' AS stage, CAST(count(DISTINCT subject_id) AS BIGINT) AS subjects, CAST(count(DISTINCT icustay_id) AS BIGINT) AS stays FROM pj
UNION ALL SELECT 2, 'survived_stay', count(DISTINCT subject_id), count(DISTINCT icustay_id) FROM alive
UNION ALL SELECT 3, 'adult', count(DISTINCT subject_id), count(DISTINCT icustay_id) FROM adult
UNION ALL SELECT 4, 'positive', NULL, CAST(sum(CAST(positive AS INTEGER)) AS BIGINT) FROM early
UNION ALL SELECT 5, 'early_death', NULL, CAST(sum(CAST(early_death AS INTEGER)) AS BIGINT) FROM early
UNION ALL SELECT 6, 'eligible', count(DISTINCT subject_id), count(DISTINCT icustay_id) FROM cbase""",
                                "pj", "alive", "adult", "early", "cbase"))
def attrition_counts(spark, sf):
    v = TestViews(spark, sf)
    return cohort_ops.attrition(v.stays, v.patients, dob_cutoff_year=OBSCURE_CUTOFF_YEAR)


@register("drop_duplicates", B("SELECT * FROM codes_dedup", "codes_dedup"))
def drop_duplicates(spark, sf):
    stays = Flow(spark, sf).cohort.select("subject_id", "icustay_id", "outtime")
    known, _ = code_ops.known_codes(stays, _codes_adm(spark, sf))  # by point_in_time_history
    return code_ops.distinct_known(known, stays, code_ops.KNOWN)  # by agg_ops.drop_duplicates


@register("class_balance_weight", B("SELECT (count(*) - sum(CAST(positive AS INTEGER))) / "
                                    "NULLIF(sum(CAST(positive AS INTEGER)), 0)::DOUBLE AS pos_weight FROM cohort", "cohort"))
def class_balance_weight(spark, sf):
    return eval_ops.pos_weight(Flow(spark, sf).cohort.withColumn("y", F.col("positive").cast("int")), "y")


@register("mean_metrics_by_model", B("""
SELECT model, round(avg(accuracy_scores), 6) AS accuracy_scores, round(avg(precision_scores), 6) AS precision_scores,
       round(avg(roc_auc_scores), 6) AS roc_auc_scores, round(avg(f1_scores), 6) AS f1_scores,
       round(avg(validation_losses), 6) AS validation_losses FROM metric_history GROUP BY model""", "metric_history"))
def mean_metrics_by_model(spark, sf):
    m = eval_ops.mean_metrics(_metric_history(spark, sf).drop("epoch"), "model")
    return m.select("model", *[r6(c).alias(c) for c in m.columns if c != "model"])


@register("metrics_by_model_phase", B(PHASE_ROUNDED, "phase_table"))
def metrics_by_model_phase(spark, sf):
    t = eval_ops.model_phase_table(_phase_rows(spark, sf), PHASE_METRICS)
    return t.select("model", "phase", *[r6(m).alias(m) for m in PHASE_METRICS])


O.cte("g_thr", ["scored_pred"], "SELECT pred, sum(y) AS tp, count(*) AS n FROM scored_pred GROUP BY pred")
O.cte("c_thr", ["g_thr"], """
SELECT *, sum(tp) OVER (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING) AS ctp,
          sum(n) OVER (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g_thr""")


@register("thresholded_metrics", B("""
SELECT round(sum(tp * ctp / cn) / NULLIF(sum(tp), 0)::DOUBLE, 6) AS average_precision,
       round(sum((n - tp) * (2 * ctp - tp)) / NULLIF(2.0::DOUBLE * sum(tp) * sum(n - tp), 0), 6) AS roc_auc FROM c_thr""", "c_thr"))
def thresholded_metrics(spark, sf):
    """Ranking metrics of the 0/1 predictions instead of the scores."""
    m = eval_ops.evaluate(TestViews(spark, sf).scores, "logit", "y", mode="thresholded")
    return m.select(r6("average_precision").alias("average_precision"), r6("roc_auc").alias("roc_auc"))


@register("weighted_bce_loss", B("""
SELECT round(avg(l), 6) AS mean_loss, round(sum(l), 6) AS total_loss FROM (
  SELECT pos_weight * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
         + (1 - y) * (logit + greatest(-logit, 0) + ln(1 + exp(-abs(logit)))) AS l FROM v_scores, pw)""", "v_scores", "pw"))
def weighted_bce_loss(spark, sf):
    s = TestViews(spark, sf).scores
    w = eval_ops.pos_weight(s, "y")
    out = eval_ops.weighted_bce(s.crossJoin(F.broadcast(w)), "logit", "y", F.col("pos_weight"))
    return out.select(r6("mean_loss").alias("mean_loss"), r6("total_loss").alias("total_loss"))


@register("confusion_counts", B("""
SELECT CAST(sum(pred * y) AS BIGINT) AS tp, CAST(sum(pred * (1 - y)) AS BIGINT) AS fp,
       CAST(sum((1 - pred) * (1 - y)) AS BIGINT) AS tn, CAST(sum((1 - pred) * y) AS BIGINT) AS fn FROM scored_pred""",
                                "scored_pred"))
def confusion_counts(spark, sf):
    s = TestViews(spark, sf).scores.withColumn("p", mathfns.sigmoid("logit"))
    return eval_ops.confusion(s, "p", "y")


@register("accuracy_f1", B("""
SELECT round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1
FROM (SELECT sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum((1 - pred) * (1 - y)) AS tn, sum((1 - pred) * y) AS fn
      FROM scored_pred)""", "scored_pred"))
def accuracy_f1(spark, sf):
    s = TestViews(spark, sf).scores.withColumn("p", mathfns.sigmoid("logit"))
    a = eval_ops.accuracy_f1(eval_ops.confusion(s, "p", "y"))
    return a.select(r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


O.cte("g_all", ["scored"], "SELECT p, sum(y) AS tp, count(*) AS n FROM scored GROUP BY p")
O.cte("c_all", ["g_all"], """
SELECT *, sum(tp) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
          sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM g_all""")


@register("average_precision", B("SELECT round(sum(tp * ctp / cn) / NULLIF(sum(tp), 0)::DOUBLE, 6) AS average_precision "
                                 "FROM c_all", "c_all"))
def average_precision(spark, sf):
    s = TestViews(spark, sf).scores.withColumn("p", mathfns.sigmoid("logit"))
    return eval_ops.average_precision(s, "p", "y").select(r6("average_precision").alias("average_precision"))


@register("roc_auc", B("SELECT round(sum((n - tp) * (2 * ctp - tp)) / NULLIF(2.0::DOUBLE * sum(tp) * sum(n - tp), 0), 6) "
                       "AS roc_auc FROM c_all", "c_all"))
def roc_auc(spark, sf):
    s = TestViews(spark, sf).scores.withColumn("p", mathfns.sigmoid("logit"))
    return eval_ops.roc_auc(s, "p", "y").select(r6("roc_auc").alias("roc_auc"))


# =============================================================================
# 2.5 windows
# =============================================================================
@register("trailing_year_count", B("SELECT subject_id, icustay_id, outtime, num_recent_admissions FROM recent", "recent"))
def trailing_year_count(spark, sf):
    df = filter_not_died_in_stay(spark, sf)
    df = windows.trailing_count(df, "subject_id", "outtime", rules.RECENT_MIN_DAYS, rules.RECENT_MAX_DAYS,
                                out="num_recent_admissions")
    return df.select("subject_id", "icustay_id", "outtime", "num_recent_admissions")


@register("next_event_gap_label", B("SELECT subject_id, icustay_id, days_to_next, positive FROM labelled", "labelled"))
def next_event_gap_label(spark, sf):
    return cohort_ops.next_gap_label(_adults(spark, sf)).select("subject_id", "icustay_id", "days_to_next", "positive")


@register("first_per_group", B("SELECT * FROM fserv", "fserv"))
def first_per_group(spark, sf):
    s = cohort_ops.first_service(TestViews(spark, sf).services)
    return s.withColumn("surgery", cohort_ops.surgery_flag()).select(
        "subject_id", "hadm_id", "transfertime", "curr_service", "surgery")


def _wh(spark, sf) -> DataFrame:
    c = Flow(spark, sf).chart_clean.filter(F.col("ce_type").isin("WEIGHT", "HEIGHT"))
    return materialize(agg_ops.pivot_mean(c, ["subject_id", "icustay_id", "charttime"], "ce_type", "valuenum",
                                          ["HEIGHT", "WEIGHT"]), "weights")


@register("forward_fill", B("""
SELECT subject_id, icustay_id, charttime, round(last_value(h IGNORE NULLS) OVER (PARTITION BY subject_id
       ORDER BY icustay_id, charttime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS height FROM wh""", "wh"))
def forward_fill(spark, sf):
    d = windows.fill_forward(_wh(spark, sf), "subject_id", ["icustay_id", "charttime"], "HEIGHT", "height")
    return d.select("subject_id", "icustay_id", "charttime", r6("height").alias("height"))


@register("backward_fill", B("""
SELECT subject_id, icustay_id, charttime, round(coalesce(
  last_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY icustay_id, charttime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY icustay_id, charttime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS height
FROM wh""", "wh"))
def backward_fill(spark, sf):
    d = windows.fill_forward(_wh(spark, sf), "subject_id", ["icustay_id", "charttime"], "HEIGHT", "_ff")
    d = windows.fill_backward(d, "subject_id", ["icustay_id", "charttime"], "HEIGHT", "_bf")
    return d.select("subject_id", "icustay_id", "charttime", r6(F.coalesce("_ff", "_bf")).alias("height"))


@register("drop_consecutive_repeats", B("SELECT * FROM runs", "runs"))
def drop_consecutive_repeats(spark, sf):
    return Flow(spark, sf).runs


@register("latest_per_stay_type", B("SELECT * FROM last_only", "last_only"))
def latest_per_stay_type(spark, sf):
    return Flow(spark, sf).last_only


@register("sequence_position", B("SELECT * FROM dp_pos", "dp_pos"))
def sequence_position(spark, sf):
    codes, keys = Flow(spark, sf).codes_by_subject
    return seq_ops.sequence_positions(codes, keys, "days_to_out", "icd9_code", like=codes).select(*code_ops.KNOWN, "pos")


def _cp_enc(spark, sf) -> DataFrame:
    cp, parts = Flow(spark, sf).cp_by_stay
    enc, _ = seq_ops.encoded_sequence(cp, "icustay_id", "valuecat", "hours_to_out", rules.CP_QUANTILE, "cp", parts=parts)
    return enc.select("icustay_id", "pos", "idx", F.coalesce("hours_to_out", F.lit(0.0)).alias("t"))


@register("time_delta", B("""
SELECT icustay_id, pos, round(greatest(round_even(t, 3) - coalesce(lag(round_even(t, 3)) OVER (PARTITION BY icustay_id ORDER BY pos), 0.0), 0.0), 6) AS delta
FROM cp_enc""", "cp_enc"))
def time_delta(spark, sf):
    e = _cp_enc(spark, sf).withColumn("t", mathfns.round_times("t", 3))
    d = windows.time_delta(e, "icustay_id", "pos", "t", "delta")
    return d.select("icustay_id", "pos", r6("delta").alias("delta"))


@register("time_delta_array", B("SELECT icustay_id, " + O.fmt_list_sql(
    "list_transform(cp_times, lambda x, i: greatest(x - CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE cp_times[i - 1] END, 0.0::DOUBLE))", True)
    + " AS deltas FROM cp_arrays", "cp_arrays"))
def time_delta_array(spark, sf):
    """Time deltas inside the padded arrays (rendered as text); the fall from the last time to the padding is 0."""
    return Flow(spark, sf).cp_arrays[0].select("icustay_id", fmt_doubles(arrfn.time_delta_array("cp_times")).alias("deltas"))


@register("reverse_sequence", B(f"""
SELECT icustay_id, {O.fmt_list_sql('list_reverse(cp)')} AS cp_reversed,
       {O.fmt_list_sql('list_reverse(cp_times)', True)} AS cp_times_reversed FROM cp_arrays""", "cp_arrays"))
def reverse_sequence(spark, sf):
    a = Flow(spark, sf).cp_arrays[0]
    r = a.select("icustay_id", arrfn.reverse_sequence("cp").alias("cp_reversed"),
                 arrfn.reverse_sequence("cp_times").alias("cp_times_reversed"))
    return r.select("icustay_id", fmt_ints("cp_reversed").alias("cp_reversed"),
                    fmt_doubles("cp_times_reversed").alias("cp_times_reversed"))


@register("exp_decay_recency", B("""
SELECT icustay_id, icd9_code, round(sum(exp(-greatest(s * 1.0, 0.0))), 6) AS recency FROM (
  SELECT *, sum(delta) OVER (PARTITION BY icustay_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
  FROM (SELECT *, greatest(t - coalesce(lag(t) OVER (PARTITION BY icustay_id ORDER BY pos), 0.0), 0.0) AS delta
        FROM (SELECT icustay_id, icd9_code, pos, coalesce(days_to_out, 0.0::DOUBLE) AS t FROM dp_pos)))
GROUP BY icustay_id, icd9_code""", "dp_pos"))
def exp_decay_recency(spark, sf):
    codes, keys = Flow(spark, sf).codes_by_subject
    placed = Placed(codes if len(keys) > 1 else codes.repartition(*keys), keys)
    d = seq_ops.sequence_positions(placed.df, keys, "days_to_out", "icd9_code", like=placed)
    d = d.withColumn("t", F.coalesce("days_to_out", F.lit(0.0)))
    d = windows.time_delta(d, keys, "pos", "t", "delta", like=placed)
    r = windows.exp_decay_recency(d, keys, "pos", "delta", "icd9_code", None, 1.0, "recency", like=placed)
    r = r.select("icustay_id", "icd9_code", "recency")
    return r.withColumn("recency", r6("recency"))


# =============================================================================
# 2.6 sorts and top-k
# =============================================================================
@register("multi_key_mixed_sort", B("SELECT * FROM cbase ORDER BY subject_id ASC NULLS LAST, outtime DESC NULLS LAST",
                                    "cbase"))
def multi_key_mixed_sort(spark, sf):
    return windows.sort_mixed(Flow(spark, sf).cohort_base, [("subject_id", True), ("outtime", False)])


@register("top1_per_group", B("""
SELECT subject_id, icustay_id, intime FROM (SELECT subject_id, icustay_id, intime,
  row_number() OVER (PARTITION BY subject_id ORDER BY intime ASC NULLS LAST, icustay_id) AS rn FROM cbase) WHERE rn = 1""",
                              "cbase"))
def top1_per_group(spark, sf):
    c = Flow(spark, sf).cohort_base.select("subject_id", "icustay_id", "intime")
    return windows.first_per_group(c, ["subject_id"], "intime", "icustay_id")


@register("first_n_per_group", B("SELECT icustay_id, icd9_code, days_to_out FROM dp_pos WHERE pos < 10", "dp_pos"))
def first_n_per_group(spark, sf):
    codes, keys = Flow(spark, sf).codes_by_subject
    return windows.first_n(codes, keys, "days_to_out", "icd9_code", 10).select(*code_ops.KNOWN)


# =============================================================================
# 2.7 set operations
# =============================================================================
@register("union_tagged_codes", B("SELECT * FROM codes_raw", "codes_raw"))
def union_tagged_codes(spark, sf):
    v = TestViews(spark, sf)
    return code_ops.union_tagged({rules.DIAG_PREFIX: v.diagnoses, rules.PROC_PREFIX: v.procedures})


@register("union_derived_events", B("SELECT icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type "
                                    "FROM charts_derived", "charts_derived"))
def union_derived_events(spark, sf):
    return Flow(spark, sf).charts_derived.withColumn("valuenum", r6("valuenum"))


@register("union_heterogeneous_events", B("SELECT * FROM cp_events", "cp_events"))
def union_heterogeneous_events(spark, sf):
    f = Flow(spark, sf)
    return f.runs.select("icustay_id", "valuecat", "charttime").unionByName(seq_ops.prescriptions(f.v.meds))


@register("union_model_results", B("SELECT model, phase, epoch, " + ", ".join(f"round({m}, 6) AS {m}" for m in PHASE_METRICS)
                                   + " FROM phase_rows", "phase_rows"))
def union_model_results(spark, sf):
    return _phase_rows(spark, sf).select("model", "phase", "epoch", *[r6(m).alias(m) for m in PHASE_METRICS])


# =============================================================================
# 2.8 scalar functions
# =============================================================================
@register("normalise_code", B(f"SELECT icd9_code, {O._q(rules.DIAG_PREFIX)} || lower(trim(icd9_code)) AS code "
                              "FROM v_diagnoses", "v_diagnoses"))
def normalise_code(spark, sf):
    d = TestViews(spark, sf).diagnoses
    return d.select("icd9_code", strings.normalise_code("icd9_code", rules.DIAG_PREFIX).alias("code"))


@register("normalise_drug", B(f"SELECT drug, {O._q(rules.DRUG_PREFIX)} || regexp_replace(lower(drug), '\\s+', '', 'g') "
                              "AS valuecat FROM v_meds", "v_meds"))
def normalise_drug(spark, sf):
    m = TestViews(spark, sf).meds
    return m.select("drug", strings.normalise_drug("drug", rules.DRUG_PREFIX).alias("valuecat"))


@register("canonical_category", B(f"""
SELECT hadm_id, {O._first_match('ethnicity', rules.ETHNICITY_RULES)} AS ethnicity,
       {O._first_match("coalesce(marital_status, 'UNKNOWN')", rules.MARITAL_RULES)} AS marital_status
FROM v_admissions""", "v_admissions"))
def canonical_category(spark, sf):
    a = TestViews(spark, sf).admissions
    return a.select("hadm_id", strings.canonical_category("ethnicity", rules.ETHNICITY_RULES).alias("ethnicity"),
                    strings.canonical_category("marital_status", rules.MARITAL_RULES, rules.MARITAL_NULL_AS)
                    .alias("marital_status"))


@register("title_case", B(f"SELECT hadm_id, {O.title_sql('admission_location')} AS admission_location, "
                          f"{O.title_sql('ethnicity')} AS ethnicity FROM v_admissions", "v_admissions"))
def title_case(spark, sf):
    a = TestViews(spark, sf).admissions
    return a.select("hadm_id", strings.title_case("admission_location").alias("admission_location"),
                    strings.title_case("ethnicity").alias("ethnicity"))


@register("contains_filter", B("SELECT * FROM v_services WHERE contains(curr_service, 'SURG') OR curr_service = 'ORTHO'",
                               "v_services"))
def contains_filter(spark, sf):
    s = TestViews(spark, sf).services
    return s.filter(strings.contains_any("curr_service", ["SURG"]) | (F.col("curr_service") == "ORTHO"))


@register("lower_case", B("SELECT itemid, lower(label) AS label FROM v_items", "v_items"))
def lower_case(spark, sf):
    return TestViews(spark, sf).items.select("itemid", strings.lower("label").alias("label"))


@register("shift_obscured_birthdate", B(f"""
SELECT subject_id, CASE WHEN year(dob) < {O.CUT} THEN dob + to_years({rules.OBSCURED_DOB_YEARS}) - to_days({rules.OBSCURED_DOB_DAYS})
                        ELSE dob END AS dob FROM v_patients""", "v_patients"))
def shift_obscured_birthdate(spark, sf):
    p = TestViews(spark, sf).patients
    return p.select("subject_id", timefns.shift_obscured_birthdate("dob", OBSCURE_CUTOFF_YEAR, rules.OBSCURED_DOB_YEARS,
                                                                   rules.OBSCURED_DOB_DAYS).alias("dob"))


@register("whole_days_between", B(f"""
SELECT a.hadm_id, CAST(floor(date_diff('microsecond', a.admittime, s.intime) / {O.D}) AS BIGINT) AS days_in,
       CAST(floor(date_diff('microsecond', s.outtime, a.admittime) / {O.D}) AS BIGINT) AS days_back
FROM v_admissions a JOIN v_stays s ON a.hadm_id = s.hadm_id""", "v_admissions", "v_stays"))
def whole_days_between(spark, sf):
    v = TestViews(spark, sf)
    j = v.admissions.select("hadm_id", "admittime").join(v.stays.select("hadm_id", "intime", "outtime"), "hadm_id")
    return j.select("hadm_id", timefns.whole_days_between("admittime", "intime").alias("days_in"),
                    timefns.whole_days_between("outtime", "admittime").alias("days_back"))


@register("age_years", B("SELECT subject_id, icustay_id, age FROM aged", "aged"))
def age_years(spark, sf):
    return cohort_ops.with_age(filter_not_died_in_stay(spark, sf)).select("subject_id", "icustay_id", "age")


@register("fractional_days_clamped", B(f"""
SELECT a.hadm_id, CASE WHEN d < 0 THEN 0.0::DOUBLE ELSE d END AS pre_icu_los FROM (
  SELECT a.hadm_id, date_diff('microsecond', a.admittime, s.intime) / {O.D}::DOUBLE AS d
  FROM v_admissions a JOIN v_stays s ON a.hadm_id = s.hadm_id) a""", "v_admissions", "v_stays"))
def fractional_days_clamped(spark, sf):
    v = TestViews(spark, sf)
    j = v.admissions.select("hadm_id", "admittime").join(v.stays.select("hadm_id", "intime"), "hadm_id")
    return j.select("hadm_id", timefns.fractional_days("admittime", "intime", clamp=True).alias("pre_icu_los"))


@register("fractional_hours_clamped", B(f"""
SELECT m.icustay_id, m.valuecat, CASE WHEN h < 0 THEN 0.0::DOUBLE ELSE h END AS hours_to_out FROM (
  SELECT m.icustay_id, m.valuecat, date_diff('microsecond', m.charttime, s.outtime) / {O.H}::DOUBLE AS h
  FROM meds_clean m JOIN v_stays s ON m.icustay_id = s.icustay_id) m""", "meds_clean", "v_stays"))
def fractional_hours_clamped(spark, sf):
    v = TestViews(spark, sf)
    j = seq_ops.prescriptions(v.meds).join(v.stays.select("icustay_id", "outtime"), "icustay_id")
    return j.select("icustay_id", "valuecat", timefns.fractional_hours("charttime", "outtime").alias("hours_to_out"))


@register("truncate_to_day_midday", B("SELECT charttime, CAST(charttime AS DATE) AS chartday, "
                                      "CAST(CAST(charttime AS DATE) AS TIMESTAMP) + to_hours(12) AS midday FROM v_outputs",
                                      "v_outputs"))
def truncate_to_day_midday(spark, sf):
    o = TestViews(spark, sf).outputs
    return o.select("charttime", timefns.day_of("charttime").alias("chartday"), timefns.midday("charttime").alias("midday"))


@register("convert_units", B(f"SELECT itemid, valuenum, {O.CONV} AS converted FROM chart_obs", "chart_obs"))
def convert_units(spark, sf):
    c = event_ops.observed(TestViews(spark, sf).chart, rules.RELEVANT_IDS)
    return event_ops.converted(c).select("itemid", "valuenum", "converted")


@register("label_item_type", B(f"SELECT itemid, {O.TYPE_CASE} AS ce_type FROM v_chart", "v_chart"))
def label_item_type(spark, sf):
    return event_ops.label_items(TestViews(spark, sf).chart.select("itemid")).select("itemid", "ce_type")


@register("bin_right_closed", B("SELECT icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type, valuecat "
                                "FROM binned", "binned"))
def bin_right_closed(spark, sf):
    return Flow(spark, sf).binned.withColumn("valuenum", r6("valuenum"))


@register("bin_with_bmi", B(f"""
SELECT icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type, {O.bin_case(include_bmi=True)} AS valuecat FROM (
  SELECT icustay_id, charttime, valuenum, ce_type FROM charts_derived
  UNION ALL SELECT icustay_id, charttime, valuenum, ce_type FROM out_reduced)
WHERE ce_type = 'BMI' OR ce_type IN {O.BINNED_IN}""", "charts_derived", "out_reduced"))
def bin_with_bmi(spark, sf):
    return Flow(spark, sf, include_bmi=True).binned.withColumn("valuenum", r6("valuenum"))


@register("derive_bmi", B("SELECT subject_id, icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type FROM bmi", "bmi"))
def derive_bmi(spark, sf):
    return event_ops.derive_bmi(Flow(spark, sf).chart_stage).withColumn("valuenum", r6("valuenum"))


@register("derive_total_if_missing", B("SELECT subject_id, icustay_id, charttime, round(valuenum, 6) AS valuenum, ce_type "
                                       "FROM gcs", "gcs"))
def derive_total_if_missing(spark, sf):
    return event_ops.derive_total_if_missing(Flow(spark, sf).chart_clean).withColumn("valuenum", r6("valuenum"))


@register("sigmoid_score", B("SELECT doc_id, round(p, 6) AS p FROM scored", "scored"))
def sigmoid_score(spark, sf):
    return TestViews(spark, sf).scores.select("doc_id", r6(mathfns.sigmoid("logit")).alias("p"))


@register("round_times", B("SELECT icustay_id, valuecat, round_even(hours_to_out, 3) AS hours_to_out FROM cp", "cp"))
def round_times(spark, sf):
    c = Flow(spark, sf).cp
    return c.select("icustay_id", "valuecat", mathfns.round_times("hours_to_out", 3).alias("hours_to_out"))


@register("cast_bool_to_int", B("""
SELECT b.icustay_id, CAST(coalesce(f.surgery, false) AS INTEGER) AS surgery
FROM cbase b LEFT JOIN fserv f ON b.subject_id = f.subject_id AND b.hadm_id = f.hadm_id""", "cbase", "fserv"))
def cast_bool_to_int(spark, sf):
    j = left_join_first_service(spark, sf)
    return j.select("icustay_id", mathfns.flag_to_int("surgery").alias("surgery"))


@register("fill_null_default", B("SELECT hadm_id, coalesce(marital_status, 'UNKNOWN') AS marital_status FROM v_admissions",
                                 "v_admissions"))
def fill_null_default(spark, sf):
    a = TestViews(spark, sf).admissions
    return a.select("hadm_id", mathfns.fill_null("marital_status", rules.MARITAL_NULL_AS).alias("marital_status"))


@register("dictionary_encode", B("SELECT * FROM dict_dp", "dict_dp"))
def dictionary_encode(spark, sf):
    return Flow(spark, sf).dp_arrays[1]


@register("pad_sequence_arrays", B(f"SELECT icustay_id, {O.fmt_list_sql('dp')} AS dp, "
                                   f"{O.fmt_list_sql('dp_times', True)} AS dp_times FROM dp_arrays", "dp_arrays"))
def pad_sequence_arrays(spark, sf):
    a = Flow(spark, sf).dp_arrays[0]
    return a.select("icustay_id", fmt_ints("dp").alias("dp"), fmt_doubles("dp_times").alias("dp_times"))


@register("unique_time_grid", B("""
SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS t_idx
FROM (SELECT DISTINCT round_even(hours_to_out, 3) AS t FROM cp WHERE hours_to_out IS NOT NULL)""", "cp"))
def unique_time_grid(spark, sf):
    c = Flow(spark, sf).cp.select(mathfns.round_times("hours_to_out", 3).alias("t"))
    return seq_ops.unique_time_grid(c, "t", "t_idx")


@register("masked_softmax_pool", B("""
SELECT grp, CAST(d - 1 AS INTEGER) AS dim, round(sum(w * x), 6) AS pooled FROM (
  SELECT grp, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM (
    SELECT grp, vec, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY grp) AS w FROM (
      SELECT grp, vec, s, max(s) OVER (PARTITION BY grp) AS mx FROM (
        SELECT grp, vec, CASE WHEN mask THEN score ELSE -1e9 END AS s FROM v_emb))))
GROUP BY grp, d""", "v_emb"))
def masked_softmax_pool(spark, sf):
    from ..operators.pooling import masked_softmax_pool as pool
    e = TestViews(spark, sf).embeddings
    pooled, _ = pool(e, "grp", "score", "vec", "mask")
    return pooled.withColumn("pooled", r6("pooled"))


# =============================================================================
# 2.9 splits, model data and scoring
# =============================================================================
@register("grouped_split", B("SELECT * FROM split", "split"))
def grouped_split(spark, sf):
    return Flow(spark, sf).split


@register("split_subset", B("SELECT c.icustay_id, c.subject_id FROM cohort c JOIN split s ON c.subject_id = s.subject_id "
                            "WHERE s.split = 'train'", "cohort", "split"))
def split_subset(spark, sf):
    return split_ops.subset(membership_flags(spark, sf), "train").select("icustay_id", "subject_id")


@register("test_subjects", B("SELECT c.icustay_id, c.subject_id FROM cohort c JOIN split s ON c.subject_id = s.subject_id "
                             "WHERE s.split = 'test'", "cohort", "split"))
def test_subjects(spark, sf):
    return split_ops.test_subjects(membership_flags(spark, sf))


@register("build_feature_table", B(FEATURE_TEXT_SQL, "cohort", "dp_arrays", "cp_arrays", "split"))
def build_feature_table(spark, sf):
    """The feature table (arrays rendered as text for the SQL comparison)."""
    return _feature_text(Flow(spark, sf).features)


SPARSE_TEXT_SQL = FEATURE_TEXT_SQL.replace("SELECT c.icustay_id,", "SELECT h.hot, round(c.los, 6) AS los, c.icustay_id,", 1).replace(
    "LEFT JOIN split", "JOIN hot h ON c.icustay_id = h.icustay_id LEFT JOIN split", 1)


@register("sparse_feature_table", B(SPARSE_TEXT_SQL, "cohort", "dp_arrays", "cp_arrays", "split", "hot"))
def sparse_feature_table(spark, sf):
    """The feature table with index arrays in the place of one-hot columns (arrays rendered as text)."""
    f = Flow(spark, sf)
    feats, _ = f.sparse_features
    if split_ops.is_unique(f.cohort, "icustay_id"):  # then a join of the table to itself by stay gives its own rows
        feats = feats.filter(F.col("icustay_id").isNotNull()).withColumn("hot", fmt_ints("hot")).withColumn("los", r6("los"))
        return _feature_text(feats, "hot", "los")
    return _feature_text(feats).join(feats.select("icustay_id", fmt_ints("hot").alias("hot"), r6("los").alias("los")), "icustay_id")


def feature_table(spark, sf):
    """The feature table as the library produces it (array columns)."""
    return Flow(spark, sf).features


LAST_LABELS = [x for t in rules.BINNED_TYPES for x in rules.BIN_LABELS[t]]


@register("last_category_features", B("SELECT c.icustay_id, " + ", ".join(
    f"max(CASE WHEN l.valuecat = '{x}' THEN 1 ELSE 0 END) AS {x}" for x in LAST_LABELS)
    + " FROM cohort c LEFT JOIN last_only l ON c.icustay_id = l.icustay_id GROUP BY c.icustay_id", "cohort", "last_only"))
def last_category_features(spark, sf):
    """Most recent category per type as 0/1 columns, the events' part of the baseline's input."""
    return Flow(spark, sf).last_features


def _newton_ctes(steps: int = logistic.STEPS, ridge: float = logistic.RIDGE) -> str:
    """The regression in SQL over a table of non-zero features: every step adds up the system and eliminates it row by
    row; returns the name of the last table of coefficients."""
    O.cte("lr_x", ["one_hot_long", "cohort", "last_only", "split"], f"""
SELECT x.icustay_id, x.feature, CAST(x.value AS DOUBLE) AS v, CAST(c.positive AS DOUBLE) AS y, s.split FROM (
  {STATIC_SQL}
  UNION ALL SELECT DISTINCT icustay_id, 'last ' || valuecat, 1.0::DOUBLE FROM last_only WHERE valuecat IN ({', '.join(map(O._q, LAST_LABELS))})
  UNION ALL SELECT icustay_id, '', 1.0::DOUBLE FROM cohort) x
JOIN cohort c ON x.icustay_id = c.icustay_id JOIN split s ON c.subject_id = s.subject_id WHERE x.value <> 0""")
    O.cte("lr_j", ["lr_x"], "SELECT feature, row_number() OVER (ORDER BY feature) AS j FROM (SELECT DISTINCT feature FROM lr_x WHERE split = 'train')")
    O.cte("lr_w", ["cohort", "split"], """
SELECT sum(CASE WHEN c.positive THEN 0 ELSE 1 END) / CAST(sum(CASE WHEN c.positive THEN 1 ELSE 0 END) AS DOUBLE) AS w
FROM cohort c JOIN split s ON c.subject_id = s.subject_id WHERE s.split = 'train'""")
    O.cte("lr_t", ["lr_x", "lr_j", "lr_w"], """
SELECT icustay_id, j, v, y, CASE WHEN y = 1 THEN w ELSE 1 END AS cw FROM lr_x JOIN lr_j ON lr_x.feature = lr_j.feature, lr_w
WHERE split = 'train'""")
    O.cte("lr_b0", ["lr_j"], "SELECT list(0.0::DOUBLE) AS b FROM lr_j")
    for k in range(steps):
        O.cte(f"lr_e{k}", ["lr_t", f"lr_b{k}"], f"""
SELECT icustay_id, y, cw, 1 / (1 + exp(-sum(v * b[j]))) AS p FROM lr_t, lr_b{k} GROUP BY icustay_id, y, cw""")
        O.cte(f"lr_h{k}", ["lr_t", f"lr_e{k}", f"lr_b{k}", "lr_j"], f"""
SELECT a.j AS i, c.j AS j, sum(a.cw * e.p * (1 - e.p) * a.v * c.v) AS h
FROM lr_t a JOIN lr_t c ON a.icustay_id = c.icustay_id JOIN lr_e{k} e ON a.icustay_id = e.icustay_id GROUP BY a.j, c.j
UNION ALL SELECT j, j, {ridge}::DOUBLE FROM lr_j WHERE feature <> ''
UNION ALL SELECT t.j, (SELECT count(*) + 1 FROM lr_j), sum(t.cw * (t.y - e.p) * t.v)
FROM lr_t t JOIN lr_e{k} e ON t.icustay_id = e.icustay_id GROUP BY t.j
UNION ALL SELECT j, (SELECT count(*) + 1 FROM lr_j), -{ridge}::DOUBLE * b[j] FROM lr_j, lr_b{k} WHERE feature <> ''""")
        O.cte(f"lr_m{k}", [f"lr_h{k}", "lr_j"], f"""
SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list(h ORDER BY j) AS r FROM (
    SELECT g.i, g.j, coalesce(sum(h.h), 0.0::DOUBLE) AS h
    FROM (SELECT x.j AS i, y.j FROM lr_j x, (SELECT j FROM lr_j UNION ALL SELECT count(*) + 1 FROM lr_j) y) g
    LEFT JOIN lr_h{k} h ON g.i = h.i AND g.j = h.j GROUP BY g.i, g.j) GROUP BY i)""")
        O.cte(f"lr_s{k}", [f"lr_m{k}"], f"""
SELECT 0 AS k, m FROM lr_m{k}
UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN r
  ELSE list_transform(r, lambda x, q: x - r[k + 1] * (m[k + 1][q] / m[k + 1][k + 1])) END) FROM lr_s{k} WHERE k < len(m)""")
        O.RECURSIVE.add(f"lr_s{k}")
        O.cte(f"lr_b{k + 1}", [f"lr_b{k}", f"lr_s{k}"], f"""
SELECT list_transform(b, lambda x, i: x + m[i][len(m) + 1] / m[i][i]) AS b FROM lr_b{k}, (SELECT m FROM lr_s{k} WHERE k = len(m))""")
    O.cte("lr_scored", ["lr_x", "lr_j", f"lr_b{steps}"], f"""
SELECT icustay_id, y, round(sum(coalesce(v * b[j], 0.0::DOUBLE)), 6) AS logit
FROM lr_x LEFT JOIN lr_j ON lr_x.feature = lr_j.feature, lr_b{steps} WHERE split = 'test' GROUP BY icustay_id, y""")
    return "lr_scored"


_newton_ctes()


def _baseline(spark, sf):
    """(features with the most recent categories, logit of every test stay rounded to 6 places)."""
    f = Flow(spark, sf)
    cohort = f.cohort
    oh = split_ops.one_hot(cohort, f.categories, rules.ONE_HOT_BASELINES)
    static = split_ops.select_regex(oh.drop("subject_id", "hadm_id", "icustay_id", "intime", "outtime", "gender", "positive"),
                                    rules.STATIC_PATTERN)
    cols = static + LAST_LABELS
    feats = (split_ops.attach_split(oh.withColumn("label", F.col("positive").cast("double")), f.split)
             .join(f.last_features, "icustay_id").select("icustay_id", "label", "split", *[f"`{c}`" for c in cols]))
    feats = materialize(feats, "baseline")
    train = split_ops.subset(feats, "train")
    beta = logistic.fit(train, cols, "label")
    scored = logistic.score(split_ops.subset(feats, "test"), cols, beta)
    return train, scored.select("icustay_id", F.col("label").alias("y"), r6("logit").alias("logit"))


@register("static_logistic_baseline", B("SELECT icustay_id, logit FROM lr_scored", "lr_scored"))
def static_logistic_baseline(spark, sf):
    """Logit of every test stay by the weighted logistic regression on the static features and the most recent
    categories of the training part."""
    return _baseline(spark, sf)[1].select("icustay_id", "logit")


@register("score_and_evaluate", B("""
SELECT a.accuracy, a.f1, r.average_precision, r.roc_auc, a.loss FROM (
  SELECT round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
         round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(loss, 6) AS loss
  FROM (SELECT count(*) AS n, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p <= 0.5 AND y = 0) AS tn,
               count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn,
               sum((1 - y) * logit + (1 + (w - 1) * y) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0))) AS loss
        FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM lr_scored, lr_w))) a, (
  SELECT round(sum((tp - ptp) / n1 * (tp / (tp + fp))), 6) AS average_precision,
         round(sum((fp - pfp) * (tp + ptp) / 2) / (n1 * n0), 6) AS roc_auc
  FROM (SELECT *, lag(tp, 1, 0) OVER (ORDER BY logit DESC) AS ptp, lag(fp, 1, 0) OVER (ORDER BY logit DESC) AS pfp,
               max(tp) OVER () AS n1, max(fp) OVER () AS n0
        FROM (SELECT DISTINCT logit, CAST(sum(y) OVER (ORDER BY logit DESC) AS DOUBLE) AS tp,
                     CAST(sum(1 - y) OVER (ORDER BY logit DESC) AS DOUBLE) AS fp FROM lr_scored))
  GROUP BY n1, n0) r""", "lr_scored", "lr_w"))
def score_and_evaluate(spark, sf):
    """All metrics of the baseline on the test part (one row), with the training part's class weight in the loss."""
    train, scored = _baseline(spark, sf)
    found = eval_ops.evaluate(scored, "logit", "y", weight=eval_ops.pos_weight(train, "label"))
    return found.select(*[r6(c).alias(c) for c in ("accuracy", "f1", "average_precision", "roc_auc", "loss")])


# =============================================================================
# 2.10 streaming
# =============================================================================
@register("incremental_event_clean", B("SELECT * FROM chart_clean", "chart_clean"))
def incremental_event_clean(spark, sf):
    """The same cleaner as a file stream, one file per micro-batch (result equals batch)."""
    return _chart_ingest(spark, sf, 1)


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
