"""One-hot names and sizes, sorted outputs, model metrics, fixed values and the entry file without its llm part."""

import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from staytrail import rules
from staytrail.operators import evaluate, split, windows
from staytrail.plans import catalog
from staytrail.plans.flow import Flow

SF = "/root/testdata/sf0.001"


def test_one_hot_keeps_values_as_they_are(spark):
    df = spark.createDataFrame([(1, "A/B"), (2, "A B"), (3, None)], "id int, insurance string")
    out = split.one_hot(df, split.category_values(df, ["insurance"]))
    assert out.columns == ["id", "INSURANCE_A B", "INSURANCE_A/B"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]


def test_one_hot_clash_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A B")], "id int, insurance string")
    with pytest.raises(ValueError, match="would exist twice"):
        split.one_hot(df, split.category_values(df, ["insurance"]))


def test_one_hot_indices_of_many_categories(spark):
    rows = [(i, f"v{i % 1500:04d}" if i % 7 else None, "x" if i % 2 else "base") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    with pytest.raises(ValueError, match="more than 1000"):
        split.category_values(df, ["a"])
    enc, names = split.one_hot_indices(df, ["a", "b"], {"b": "base"})
    name = {r.idx: r.feature for r in names.collect()}
    assert sorted(name) == list(range(len(name))) and list(map(name.get, sorted(name))) == sorted(name.values())
    for r in enc.collect():
        want = ([f"A_{r.a}"] if r.a else []) + (["B_x"] if r.b == "x" else [])
        assert [name[i] for i in r.hot] == sorted(want)


def test_sorted_outputs_are_in_order(spark):
    rows = [tuple(r) for r in catalog.multi_key_mixed_sort(spark, SF).select("subject_id", "outtime").collect()]
    assert len(rows) > 100 and rows == sorted(rows, key=lambda r: (r[0], -r[1].timestamp()))
    df = spark.createDataFrame([(1, None), (None, 2), (1, 5), (0, 3), (1, 4)], "a int, b int")
    assert [tuple(r) for r in windows.sort_mixed(df, [("a", True), ("b", False)]).collect()] == [(0, 3), (1, 5), (1, 4), (1, None), (None, 2)]
    t = spark.createDataFrame([(m, p, 1.0) for m in "ba" for p in ("Testing", "Validation")], "model string, phase string, f1 double")
    got = evaluate.model_phase_table(t, ["f1"]).collect()
    assert [(r.model, r.phase) for r in got] == [("a", "Validation"), ("a", "Testing"), ("b", "Validation"), ("b", "Testing")]


def test_model_metrics_equal_sql_over_the_exported_scores(spark):
    train, scored = catalog._baseline(spark, SF)
    weight = evaluate.pos_weight(train, "label").first()[0]
    got = evaluate.evaluate(scored, "logit", "y", weight=weight).first()
    rows = scored.toPandas()  # noqa: F841  (read by DuckDB)
    ap, auc, acc, f1, loss = duckdb.sql(f"""
        WITH s AS (SELECT y::INTEGER AS y, logit, 1 / (1 + exp(-logit)) AS p, (1 / (1 + exp(-logit)) > 0.5)::INTEGER AS c FROM rows),
             g AS (SELECT p, sum(y) AS tp, count(*) AS n FROM s GROUP BY p),
             r AS (SELECT *, sum(tp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g)
        SELECT (SELECT sum(tp * ctp / cn) / sum(tp)::DOUBLE FROM r),
               (SELECT sum((n - tp) * (2 * ctp - tp)) / (2.0::DOUBLE * sum(tp) * sum(n - tp)) FROM r),
               avg((c = y)::INTEGER), 2 * sum(c * y) / (sum(c) + sum(y))::DOUBLE,
               sum({weight} * y * ln(1 + exp(-logit)) + (1 - y) * (logit + ln(1 + exp(-logit)))) FROM s""").fetchall()[0]
    assert got.average_precision == pytest.approx(ap, abs=1e-9) and got.roc_auc == pytest.approx(auc, abs=1e-9)
    assert got.accuracy == pytest.approx(acc) and got.f1 == pytest.approx(f1) and got.loss == pytest.approx(loss, rel=1e-6)
    n = duckdb.sql("SELECT count(*), count(DISTINCT icustay_id) FROM rows").fetchall()[0]
    assert n[0] == n[1] == catalog.test_subjects(spark, SF).count() > 0


def test_attrition_expectations(spark):
    f = Flow(spark, SF)
    funnel = {r.stage: (r.subjects, r.stays) for r in catalog.attrition_counts(spark, SF).collect()}
    f.check_attrition(funnel)
    with pytest.raises(ValueError, match="adult"):
        f.check_attrition({"adult": (1, 1)})


def test_fixed_values():
    """Rule data as read from the source of the rules, counted and summed by hand there."""
    assert [len(v) for v in rules.CHART_TYPES.values()] and sum(len(v) for v in rules.CHART_TYPES.values()) == 116
    assert len(rules.RELEVANT_IDS) == 90 and len(rules.URINE_OUTPUT) == 133 and len(set(rules.URINE_OUTPUT)) == 122
    assert len(set(i for v in rules.CHART_TYPES.values() for i in v)) == 116
    assert rules.BIN_EDGES["GCS_TOTAL"] == [-1, 7, 13, 14, 15] and rules.BIN_EDGES["HEART_RATE"][1:5] == [32.99, 88.5, 106.5, 125.5]
    assert all(len(e) == len(rules.BIN_LABELS[t]) + 1 for t, e in rules.BIN_EDGES.items())
    assert rules.SPLIT_CUTS == (0.7, 0.8) and rules.RARE_MIN_COUNT == 100 and rules.OUTPUT_CAP == 10000.0
    assert (rules.OBSCURED_DOB_YEARS, rules.OBSCURED_DOB_DAYS) == (209, 146)


def test_entry_without_the_llm_part():
    """What the entry registers is the same but for the training-data queries when those modules can't be imported."""
    code = ("import sys\n"
            "class Block:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'staytrail.llm'): raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, Block())\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, found = out.stdout.split()
    assert int(n) >= 100 and int(sql) >= 98 and found == "False"


def test_sparse_features_with_thousands_of_categories(spark):
    n = 5200
    rows = [(i // 2, i, "F", i % 3 == 0, 1.0, 0, 30.0, 0.1, 0, f"place {i % 5000}", "Medicare" if i % 2 else None,
             "Single", "White") for i in range(n)]
    cohort = spark.createDataFrame(rows, "subject_id long, icustay_id long, gender string, positive boolean, los double, "
                                         "num_recent_admissions long, age double, pre_icu_los double, elective_surgery int, "
                                         "admission_location string, insurance string, marital_status string, ethnicity string")
    arrays = cohort.select("icustay_id")
    with pytest.raises(ValueError):
        split.category_values(cohort, ["admission_location"])
    feats, names = split.sparse_features(cohort, arrays, arrays)
    name = {r.idx: r.feature for r in names.collect()}
    assert len(name) > 5000 and sorted(name) == list(range(len(name))) and [name[i] for i in range(len(name))] == sorted(name.values())
    got = {r.icustay_id: {name[i] for i in r.hot} for r in feats.select("icustay_id", "hot").collect()}
    assert len(got) == n and len(feats.columns) < 15
    for r in rows[::97]:
        want = {f"ADMISSION_LOCATION_{r[9]}", "MARITAL_STATUS_Single", "ETHNICITY_White"}
        assert got[r[1]] == want - {f"{c.upper()}_{v}" for c, v in rules.ONE_HOT_BASELINES.items()}
