"""Plan-shape checks for the scale design (regression guards, not timings)."""

import re

from staytrail.operators import events
from staytrail.plans.flow import Flow
from staytrail.plans.views import TestViews
from staytrail.session import materialize

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chart_cleaner_pushes_down_and_does_not_shuffle(spark):
    raw = materialize(TestViews(spark, SF).chart, "plan_chart_raw")
    df = events.clean_chart_events(raw)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(icustay_id), IsNotNull(valuenum), In(itemid" in plan
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_no_window_over_a_whole_entity(spark):
    """Every window in the cohort and sequence stages is partitioned by an
    entity *and* a range bucket, or is a carry window ordered by bucket over
    the small per-bucket table."""
    from staytrail.operators import sequences
    f = Flow(spark, SF)
    positions = sequences.sequence_positions(f.codes, "icustay_id", "days_to_out", "icd9_code", 30.0)
    runs = events.compress_runs(f.binned)
    for df in (f.cohort_base, positions, runs):
        plan = plan_text(df)
        windows = list(re.finditer(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan))
        assert windows
        for m in windows:
            part, order = m.group(1), m.group(2)
            bucketed = "_b" in part or "_pid" in part
            carry = order.startswith("_bk") or order.startswith("_pid")   # one row per bucket
            assert bucketed or carry, (part, order)


def scans_of(df, column: str) -> int:
    """File scans in the plan whose output holds ``column``."""
    return len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}#", plan_text(df)))


def test_multi_use_stages_are_read_not_recomputed(spark):
    """What comes after a written stage scans that stage, never the raw tables again."""
    f = Flow(spark, SF)
    assert scans_of(f.charts_derived, "event_id") == 0       # charts: from the cleaned stage
    assert scans_of(f.runs, "event_id") == 0 and scans_of(f.runs, "ts") == 0
    assert scans_of(f.cohort_base, "o_orderkey") == 0        # the label reads the adults' stage
    from staytrail.operators import cohort
    funnel = cohort.attrition(f.v.stays, f.v.patients, dob_cutoff_year=1900)
    assert scans_of(funnel, "o_orderkey") == 0 and scans_of(funnel, "c_custkey") == 0


def test_evaluate_builds_one_score_table(spark):
    from staytrail.operators import evaluate
    m = evaluate.evaluate(TestViews(spark, SF).scores, "logit", "y", keys=["lang"])
    plan = plan_text(m)
    assert "labels.parquet" not in plan and "documents.parquet" not in plan
    assert len(re.findall(r"sum\(tp#\d+L?\) windowspecdefinition", plan)) <= 2 and "FileScan parquet" in plan


def test_attrition_is_counted_without_expanding_rows(spark):
    from staytrail.operators import cohort
    v = TestViews(spark, SF)
    assert "Expand" not in plan_text(cohort.attrition(v.stays, v.patients, dob_cutoff_year=1900))
