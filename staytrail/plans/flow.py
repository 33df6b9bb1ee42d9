"""The end-to-end build as lazily chained stages over the test views.

Every attribute is a DataFrame, computed when it is first read.  A stage that
feeds several others (cohort, cleaned charts, binned rows, runs, sequences) is
then written once to the shared folder; all other stages are plans that run
with their action.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import rules
from ..operators import cohort as cohort_ops
from ..operators import codes as code_ops
from ..operators import events as event_ops
from ..operators import sequences as seq_ops
from ..operators import split as split_ops
from ..session import materialize
from .views import OBSCURE_CUTOFF_YEAR, TestViews


class Flow:
    """All stages from a set of source tables.

    ``sources`` is any object with the DataFrame attributes stays, patients,
    admissions, services, diagnoses, procedures, items, chart, outputs, meds --
    e.g. ``sources.clinical.clinical_sources(spark, dir)`` for the source CSV
    layout; by default the stand-in views over the test tables in ``sf_dir``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, compat: bool = False,
                 materialize_stages: bool = True, sources=None, dob_cutoff_year: int | None = None,
                 include_bmi: bool = False, max_categories: int = 1000):
        self.spark = spark
        self.v = sources if sources is not None else TestViews(spark, sf_dir)
        self.compat = compat
        self.materialize_stages = materialize_stages
        self.include_bmi = include_bmi
        self.max_categories = max_categories
        self.dob_cutoff_year = dob_cutoff_year or (OBSCURE_CUTOFF_YEAR if sources is None else 2000)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        """Stages read by several later stages are computed once."""
        return materialize(df, name) if self.materialize_stages else df

    def check_attrition(self, expected: dict[str, tuple[int | None, int]]) -> None:
        """Raise if the funnel differs from expected (subjects, stays) per step."""
        funnel = cohort_ops.attrition(self.v.stays, self.v.patients, dob_cutoff_year=self.dob_cutoff_year)
        problems = cohort_ops.expect_counts(funnel, expected)
        if problems:
            raise ValueError("; ".join(problems))

    # stage 1: cohort
    @cached_property
    def cohort_base(self) -> DataFrame:
        return cohort_ops.link_stays_patients(self.v.stays, self.v.patients, dob_cutoff_year=self.dob_cutoff_year)

    @cached_property
    def cohort(self) -> DataFrame:
        return self._stage(cohort_ops.build_cohort(self.v.stays, self.v.patients, self.v.admissions, self.v.services,
                                                   dob_cutoff_year=self.dob_cutoff_year, compat=self.compat), "cohort")

    # stage 2: codes
    @cached_property
    def codes_by_subject(self) -> tuple[DataFrame, list[str]]:
        """``codes`` with the columns by which its rows lie together, and the names of those."""
        # the lumping inside reads a written input; its output is a lookup over
        # it, so it is not written a second time
        return code_ops.diag_proc_by_subject(self.cohort, self.v.diagnoses, self.v.procedures, self.v.admissions)

    @cached_property
    def codes(self) -> DataFrame:
        return self.codes_by_subject[0].select(*code_ops.KNOWN)

    # stages 3-5: events
    @cached_property
    def chart_clean(self) -> DataFrame:
        return event_ops.clean_chart_events(self.v.chart)

    @cached_property
    def chart_stage(self) -> DataFrame:
        """``chart_clean``, written: the derived types read it several times."""
        return self._stage(self.chart_clean, "chart_clean")

    @cached_property
    def charts_derived(self) -> DataFrame:
        return event_ops.replace_with_derived(self.chart_stage)

    @cached_property
    def outputs_reduced(self) -> DataFrame:
        return event_ops.reduce_outputs(self.v.outputs, self.v.items, self.v.stays, compat=self.compat)

    @cached_property
    def binned(self) -> DataFrame:
        return event_ops.binned_events(self.charts_derived, self.outputs_reduced, self.include_bmi)

    @cached_property
    def runs(self) -> DataFrame:
        return self._stage(event_ops.compress_runs(self._stage(self.binned, "binned")), "runs")

    @cached_property
    def last_only(self) -> DataFrame:
        return event_ops.last_only(self.runs)

    # stage 6: prescriptions
    @cached_property
    def cp_by_stay(self) -> tuple[DataFrame, int | None]:
        """``cp``, and the number of parts by stay in which its rows lie."""
        return seq_ops.charts_prescriptions_by_stay(self.cohort, self.runs, self.v.meds)

    @cached_property
    def cp(self) -> DataFrame:
        return self.cp_by_stay[0]

    # stage 7: arrays, split, features
    @cached_property
    def dp_arrays(self) -> tuple[DataFrame, DataFrame]:
        codes, keys = self.codes_by_subject
        return seq_ops.sequence_arrays(self.cohort.select("icustay_id"), codes, "icustay_id", "icd9_code",
                                       "days_to_out", rules.DP_QUANTILE, "dp", width=30.0, lie=keys)

    @cached_property
    def cp_arrays(self) -> tuple[DataFrame, DataFrame]:
        return seq_ops.sequence_arrays(self.cohort.select("icustay_id"), self.cp, "icustay_id", "valuecat",
                                       "hours_to_out", rules.CP_QUANTILE, "cp", width=24.0, parts=self.cp_by_stay[1])

    @cached_property
    def split(self) -> DataFrame:
        return split_ops.grouped_split(self.cohort, "subject_id", rules.SPLIT_CUTS, rules.SPLIT_SEED)

    @cached_property
    def categories(self) -> dict:
        return split_ops.category_values(self.cohort, rules.CATEGORY_COLUMNS, self.max_categories)

    @cached_property
    def last_features(self) -> DataFrame:
        labels = [x for t in rules.BINNED_TYPES for x in rules.BIN_LABELS[t]]
        return split_ops.last_category_features(self.cohort, self.last_only, labels)

    @cached_property
    def features(self) -> DataFrame:
        return split_ops.build_features(self.cohort, self.dp_arrays[0], self.cp_arrays[0], self.categories)

    @cached_property
    def sparse_features(self) -> tuple[DataFrame, DataFrame]:
        """The feature table with index arrays for any number of categories, and the names of the positions."""
        return split_ops.sparse_features(self.cohort, self.dp_arrays[0], self.cp_arrays[0])
