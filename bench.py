"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each registered query is executed in full with the no-op sink (every row is
produced, nothing is collected to the driver), BENCH_REPEATS times (3 by
default); its time is the median, from the raw tables each time, and its
scratch tables are deleted in between.  ``chart_rows_per_s`` is the rate of the
chart-event stage from CSV files in the raw layout (15 columns) to a Parquet
table, over the raw chart rows repeated 1, 10 and 100 times, so that its growth
with size can be read.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "readmission_cohort",          # stage 1: cohort, label, enrichment (flagship)
    "lump_rare_values",            # stage 2: temporal history join + dedupe + lumping
    "filter_plausible_range",      # stage 4: chart-event cleaning (one narrow pass)
    "anti_join_boundary_days",     # stage 3: output events, daily sums, boundary days
    "drop_consecutive_repeats",    # stage 5: derive, bin, run compression
    "group_sizes",                 # stage 6: charts + prescriptions per stay
    "build_feature_table",         # stage 7: arrays, split, feature table
    "average_precision",           # scoring
    "roc_auc",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from pyspark.sql import functions as F

    from staytrail.operators.events import clean_chart_events
    from staytrail.plans import catalog
    from staytrail.plans.views import TestViews
    from staytrail.session import drop_scratch, get_session, scratch_path
    from staytrail.sources.files import read_events_csv, write_csv, write_stage

    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    qs = catalog.queries()
    # warm-up on the smallest data (JIT, class loading), not timed
    smoke = "/root/testdata/sf0.001"
    if os.path.isdir(smoke):
        for name in HEADLINE:
            consume(qs[name](spark, smoke))
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            t = time.time()
            consume(qs[name](spark, sf_dir))
            runs.append(time.time() - t)
            drop_scratch(spark)
        times[name] = round(median(runs), 3)
    rates = {}
    chart = TestViews(spark, sf_dir).chart
    for n in (1, 10, 100):
        path, out = scratch_path(spark, "bench_chart"), scratch_path(spark, "bench_clean")
        many = chart.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_n")
        write_csv(catalog.as_chart_file(many).repartition(int(cpus) * 2), path)
        rows = chart.count() * n
        runs = []
        for _ in range(repeats):
            t = time.time()
            write_stage(clean_chart_events(read_events_csv(spark, path, catalog.CHART_SCHEMA)), out)
            runs.append(time.time() - t)
        rates[str(rows)] = round(rows / median(runs))
        drop_scratch(spark)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "chart_rows_per_s": rates,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
