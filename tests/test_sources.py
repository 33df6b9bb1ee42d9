"""CSV columns are bound by header name; malformed records are errors in every reader."""

import csv
import shutil
from pathlib import Path

import pytest
from conftest import ts
from pyspark.sql import functions as F

from staytrail.operators import events
from staytrail.plans.catalog import CHART_HEADER, CHART_SCHEMA
from staytrail.session import scratch_path
from staytrail.sources import files
from staytrail.sources.clinical import TABLES, read_table
from staytrail.streaming import ingest

ROWS = ["1,10,100,7.0,211,2100-01-01 08:00:00,2100-01-01 09:00:00,99,80,80,bpm,0,0,,",
        "2,10,100,7.0,678,2100-01-01 09:00:00,,99,\"98,6\",98.6,F,,,,NotStopd",
        "3,11,101,,211,2100-01-02 08:00:00,,,70,70.5,bpm,,,,"]


def write(path, rows, header=CHART_HEADER, name="a.csv"):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join([",".join(header), *rows]) + "\n")
    return str(path)


def clean(df):
    return sorted((r.icustay_id, r.charttime, r.ce_type, round(r.valuenum, 9)) for r in events.clean_chart_events(df).collect())


def stream(spark, raw):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    done = ingest.ingest_once(spark, raw, out, ckpt, CHART_SCHEMA, events.clean_chart_events)
    return sorted((r.icustay_id, r.charttime, r.ce_type, round(r.valuenum, 9)) for r in done.collect())


def test_wide_chart_file_in_all_readers(spark, tmp_path):
    raw = write(tmp_path / "chart", ROWS)
    batch = clean(files.read_events_csv(spark, raw, CHART_SCHEMA))
    assert batch == [(7, ts("2100-01-01 08:00"), "HEART_RATE", 80.0), (7, ts("2100-01-01 09:00"), "BODY_TEMPERATURE", 37.0)]
    assert clean(read_table(spark, raw, TABLES["chart"][1])) == batch
    assert stream(spark, raw) == batch


@pytest.mark.parametrize("bad", [ROWS[0].replace("80,80,", "80,eighty,"), ROWS[0].replace("211", "2x1"),
                                 ROWS[0].replace("2100-01-01 08:00:00", "yesterday")])
def test_malformed_record_raises_everywhere(spark, tmp_path, bad):
    raw = write(tmp_path / "chart", [ROWS[1], bad])
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        clean(files.read_events_csv(spark, raw, CHART_SCHEMA))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        clean(read_table(spark, raw, TABLES["chart"][1]))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed|terminated with"):
        stream(spark, raw)


def test_reordered_columns_and_missing_column(spark, tmp_path):
    order = [9, 5, 4, 3, 2, 1, 0]
    cells = [r.split(",") for r in ROWS if '"' not in r]
    raw = write(tmp_path / "some", [",".join(c[i] for i in order) for c in cells], [CHART_HEADER[i] for i in order])
    got = files.read_events_csv(spark, raw, CHART_SCHEMA).orderBy("subject_id").collect()
    assert [(r.subject_id, r.itemid, r.valuenum) for r in got] == [(10, 211, 80.0), (11, 211, 70.5)]
    raw = write(tmp_path / "few", ["1,2"], ["SUBJECT_ID", "ITEMID"])
    with pytest.raises(ValueError, match="valuenum"):
        files.read_events_csv(spark, raw, CHART_SCHEMA)


def mixed(spark, raw, out, ckpt, per_trigger=None):
    done = ingest.ingest_mixed_once(spark, raw, out, ckpt, CHART_SCHEMA, events.clean_chart_events, per_trigger)
    return sorted((r.icustay_id, r.charttime, r.ce_type, round(r.valuenum, 9)) for r in done.collect())


def turned(rows):
    """The rows and the header with their columns from last to first."""
    cells = [next(csv.reader([r])) for r in rows]
    quoted = [",".join(f'"{x}"' if "," in x else x for x in reversed(c)) for c in cells]
    return quoted, CHART_HEADER[::-1]


def test_files_with_different_headers_are_read_by_name(spark, tmp_path):
    raw = write(tmp_path / "two", ROWS[:1])
    write(tmp_path / "two", *turned(ROWS[1:]), "b {x} 100%25+[1].csv")  # the name has no meaning as a pattern or a code
    (tmp_path / "two" / "empty.csv").write_text("")
    (tmp_path / "two" / "blank.csv").write_text("\n\n")
    one = write(tmp_path / "one", ROWS)
    want = clean(files.read_events_csv(spark, one, CHART_SCHEMA))
    assert len(want) == 2 and clean(files.read_events_csv(spark, raw, CHART_SCHEMA)) == want
    assert sorted(len(f) for f in files.csv_headers(spark, raw).values()) == [1, 1]
    assert clean(read_table(spark, raw, TABLES["chart"][1])) == want
    for per_trigger in (1, None):
        assert mixed(spark, raw, scratch_path(spark, "out"), scratch_path(spark, "ckpt"), per_trigger) == want


def test_mixed_stream_goes_on_with_new_files_and_counts_each_once(spark, tmp_path):
    raw = write(tmp_path / "feed", ROWS[:1])
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    assert [r[2] for r in mixed(spark, raw, out, ckpt)] == ["HEART_RATE"]
    write(tmp_path / "feed", *turned(ROWS[1:]), "b.csv")
    both = mixed(spark, raw, out, ckpt)
    assert [r[2] for r in both] == ["HEART_RATE", "BODY_TEMPERATURE"]
    # a batch that runs again replaces its own rows
    last = max(int(p.name) for p in (Path(ckpt) / "commits").glob("[0-9]*"))
    undone = scratch_path(spark, "ckpt")
    shutil.copytree(ckpt, undone, ignore=lambda d, names: [str(last), f".{last}.crc"] if d.endswith("commits") else [])
    assert last == 1 and mixed(spark, raw, out, undone) == both
    (tmp_path / "feed" / "c.csv").write_text("")
    assert mixed(spark, raw, out, ckpt) == both


def test_a_missing_column_or_bad_record_in_one_of_two_headers_raises(spark, tmp_path):
    raw = write(tmp_path / "few", ROWS)
    write(tmp_path / "few", ["1,2"], ["SUBJECT_ID", "ITEMID"], "b.csv")
    with pytest.raises(ValueError, match="valuenum"):
        files.read_events_csv(spark, raw, CHART_SCHEMA)
    raw = write(tmp_path / "bad", ROWS)
    write(tmp_path / "bad", *turned([ROWS[0].replace("80,80,", "80,eighty,")]), "b.csv")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        clean(files.read_events_csv(spark, raw, CHART_SCHEMA))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed|terminated with"):
        mixed(spark, raw, scratch_path(spark, "out"), scratch_path(spark, "ckpt"))
    with pytest.raises(ValueError, match="no header"):
        files.read_events_csv(spark, write_empty(tmp_path), CHART_SCHEMA)


def write_empty(tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    return str(tmp_path / "none")


def test_header_read_leaves_settings_and_other_separators(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.csv").write_text("b;a\n2;1\n")
    (tmp_path / "b.csv").write_text('"a";"b"\n3;4\n')
    got = files.read_events_csv(spark, str(tmp_path), "a int, b int", options={"sep": ";"})
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4)]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_metric_history_appends_and_numbers(spark):
    path = scratch_path(spark, "en_training_results")
    for e in ("b", "a", "c"):
        files.append_metrics(spark.createDataFrame([(e, 0.5)], "epoch string, f1_scores double"), path)
    back = files.read_metrics(spark, [path], "epoch string, f1_scores double")
    # the folder of a scratch table ends with a random part, so the pattern takes what stands before the words
    numbered = files.number_epochs(back.withColumn("name", F.col("epoch")), "name")
    assert sorted((r.name, r.epoch, r.model) for r in numbered.collect()) == [("a", 1, "en"), ("b", 2, "en"), ("c", 3, "en")]


def test_csv_stage_is_packed_in_bounded_files_and_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PACKED_ROWS", 300)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"code {i % 5}, \"x\"", i / 3) for i in range(1000)],
                                 "a long, b string, c double").repartition(2)
    path = str(tmp_path / "stage")
    files.write_stage(rows, path, fmt="csv")
    packed = sorted((tmp_path / "stage").glob("part-*"))
    assert len(packed) == 4 and all(p.name.endswith(".csv.gz") for p in packed)
    assert [Path(f).name for f in files.csv_headers(spark, path)["a", "b", "c"]] == [p.name for p in packed]
    assert sorted(files.read_events_csv(spark, path, rows.schema).collect()) == sorted(rows.collect())
