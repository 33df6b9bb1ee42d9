"""Scratch tables live in the shared folder, keep its URI and go when they are no longer needed."""

import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest
from conftest import ROOT

from staytrail import session
from staytrail.plans import catalog

SF = "/root/testdata/sf0.001"


def scratch_entries(spark):
    return set(os.listdir(session.scratch_root(spark).removeprefix("file:")))


def test_scratch_is_empty_after_a_scope(spark):
    before = scratch_entries(spark)
    with session.scratch_scope(spark):
        assert catalog.drop_consecutive_repeats(spark, SF).count() > 0
        assert scratch_entries(spark) - before
    assert scratch_entries(spark) <= before


def test_cohort_is_written_once(spark):
    with session.scratch_scope(spark):
        before = scratch_entries(spark)
        catalog.readmission_cohort(spark, SF).count()
        made = [x.rsplit("-", 1)[0] for x in scratch_entries(spark) - before]
    assert made.count("cohort") == 1 and made.count("adults") == 1


def test_scratch_goes_when_the_application_ends(tmp_path):
    code = ("from staytrail.session import get_session, materialize, scratch_root\n"
            f"spark = get_session('local[1]', 1, extra={{'spark.checkpoint.dir': 'file://{tmp_path}'}})\n"
            "print(materialize(spark.range(5)).count(), scratch_root(spark))\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=180)
    n, root = out.stdout.split()
    assert n == "5" and root.startswith(f"file://{tmp_path}")
    for _ in range(50):  # the JVM ends a little after Python
        if not os.path.exists(root.removeprefix("file://")):
            break
        time.sleep(0.2)
    assert not os.path.exists(root.removeprefix("file://"))


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d, set=lambda k, v: None),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("local-cluster[2,1,1024]"))
    assert session.shared_dir(fake("yarn", "file:///shared/x")) == "file:///shared/x"
    assert os.path.isdir(session.shared_dir(fake("local[2]")))
