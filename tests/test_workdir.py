import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest

from lexitally.sources.workdir import discard, shared_folder, written


def test_discard(spark):
    table = written(spark.range(5), "numbers")
    path = table.folder.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 5
    discard(table)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        return SimpleNamespace(conf={"spark.master": master})

    assert shared_folder(session("local[4]"), "x").startswith("file://")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master), "x")


def test_folders_go_when_the_driver_ends(tmp_path):
    code = (
        "import sys, os; from pyspark.sql import SparkSession; from lexitally.sources.workdir import written; "
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://' + sys.argv[1]).getOrCreate(); "
        "written(spark.range(3), 'numbers'); assert any(n.startswith('numbers-') for n in os.listdir(sys.argv[1])); spark.stop()"
    )
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=os.getcwd())
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(100):  # the JVM ends a little later
        if not list(tmp_path.glob("numbers-*")):
            return
        time.sleep(0.1)
    raise AssertionError(os.listdir(tmp_path))
