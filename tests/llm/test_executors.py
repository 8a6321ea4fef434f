"""Operators in a process whose workers can't import the package: only the driver has it on its path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

def missing(_):
    try:
        import lexforge
        return [0]
    except ImportError:
        return [1]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect() == [1], "workers see the package"
import __spark_entry__
known = __spark_entry__.queries()
for name in sorted(n for n in known if n.startswith("op")) + ["pipeline"]:
    rows = known[name](spark, "/root/testdata/sf0.001").collect()
    assert rows, name
print("all ran")
"""


def test_no_operator_needs_the_package_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stderr[-3000:]
