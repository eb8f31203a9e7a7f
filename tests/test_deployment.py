"""Python operators from a driver that was started elsewhere: the workers get the package from the session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from __spark_entry__ import queries
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("support_distance", "knn_join", "bma_fit"):
    print("ROWS", name, queries()[name](spark, {sf!r}).count())
"""


def test_workers_import_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.count("ROWS") == 3, out.stderr[-2000:]
