"""Python-side operators work when the driver does not start in the repository
(the package is shipped to workers with addPyFile)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as e
print("ROWS", e.queries()["crf_loglik"](spark, "/root/testdata/sf0.001").count())
"""


def test_mapinpandas_query_from_foreign_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]
