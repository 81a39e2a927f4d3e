"""The driver loads __spark_entry__.py by path from another working directory
with a plain session: Python-worker stages must still import the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
assert len(E.entry(spark).collect()) == 6
qs = E.queries()
assert qs["pool_attention"](spark, "/root/testdata/sf0.001").count() > 0       # pandas UDF
assert qs["ridge_kfold_embeddings"](spark, "/root/testdata/sf0.001").count() == 8  # mapInPandas
assert set(E.oracle_sql()) <= set(qs)
print("CONTRACT-OK")
"""


def test_entry_runs_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="gw-contract-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "CONTRACT-OK" in res.stdout, res.stderr[-3000:]
