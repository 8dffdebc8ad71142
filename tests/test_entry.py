"""The driver contract, from a folder in which the package cannot be found."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", r"{entry}")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert module.entry(spark).count() == 2
assert set(module.oracle_sql()) <= set(module.queries())
for name in ("m3_additivity", "a4_mcnemar", "g11_infer"):
    assert module.queries()[name](spark, module.SMOKE_DIR).count() > 0
print("done")
"""


def test_tasks_need_no_installed_package(tmp_path):
    entry = Path(__file__).parents[1] / "__spark_entry__.py"
    (tmp_path / "go.py").write_text(SCRIPT.format(entry=entry))
    got = subprocess.run([sys.executable, "go.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]
