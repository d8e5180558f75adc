"""Queries with Python in tasks, from a folder that does not hold the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op10_main_text", "op11_fill_in_middle"):
    print("rows", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_the_entry_runs_from_any_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(entry=str(REPO / "__spark_entry__.py"))
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "rows op10_main_text 50" in done.stdout and "rows op11_fill_in_middle 200" in done.stdout, done.stderr[-2000:]
