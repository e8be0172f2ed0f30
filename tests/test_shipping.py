"""Queries run in workers that can't import the package: from another folder, without it on the path."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name, f in e.queries().items():
    if name in {names!r}:
        print(name, f(s, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    names = ["judged_responses", *[f"p{n}_found" for n in (4, 6, 7, 9)], "p8_mixture"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "judged_responses" in done.stdout
