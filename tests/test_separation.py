"""The library stands without its subpackage llm, its tests and the corpus pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q), len(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q); import newsloom.streaming.jobs\nfrom pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\nassert q['E6_last_run'](spark, e.SMOKE).count() == 5"


def without(tmp_path, *names):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=lambda d, files: {f for f in files if f in (".git", "__pycache__") or os.path.relpath(os.path.join(d, f), ROOT) in names})
    return subprocess.run([sys.executable, "-c", CODE], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)


def test_without_llm_and_pipeline(tmp_path):
    done = without(tmp_path, "newsloom/llm", "tests/llm", "corpus_pipeline.py")
    assert done.returncode == 0, done.stderr


def test_without_llm_alone(tmp_path):
    done = without(tmp_path, "newsloom/llm", "tests/llm")
    assert done.returncode == 0, done.stderr
