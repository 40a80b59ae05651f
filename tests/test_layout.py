"""The repository without its corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROGRAM = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert not [n for n in q if n[2:3].isdigit()] and "pipeline" not in q and len(q) > 140
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", q["op_d2_lookback"](spark, "/root/testdata/sf0.001").count())
"""


def test_works_without_the_corpus_part(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", ".*_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert (tmp_path / "repo/corpus_pipeline.py").exists() and not (tmp_path / "repo/eventloom/llm").exists()
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "repo/corpus_pipeline.py").unlink()
        ran = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
        assert "ROWS" in ran.stdout, ran.stderr[-2000:]
