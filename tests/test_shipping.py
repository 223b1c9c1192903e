"""A session started in a folder of its own, without the package on its workers' path."""

import os
import subprocess
import sys
import zipfile
from pathlib import Path

from quillgate import shipping

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
for name in ("html_page_blocks", "anchor_contains"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[::2] == ["html_page_blocks", "anchor_contains"]


def test_archive(tmp_path):
    first = shipping.package_archive(str(tmp_path))
    assert shipping.package_archive(str(tmp_path)) == first
    names = zipfile.ZipFile(first).namelist()
    assert "quillgate/__init__.py" in names and all(n.startswith("quillgate/") and n.endswith(".py") for n in names)
