"""Executors have no copy of the package: what runs there must be sent to them."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's only; workers get the environment's path
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
there = spark.range(1).selectExpr("id").rdd.map(lambda _: __import__("importlib.util").util.find_spec("loomframe") is None).first()
assert there, "the workers do see the package"
import __spark_entry__ as entry
for name in {names!r}:
    n = entry.queries()[name](spark, {sf!r}).count()
    print(name, n)
spark.stop()
"""


def run(names, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=names, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return dict(x.split() for x in done.stdout.splitlines() if len(x.split()) == 2)


def test_training_data_queries(tmp_path):
    names = ["op2_pieces", "op3_substrings", "op4_suffixes", "op5_jaccard", "op6_quality", "op9_secrets", "op11_vectorcodes", "op12_divergence", "op13_superminhash", "pipeline"]
    assert list(run(names, tmp_path)) == names
