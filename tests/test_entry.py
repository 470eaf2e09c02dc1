import ast
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Where they are there, the training-data operators have tests of their own.
OWN = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_nothing_else_imports_the_training_data_package():
    for top, _, names in os.walk(f"{ROOT}/loomframe"):
        if "/llm" in top:
            continue
        for n in (n for n in names if n.endswith(".py")):
            for node in ast.walk(ast.parse(open(f"{top}/{n}").read())):
                found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(x.startswith("loomframe.llm") for x in found), n
