import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.model import vectors as table
from loomframe.operators import descent, vectors

DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, monkeypatch, sf):
    pairs, real = [], descent.improved
    monkeypatch.setattr(descent, "improved", lambda lists, *a: pairs.append(descent.measured(lists)) or real(lists, *a))
    df = table(spark, f"{DATA}/{sf}")
    n = df.count()
    got = descent.nearest_by_descent(df, 10)
    assert got.columns == ["src", "dst", "dist", "rank"] and got.count() == 10 * n
    exact = {(r.src, r.dst): r.dist for r in vectors.nearest(df, 10, df.filter("vec_id % 50 = 0")).collect()}
    found = {(r.src, r.dst): r.dist for r in got.filter("src % 50 = 0").collect()}
    both = exact.keys() & found.keys()
    print(sf, "recall", len(both) / len(exact), "pairs of rounds / n^2", sum(pairs) / n**2, len(pairs))
    assert len(both) >= 0.9 * len(exact)
    assert all(found[p] == pytest.approx(exact[p], abs=1e-9) for p in both)
    if n >= 2000:
        assert sum(pairs) < n * n


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in good:
        near = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 9), j) for j, w in good if j != i)[:k]
        out[i] = [(j, r + 1) for r, (_, j) in enumerate(near)]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.src, r["rank"])):
        out.setdefault(r.src, []).append((r.dst, r["rank"]))
    return out


def test_copies_and_odd_vectors(spark):
    """With as many probes as cells, lists are exact: so are those of copies, whose keys decide."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(0, 120, 2)] + [(i, [1.0, 2.0, -0.0]) for i in range(300, 310)] + [(i, [3.0, 2.0, 0.5]) for i in range(1, 9, 2)]
    rows += [(400 + i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [math.nan, 0.0, 0.0]), (904, [math.inf, 0.0, 1.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").withColumn("src", F.lit("x")).withColumn("rank", F.lit(1))
    assert lists(descent.nearest_by_descent(df, 5, width=12, probes=100)) == brute(rows, 5)
    few = spark.createDataFrame(rows[:3] + rows[-4:], df.select("vec_id", "vec").schema)
    assert lists(descent.nearest_by_descent(few, 5)) == brute(rows[:3], 5)
    assert descent.nearest_by_descent(few.limit(1), 5).count() == 0
    assert descent.nearest_by_descent(few.limit(0), 5).count() == 0


def test_a_round_measures_only_what_is_fresh(spark):
    points = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, v array<double>")
    old = spark.createDataFrame([(0, 3, 3.0, 1, True), (1, 0, 1.0, 1, False), (2, 0, 2.0, 1, False), (3, 1, 2.0, 1, False)], "src long, dst long, dist double, rank long, fresh boolean")
    got = {(r.src, r.dst, r.fresh) for r in descent.improved(old, points, 1).collect()}
    assert got == {(0, 3, False), (1, 0, False), (2, 0, False), (3, 1, False)}  # 3's neighbour is nearer than 0
    wide = spark.createDataFrame([(0, 1, 1.0, 1, False), (0, 2, 2.0, 2, True), (1, 0, 1.0, 1, False), (1, 3, 2.0, 2, False), (2, 0, 2.0, 1, False), (2, 3, 1.0, 2, False)], old.schema)
    assert descent.measured(wide) == 1
    got = {(r.src, r.dst) for r in descent.improved(wide, points, 2).filter("fresh").collect()}
    assert got == {(1, 2), (2, 1)}
