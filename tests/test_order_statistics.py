import math
import random
import statistics

import numpy as np
import pytest

from loomframe.operators import orderstats

SETS = {
    "ties": [3.0] * 700 + [1.0, 2.0, 5.0, 5.0],
    "even": [float(i) for i in range(3000)],
    "wide": [10.0 ** random.Random(i).uniform(-300, 300) for i in range(3000)],
    "signs": [(-1) ** i * 10.0 ** random.Random(i).uniform(-20, 20) for i in range(3000)] + [0.0, -0.0, math.inf, -math.inf],
    "negative": [-(2.0**-i) for i in range(1000)] * 3,
    "close": [1.0 + i * 2.0**-52 for i in range(2500)],
    "one": [4.5],
    "two": [1.0, 2.0],
    None: [7.0, 8.0, 9.0],
}


def table(spark):
    rows = [(k, len(str(k)), x) for k, v in SETS.items() for x in v] + [("even", 4, None), ("even", 4, math.nan), ("nothing", 7, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "name string, size int, x double")


@pytest.mark.parametrize("few", [orderstats.FEW, 1])
def test_every_rank(spark, monkeypatch, few):
    """Also where ranges are cut down to single values."""
    monkeypatch.setattr(orderstats, "FEW", few)
    monkeypatch.setattr(orderstats, "BINS", 1024 if few > 1 else 64)
    asked = [(k, len(str(k)), r) for k, v in SETS.items() for r in {0, 1, len(v) // 3, len(v) // 2, len(v) - 1, len(v)}]
    wanted = spark.createDataFrame(asked, "name string, size int, rank long")
    got = {(r["name"], r["rank"]): r["x"] for r in orderstats.kth(table(spark), ["name", "size"], "x", wanted).collect()}
    assert got == {(k, r): sorted(SETS[k])[r] for k, _, r in asked if r < len(SETS[k])}


def test_quantiles(spark):
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["name"]: (r["n"], r["q"]) for r in orderstats.quantiles(table(spark), ["name"], "x", qs).collect()}
    assert set(got) == set(SETS)
    for k, v in SETS.items():
        assert got[k][0] == len(v)
        if k != "signs":
            assert np.allclose(got[k][1], np.quantile(v, qs), rtol=1e-12, atol=0)
    assert orderstats.quantiles(table(spark).limit(0), ["name"], "x", qs).count() == 0
    assert orderstats.quantiles(table(spark).filter("name = 'even'"), [], "x", [0.5]).first().q == [1499.5]


def test_robust_stats_have_no_median_and_no_buffer(spark):
    from loomframe.operators import qc

    df = table(spark).filter("name <> 'signs' AND name <> 'wide'")
    got = {r["name"]: (r["med"], r["mad"]) for r in qc.robust_stats(df, ["name"], "x").collect()}
    for k, v in SETS.items():
        if k in got:
            med = statistics.median(v)
            assert got[k] == pytest.approx((med, statistics.median([abs(x - med) for x in v]) / 0.6745), rel=1e-12)
    plan = qc.robust_stats(df, ["name"], "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan
