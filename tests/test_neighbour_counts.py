import numpy as np
import pytest

from loomframe.operators import doublets
from loomframe.operators import vectors as vec_ops


@pytest.mark.parametrize("most", [8_000_000, 900])
def test_counts_of_many_blocks(spark, monkeypatch, most):
    """As told by plain sorting by distance and key, with many as far, copies, and one that isn't finite."""
    monkeypatch.setattr(vec_ops, "MOST_SQUARES", most)
    x = np.random.default_rng(2).integers(-3, 4, (260, 3)) / 7
    x[200:240] = x[0]
    x[250] = np.nan
    keys = np.where(np.arange(260) % 3 == 0, -np.arange(260) - 1, np.arange(260))
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(keys, x, strict=True)], "vec_id long, vec array<double>")
    ks, want = [30, 2, 100, 258, 999], []
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    for i in np.flatnonzero(keys >= 0):
        near = sorted((d[i, j], keys[j]) for j in range(260) if j != i and np.isfinite(d[i, j]))
        want += [(keys[i], k, len(near[:k]), sum(key < 0 for _, key in near[:k])) for k in ks if near]
    got = vec_ops.neighbour_counts(df, ks, df.filter("vec_id >= 0"), block=40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert vec_ops.neighbour_counts(df.limit(0), ks, df.limit(0)).count() == 0


def test_shares_write_no_neighbours(spark, monkeypatch):
    """What is written for a vector doesn't grow with the share of all vectors that is looked at."""
    written, real = [], vec_ops.cut
    monkeypatch.setattr(vec_ops, "cut", lambda df: written.append(real(df)) or written[-1])
    monkeypatch.setattr(vec_ops, "uncut", lambda *tables: None)
    df = spark.range(300).selectExpr("id AS vec_id", "array(double(id % 37), double(id % 11)) AS vec")
    shares = doublets.neighbour_shares(df, 0.2, (0.01, 0.5))
    assert shares.count() == 600 and "MapInArrow" not in shares._jdf.queryExecution().executedPlan().toString()
    assert max(t.count() for t in written) == 600
