import numpy as np
import pytest

from loomframe.operators import graphs
from loomframe.operators import vectors as vec_ops


def cloud(spark, n=230):
    x = np.random.default_rng(2).integers(-3, 4, (n, 3)).astype(float)  # many are as far
    return x, spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id long, vec array<double>, label int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [256, 2])
def test_nearest_of_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(vec_ops, "MOST_HELD", most)
    monkeypatch.setattr(vec_ops, "SLICE", 7)
    x, df = cloud(spark)
    near = vec_ops.nearest(df, 6, block=40)
    assert "CartesianProduct" in plan(near) and "REPARTITION_BY_NUM" not in plan(near)  # pairs of blocks aren't shuffled
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = sorted((i, j, k + 1) for i in range(len(x)) for k, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:6]))
    assert sorted((r["src"], r["dst"], r["rank"]) for r in near.collect()) == want


def test_sums_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec_ops, "SLICE", 7)
    x, df = cloud(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = vec_ops.label_means(df, block=40)
    kernel = graphs.kernel_sums(df.selectExpr("*", "array(double(label)) AS f"), 0.1, block=40)
    assert all("CartesianProduct" in plan(t) and "REPARTITION_BY_NUM" not in plan(t) for t in (means, kernel))
    label, others = np.arange(len(x)) % 3, ~np.eye(len(x), dtype=bool)
    got = {(r["vec_id"], r["lb"]): r["m"] for r in means.collect()}
    assert got == pytest.approx({(i, int(b)): d[i, others[i] & (label == b)].mean() for i in range(len(x)) for b in range(3)})
    sums = {r["vec_id"]: r["g"][0] for r in kernel.collect()}
    assert sums == pytest.approx({i: float((np.exp(-0.1 * d[i] ** 2) * others[i]) @ label) for i in range(len(x))})
