"""The smoothed curve of variance on mean: as the dense fits, in tasks that never hold all genes."""

import numpy as np
import pytest

from loomframe.operators import reduction


def _dense(x, y, span):
    k, out = max(min(len(x), 4), int(span * len(x))), np.empty(len(x))
    for i in range(len(x)):
        lo = min(max(0, i - k // 2), len(x) - k)
        d = x[lo : lo + k] - x[i]
        far = max(1e-9, np.abs(d).max())
        w = np.sqrt((1 - (np.abs(d) / far).clip(0, 1) ** 3) ** 3 + 1e-9)
        out[i] = np.linalg.lstsq(np.stack([np.ones(k), d, d * d], 1) * w[:, None], y[lo : lo + k] * w, rcond=None)[0][0]
    return out


def _table(spark, kind, n, seed=5):
    r = np.random.default_rng(seed)
    x = {"spread": r.normal(0, 1, n), "tied": np.log10(r.integers(1, 40, n)), "tails": r.standard_t(2, n), "same": np.zeros(n)}[kind]
    y = 1.5 * x + 0.2 * x * x + r.normal(0, 0.3, n)
    order = np.lexsort((np.arange(n), x))
    rows = [(int(i), float(x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "gene_id long, x double, y double"), order, x[order], y[order]


@pytest.mark.parametrize(("kind", "n"), [("spread", 900), ("tied", 900), ("tails", 900), ("same", 100), ("spread", 3), ("spread", 33)])
def test_equals_the_dense_fit(spark, monkeypatch, kind, n):
    monkeypatch.setattr(reduction, "CURVE_BLOCK", 16)
    monkeypatch.setattr(reduction, "CURVE_FAN", 2)
    points, order, x, y = _table(spark, kind, n)
    got = {r.gene_id: r.fitted for r in reduction.local_curve(points, 0.3).collect()}
    assert len(got) == n
    assert np.allclose([got[int(i)] for i in order], _dense(x, y, 0.3), rtol=0, atol=1e-7)


def test_an_empty_table_gives_no_rows(spark):
    assert reduction.local_curve(_table(spark, "spread", 3)[0].limit(0)).collect() == []


def test_no_task_gets_all_genes(spark, monkeypatch):
    monkeypatch.setattr(reduction, "CURVE_BLOCK", 16)
    seen = spark.sparkContext.accumulator(0)
    plain, block = reduction._fit_block, 16

    def watched(own, n, k, x, y, at, sides):
        seen.add(len(at) > 5 * block)
        return plain(own, n, k, x, y, at, sides)

    monkeypatch.setattr(reduction, "_fit_block", watched)
    reduction.local_curve(_table(spark, "spread", 900)[0], 0.3).collect()
    assert seen.value == 0
