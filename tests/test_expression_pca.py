import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import expression_pca, matrix

SF = "/root/testdata/sf0.01"


def dense(scaled, cells):
    """(cell ids, gene ids, the centred matrix with all of its zeros)."""
    rows = scaled.collect()
    ids, genes = sorted(cells), sorted({r.gene_id for r in rows})
    at, col = {c: i for i, c in enumerate(ids)}, {g: j for j, g in enumerate(genes)}
    zero = {r.gene_id: r.zero for r in rows}
    a = np.tile([zero[g] for g in genes], (len(ids), 1))
    for r in rows:
        a[at[r.cell_id], col[r.gene_id]] = r.z
    return ids, genes, a - a.mean(0)


def against_svd(found, scaled, cells, k):
    ids, genes, b = dense(scaled, cells)
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    var = found.variances.orderBy("pc").collect()
    assert np.allclose([r.variance for r in var], s[:k] ** 2 / (len(ids) - 1), rtol=1e-9)
    assert np.allclose([r.ratio for r in var], s[:k] ** 2 / (s**2).sum(), rtol=1e-9)
    axes = np.zeros((len(genes), k))
    for r in found.loadings.collect():
        axes[genes.index(r.gene_id), r.pc - 1] = r.loading
    own = vt[:k].T
    assert np.linalg.norm(axes - own @ (own.T @ axes), 2) < 1e-6  # the same subspace
    assert (axes[np.abs(axes).argmax(0), range(k)] > 0).all()
    scores = {r.cell_id: r.pc for r in found.scores.collect()}
    assert sorted(scores) == ids
    assert np.allclose(np.array([scores[c] for c in ids]), b @ axes, atol=1e-8)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_expression_matrix_against_dense_svd(spark):
    from loomframe.model import counts

    scaled = matrix.scaled(matrix.log_normalize(counts(spark, SF))).cache()
    assert scaled.select("gene_id").distinct().count() == 2000
    cells = [r.cell_id for r in counts(spark, SF).select("cell_id").distinct().collect()]
    found = expression_pca.components(scaled, scaled.select("cell_id"), 50)
    against_svd(found, scaled, cells, 50)
    assert found.variances.agg(F.max("residual")).first()[0] < 1e-10


def test_restarts_and_pieces(spark, monkeypatch):
    """Few vectors on the driver, and cells multiplied a few entries at a time."""
    monkeypatch.setattr(expression_pca, "MOST_BYTES", 1)
    monkeypatch.setattr(expression_pca, "AT_ONCE", 50)
    r = np.random.default_rng(2)
    a = r.normal(size=(300, 6)) * [9, 7, 5, 4, 3, 2] @ r.normal(size=(6, 120)) + r.normal(size=(300, 120))
    rows = [(i, j, float(a[i, j]), float(j % 3)) for i in range(300) for j in range(120) if r.random() < 0.4]
    scaled = spark.createDataFrame(rows, "cell_id long, gene_id long, z double, zero double").cache()
    found = expression_pca.components(scaled, spark.range(305).select(F.col("id").alias("cell_id")), 4, passes=200)
    against_svd(found, scaled, range(305), 4)


def test_small_tables(spark):
    kind = "cell_id long, gene_id string, z double, zero double"
    none = expression_pca.components(spark.createDataFrame([], kind), spark.createDataFrame([], "cell_id long"), 3)
    assert none.scores.count() == none.loadings.count() == none.variances.count() == 0
    rows = [(1, "a", 2.0, 0.0), (2, "a", 1.0, 0.0), (2, "b", 1.0, -1.0)]
    found = expression_pca.components(spark.createDataFrame(rows, kind), spark.createDataFrame([(1,), (2,), (3,)], "cell_id long"), 9)
    against_svd(found, spark.createDataFrame(rows, kind), [1, 2, 3], 2)
    constant = spark.createDataFrame([(i, "a", 1.0, 1.0) for i in range(4)], kind)
    assert expression_pca.components(constant, constant, 2).variances.first().variance == 0.0
