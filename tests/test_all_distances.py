import numpy as np

from loomframe.operators import vectors as vec_ops


def test_all_pairs_of_many_blocks(spark, monkeypatch):
    """Every pair once, with the sums of plain loops, in small blocks; null where a vector has no distance; no number of vectors is refused."""
    monkeypatch.setattr(vec_ops, "MOST_PAIRED", 10)
    monkeypatch.setattr(vec_ops, "TILE", 4)
    x = [r.tolist() for r in np.random.default_rng(5).normal(size=(60, 7))]
    x[3], x[9], x[11], x[20] = None, [1.0] * 6 + [None], [1.0] * 5, x[21]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(None, [1.0] * 7)], "vec_id long, vec array<double>")

    def far(v, w):
        if v is None or w is None or len(v) != len(w) or None in v + w:
            return None
        total = 0.0
        for a, b in zip(v, w, strict=True):
            total += (a - b) * (a - b)
        return float(np.sqrt(total))

    got = sorted((r["a"], r["b"], r["dist"]) for r in vec_ops.all_distances(df).collect())
    assert got == [(i, j, far(x[i], x[j])) for i in range(60) for j in range(i + 1, 60)]
    assert vec_ops.all_distances(df.limit(0)).count() == 0


def test_neighbours_come_from_few_tasks(spark, monkeypatch):
    """What tasks tell of a vector doesn't grow with the number of blocks."""
    monkeypatch.setattr(vec_ops, "SHARES", 3)
    df = spark.range(400).selectExpr("id AS vec_id", "array(double(id % 37), double(id % 11)) AS vec")
    whole = vec_ops.blocks(df, "vec_id", "vec", 20)
    assert whole.count() > 3 and vec_ops.block_pairs(whole, whole).rdd.getNumPartitions() <= 3 * whole.rdd.getNumPartitions()
    near = vec_ops.nearest(df, 4, block=20)
    assert near.groupBy("src").count().filter("count <> 4").count() == 0 and near.count() == 1600
