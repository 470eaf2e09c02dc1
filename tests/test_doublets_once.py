from loomframe.operators import doublets


def test_neighbours_are_found_once(spark, monkeypatch):
    """The vectors are cut in blocks once, and the scores that are read three times are a written table."""
    from loomframe.operators import vectors

    made, real = [], vectors.blocks
    monkeypatch.setattr(vectors, "blocks", lambda *a: made.append(a) or real(*a))
    df = spark.range(120).selectExpr("id AS vec_id", "array(double(id % 4 * 10), double(id % 7)) AS vec")
    out, _ = doublets.simulated_threshold(df, k=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "MapInArrow" not in plan and "CartesianProduct" not in plan
    assert out.count() == 120
