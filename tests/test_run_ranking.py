import random

import __spark_entry__ as entry


def test_means_are_added_up_by_epoch(spark, tmp_path):
    """Runs of 64 values with two places, whose means are close and often end at a half of the sixth place."""
    import duckdb

    r = random.Random(4)
    rows = [(i * 600 + u, i, u, round(50 + r.random() * 0.05, 2), "view") for i in range(64) for u in range(600)]
    d = str(tmp_path)
    frame = spark.createDataFrame(rows, "event_id long, second long, user_id long, value double, event_type string").selectExpr("event_id", "timestamp_seconds(second) AS ts", "user_id", "event_type", "value")
    frame.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{d}/whole")
    frame.repartition(6, "event_id").write.parquet(f"{d}/events.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/whole/*.parquet'")
    want = sorted(c.execute(entry.oracle_sql()["run_ranking"]).fetchall())
    out = entry.queries()["run_ranking"](spark, d)
    got = sorted(tuple(x) for x in out.select("params", "rank_elbo", "rank_rec", "rank_cyc", "rank_kl", "score", "position").collect())
    assert got == want
