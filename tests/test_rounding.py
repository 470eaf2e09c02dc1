from pyspark.sql import functions as F

from loomframe.model import r6


def test_rounds_as_sql_does_where_the_product_is_near_a_half(spark):
    """1209 counts over 1,200,000 genes: the product with a million is 1007.4999999999999."""
    import duckdb

    sums = [1191, 1197, 1209, 1, 3, -1209]
    rows = spark.createDataFrame([(i, float(n), 1_200_000) for i, n in enumerate(sums)], "id int, total double, size long")
    got = [r["mean"] for r in rows.select("id", r6(F.col("total") / F.col("size")).alias("mean")).orderBy("id").collect()]
    want = [duckdb.execute(f"SELECT round({n}::DOUBLE / 1200000, 6)").fetchall()[0][0] for n in sums]
    assert got == want
    assert got[2] == 0.001007
