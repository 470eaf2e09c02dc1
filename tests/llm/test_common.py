import pyarrow as pa
from pyspark.sql import functions as F

from loomframe.llm import common


def test_batches_stay_small(spark):
    """What reaches Python is bounded in rows and in bytes, where the session has Spark's own limits."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["rows", "bytes"])

    long = spark.range(0, 6000, 1, 2).select(F.repeat(F.lit("x"), 3000).alias("text"))
    got = common.in_batches(long, seen, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 2 * common.BATCH_BYTES
    short = spark.range(0, 9000, 1, 1).select(F.lit("x").alias("text"))
    assert max(r.rows for r in common.in_batches(short, seen, "rows long, bytes long").collect()) == common.BATCH_ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    assert max(r.rows for r in common.in_batches(short, seen, "rows long, bytes long").collect()) == 77
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
