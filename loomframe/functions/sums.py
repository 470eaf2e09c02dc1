"""Sums of arrays that every task has one of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shipping import ships

ships(__name__)

#: Numbers of a strip: what one row carries.
STRIP = 1 << 17
#: Tasks whose strips are added up by one.
FAN = 64


def strips(v, most: int | None = None):
    """A record batch (strip int, v binary) of the array ``v`` of doubles."""
    import numpy as np
    import pyarrow as pa

    flat, step = np.ascontiguousarray(v, np.float64).ravel(), most or STRIP
    parts = [flat[k : k + step].tobytes() for k in range(0, len(flat), step)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["strip", "v"])


def summed(parts: DataFrame, tasks: int, shape: tuple[int, ...]):
    """The sum of all tasks' arrays as one array of ``shape``; zeros if there is none.

    ``parts`` (strip int, v binary) are ``strips`` of ``tasks`` tasks. They are
    added up strip by strip, of ``FAN`` tasks at a time.
    """
    import numpy as np
    import pyarrow as pa

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("v").to_pylist())
        return pa.table({"strip": table.column("strip").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    schema, own = "strip int, v binary", "_task"
    if tasks > FAN:
        parts = parts.withColumn(own, F.spark_partition_id())
        while tasks > FAN:
            parts = parts.withColumn(own, F.floor(F.col(own) / FAN).cast("int")).groupBy("strip", own).applyInArrow(lambda t: add(t).append_column(own, t.column(own).slice(0, 1)), f"{schema}, {own} int")
            tasks = -(-tasks // FAN)
        parts = parts.drop(own)
    rows = parts.groupBy("strip").applyInArrow(add, schema).collect()
    flat = b"".join(bytes(r["v"]) for r in sorted(rows, key=lambda r: r["strip"]))
    return np.frombuffer(flat, np.float64).reshape(shape).copy() if flat else np.zeros(shape)
