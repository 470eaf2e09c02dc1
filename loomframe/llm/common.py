"""Plumbing that the training-data operators share.

Column names that begin with ``_lf_`` are reserved for the operators' own
working columns, so extra input columns with any other name never clash.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the separators of every word rule in this package.
SPACES = " \t\n\x0b\x0c\r"


def ships(module: str) -> None:
    """Pickle what ``module`` defines by value when it is sent to executors."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[module])


ships(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` or the context's checkpoint folder.
    Where neither is set, a fresh local folder, but only if the executors run on
    this machine, as in tests; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomframe-"))
        found = sc.getCheckpointDir()
    return found


#: Bytes of a row group of what operators write for themselves; a writer holds one in memory.
ROW_GROUP = 32 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage at a point that survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for ``tables``; nothing that is read later may need them."""
    for df in tables:
        path = getattr(df, "_lf_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null: empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


#: Bytes of rows up to which a table is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 16_000_000


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that ``value`` takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) and not _fixed(kind.elementType):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(16))
        return F.greatest(F.size(value), F.lit(0)) * _least(kind.elementType) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def _fixed(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_fixed(f.dataType) for f in kind)
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))


def _least(kind: T.DataType) -> int:
    return 16 + sum(_least(f.dataType) for f in kind) if isinstance(kind, T.StructType) else 8


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if its rows take ``most`` bytes at most, as counted; reads no more than it must.

    A hashed relation takes up to some six times that.
    """
    rows = most // max(8, sum(_least(f.dataType) for f in df.schema))
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long")
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most else df


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept by a Python worker under ``name`` until it is asked for another one.

    A worker serves many queries and stages in turn, so it holds one thing at a
    time: what an earlier stage has left there is given back first.
    """
    store = _store()
    if name not in store:
        release_memory()
        store[name] = make()
    return store[name]


def _store() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_loomframe_worker_cache", types.ModuleType("_loomframe_worker_cache")).__dict__.setdefault("held", {})


def release_memory(always: bool = False) -> None:
    """Empties the worker's cache, if it holds anything (or ``always``), and gives free memory back to the system."""
    import ctypes
    import gc

    store = _store()
    if not store and not always:
        return
    store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Memo(dict):
    """Results of ``make`` by key, in about ``most`` bytes.

    Once a half is full, it becomes the older one, and what the older one had
    goes, unless it has been asked for again.
    """

    def __init__(self, make: Callable, most: int, cost: Callable[[object, object], int]):
        super().__init__()
        self.make, self.most, self.cost, self.held, self.older = make, most, cost, 0, {}

    def __missing__(self, key):
        if self.held >= self.most // 2:
            self.older = self.copy()
            self.clear()
            self.held = 0
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.held += self.cost(key, value)
        return value


#: Rows and bytes of the Arrow batches that go to Python, unless the session has its own numbers.
BATCH_ROWS, BATCH_BYTES = 2_000, 2_000_000


def in_batches(df: DataFrame, work: Callable, schema: T.StructType | str, keep: bool = False) -> DataFrame:
    """``df.mapInArrow``, in batches small enough for long texts.

    Spark takes the limits of Arrow batches from the session alone, when the plan
    is run. Where the session has Spark's own defaults, they are set to
    ``BATCH_ROWS`` and ``BATCH_BYTES`` and stay so; other values are left alone.

    Unless it is to ``keep`` its cache for the next task, a worker gives its
    memory back at the end of each: it waits beside others for what may come.
    """
    conf = df.sparkSession.conf
    for key, most, usual in (("maxRecordsPerBatch", BATCH_ROWS, ("10000",)), ("maxBytesPerBatch", BATCH_BYTES, ("67108864b", "67108864", "64MB", "64m"))):
        if conf.get(f"spark.sql.execution.arrow.{key}") in usual:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory(always=True)

    return df.mapInArrow(work if keep else tidy, schema)


def slices(batch: object, rows: int = 500, most: int = 2_000_000) -> Iterator:
    """Slices of an Arrow batch of at most ``rows`` rows and about ``most`` bytes."""
    each = max(1, min(rows, most * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for k in range(0, batch.num_rows, each):
        yield batch.slice(k, each)


def summed(parts: DataFrame, kind: str, tasks: int | None = None) -> bytes:
    """Element-wise sums of the vectors ``v`` (bytes of numpy's ``kind``) of each ``strip``, joined in the order of strips.

    ``parts`` (strip int, v binary) has a row for each strip and task; unless
    there are 512 ``tasks`` at most, tasks are added up in groups of 512 first, so
    that no worker gets those of all tasks.
    """
    import numpy as np

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, kind) for v in table.column("v").to_pylist())
        return pa.table({"strip": table.column("strip").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    schema = "strip int, v binary"
    if tasks is None or tasks > 512:
        parts = parts.withColumn("task", F.expr("spark_partition_id() div 512")).groupBy("strip", "task").applyInArrow(lambda t: add(t.drop_columns("task")), schema)
    rows = parts.groupBy("strip").applyInArrow(add, schema).collect()
    return b"".join(bytes(r["v"]) for r in sorted(rows, key=lambda r: r["strip"]))
