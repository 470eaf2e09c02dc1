"""Points at which lineage is cut, in a folder that all executors share; and reproducible draws."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read again.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a
    local one, but only if the executors run on this machine, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomframe-"))
        folder = sc.getCheckpointDir()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def uncut(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for ``tables``; nothing that is read later may need them."""
    for df in tables:
        path = getattr(df, "_lf_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from a digest of the parts: the same wherever and whenever it is drawn."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


#: The same as SQL, of an expression that gives the parts joined by colons.
UNIT_SQL = "(('0x' || substr(md5({0}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
