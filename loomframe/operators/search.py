"""Search of hyper-parameters: which trials go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rungs(grace: int, factor: int, last: int) -> list[int]:
    """The epochs at which trials are compared: grace, grace * factor, ... up to ``last``."""
    out = []
    while grace <= last:
        out.append(grace)
        grace *= factor
    return out


def successive_halving(history: DataFrame, grace: int = 1, factor: int = 3, last: int = 81, trial: str = "params", epoch: str = "epoch", loss: str = "value") -> DataFrame:
    """(trial, rung, best, promoted): what each trial had reached at the last rung that it came to.

    Of the trials that come to a rung, the ``1 / factor`` (rounded up) with the
    least loss so far go on to the next; ties by name. ``promoted`` tells whether
    the trial passed its last rung, too.
    """
    alive, out = history.select(trial).distinct(), None
    for k, at in enumerate(rungs(grace, factor, last)):
        seen = history.join(alive, trial).filter(F.col(epoch) <= at)
        best = seen.groupBy(trial).agg(F.min(loss).alias("best"), F.max(epoch).alias("_e")).filter(F.col("_e") >= at).drop("_e")
        place = F.row_number().over(Window.orderBy("best", trial))  # trials, which are few
        ranked = best.withColumn("_p", place).withColumn("promoted", F.col("_p") <= F.ceil(F.count("*").over(Window.partitionBy()) / factor))
        here = ranked.select(trial, F.lit(at).alias("rung"), "best", "promoted")
        out = here if out is None else out.unionByName(here)
        alive = here.filter("promoted").select(trial)
    latest = F.row_number().over(Window.partitionBy(trial).orderBy(F.col("rung").desc()))
    return out.withColumn("_l", latest).filter("_l = 1").drop("_l")
