"""Differential abundance in neighbourhoods, by a negative-binomial Wald test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_sample(members: DataFrame, cells: DataFrame, nhood: str = "nhood", key: str = "vec_id", sample: str = "sample") -> DataFrame:
    """(nhood, sample, n) for each neighbourhood and sample, zeros included."""
    seen = members.join(cells.select(key, sample), key).groupBy(nhood, sample).agg(F.count("*").alias("n"))
    grid = members.select(nhood).distinct().crossJoin(F.broadcast(cells.select(sample).distinct()))  # samples are few
    return grid.join(seen, [nhood, sample], "left").na.fill(0, ["n"])


def abundance_test(counts: DataFrame, samples: DataFrame, nhood: str = "nhood", sample: str = "sample", condition: str = "condition", pseudo: float = 0.5) -> DataFrame:
    """(nhood, log_fc, z, dispersion): condition 1 against 0 (``samples``: sample, size, condition).

    Counts are negative binomial with means proportional to the samples' sizes,
    and one dispersion for all neighbourhoods, the mean of the moment
    estimates (at least 0). z is the log fold change over its standard error.
    """
    rows = counts.join(F.broadcast(samples.select(sample, "size", F.col(condition).cast("int").alias("c"))), sample)
    per = rows.groupBy(nhood, "c").agg(F.sum("n").alias("y"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("square"))
    per = per.withColumn("rate", (F.col("y") + pseudo) / F.col("size"))
    fitted = rows.join(per.select(nhood, "c", "rate"), [nhood, "c"]).withColumn("mu", F.col("rate") * F.col("size"))
    each = fitted.groupBy(nhood).agg((F.sum((F.col("n") - F.col("mu")) * (F.col("n") - F.col("mu")) - F.col("mu")) / F.sum(F.col("mu") * F.col("mu"))).alias("d"))
    common = each.agg(F.greatest(F.avg("d"), F.lit(0.0)).alias("dispersion"))
    spread = 1 / (F.col("rate") * F.col("size")) + F.col("dispersion") * F.col("square") / (F.col("size") * F.col("size"))
    both = per.crossJoin(F.broadcast(common)).withColumn("v", spread)  # one row
    of = lambda c, k: F.max(F.when(F.col("c") == k, F.col(c)))
    return both.groupBy(nhood, "dispersion").agg((F.log(of("rate", 1)) - F.log(of("rate", 0))).alias("log_fc"), (of("v", 1) + of("v", 0)).alias("v")).select(nhood, "log_fc", (F.col("log_fc") / F.sqrt("v")).alias("z"), "dispersion")
