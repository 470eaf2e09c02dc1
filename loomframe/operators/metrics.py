"""How well batches are mixed and labels kept: regression on components, isolated labels, k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.vectors import agreement, label_means


def pc_regression(df: DataFrame, batch: str, vec: str = "vec") -> DataFrame:
    """One row (pcr): the share of the components' variance that a categorical column explains.

    Each component's share is the sum of squares between the batches over the
    total one; components weigh by their variance.
    """
    long = df.select(batch, F.posexplode(vec).alias("dim", "x"))
    per = long.groupBy("dim", batch).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dims = per.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("within"))
    mean = F.col("s") * F.col("s") / F.col("n")
    # a component's variance times its share is its sum of squares between the batches, over n - 1
    return dims.agg((F.sum((F.col("within") - mean) / (F.col("n") - 1)) / F.sum((F.col("q") - mean) / (F.col("n") - 1))).alias("pcr"))


def pcr_comparison(before: DataFrame, after: DataFrame, batch: str, vec: str = "vec") -> DataFrame:
    """One row (before, after, score): how much less the batches explain after integration, at least 0."""
    both = pc_regression(before, batch, vec).select(F.col("pcr").alias("before")).crossJoin(pc_regression(after, batch, vec).select(F.col("pcr").alias("after")))  # one row each
    return both.withColumn("score", F.greatest((F.col("before") - F.col("after")) / F.col("before"), F.lit(0.0)))


def isolated_labels(df: DataFrame, label: str, batch: str, most: int | None = None) -> DataFrame:
    """(label, batches): the labels that stand in the fewest batches, or in ``most`` at most."""
    n = df.groupBy(label).agg(F.count_distinct(batch).alias("batches"))
    return n.filter(F.col("batches") <= most) if most is not None else n.join(n.agg(F.min("batches").alias("least")), F.col("batches") == F.col("least")).drop("least")


def isolated_widths(df: DataFrame, label: str, batch: str, most: int | None = None, vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(label, score): the mean silhouette of each isolated label against all others together, in [0, 1]."""
    size = df.groupBy(F.col(label).alias("lb")).agg(F.count("*").alias("n"))
    named = df.select(key, label).join(isolated_labels(df, label, batch, most).select(label), label)  # labels are few
    means = label_means(df, label, vec, key).join(F.broadcast(size), "lb").join(named, key)
    other = F.col("lb") != F.col(label)
    per = means.groupBy(label, key).agg(F.max(F.when(~other, F.col("m"))).alias("a"), (F.sum(F.when(other, F.col("m") * F.col("n"))) / F.sum(F.when(other, F.col("n")))).alias("b"))
    width = F.when(F.col("b").isNull(), F.lit(None).cast("double")).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy(label).agg(((F.avg(width) + 1) / 2).alias("score"))


def kmeans_agreement(df: DataFrame, label: str, k: int | None = None, seed: int = 1, vec: str = "vec") -> DataFrame:
    """One row (ari, nmi) of the labels and as many k-means clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = k or df.select(label).distinct().count()
    data = df.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    found = KMeans(k=max(2, k), seed=seed, predictionCol="cluster").fit(data).transform(data)
    return agreement(found, label, "cluster")
