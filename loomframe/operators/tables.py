"""Aggregates, windows and sorts on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(rows, columns, n) for every combination of the two labels, zeros included."""
    names = df.select(rows).distinct().crossJoin(F.broadcast(df.select(columns).distinct()))  # labels, not rows
    return names.join(df.groupBy(rows, columns).agg(F.count("*").alias("n")), [rows, columns], "left").na.fill(0, ["n"])


def pivot_sum(df: DataFrame, rows: str, columns: str, values: Sequence, value: Column) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.sum(value)).na.fill(0)


def shares(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(*by, label, n, share): counts and their part of the group's total."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def dominant(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent labels of each group, ties kept."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.col("n").desc()))).filter("_r = 1").drop("_r")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each group: the first in an order that leaves no ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def last_value(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, last): the last value that isn't null; infinity where there is none."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(by).agg(F.coalesce(last, F.lit(float("inf"))).alias("last"))


def mean_of_present(*columns: str) -> Column:
    """The mean of the columns that aren't null."""
    got = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(got))


def percent_of_total(df: DataFrame, col: str, out: str) -> DataFrame:
    """100 * n / total; null where the total is 0."""
    total = df.agg(F.sum(col).alias("_t"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.when(F.col("_t") != 0, 100 * F.col(col) / F.col("_t"))).drop("_t")  # one row


def average_rank(value: Sequence, by: Sequence[str]) -> Column:
    """Ranks from 1, equals share the mean of theirs."""
    order = Window.partitionBy(*by).orderBy(*value)
    peers = Window.partitionBy(*by, *value)
    return F.rank().over(order) + (F.count("*").over(peers) - 1) / 2


def min_rank(col: str, descending: bool = False) -> Column:
    """Competition rank over all rows; for tables of runs or groups. Null values aren't ranked."""
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    return F.when(F.col(col).isNotNull(), F.rank().over(Window.orderBy(order)))


def rank_runs(runs: DataFrame, losses: dict[str, tuple[float, bool]], key: str = "params") -> DataFrame:
    """``losses``: column -> (weight, whether larger is better). Adds ranks, ``score`` and ``position`` (from 1; the key breaks ties)."""
    out = runs
    for c, (_, down) in losses.items():
        out = out.withColumn(f"rank_{c}", min_rank(c, down))
    score = sum((F.col(f"rank_{c}") * w for c, (w, _) in losses.items()), F.lit(0.0))
    out = out.withColumn("score", score)
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.round("score", 9).asc_nulls_last(), key)))


def leading_count(df: DataFrame, by: Sequence[str], index: str, sd: str, last: int = 10, factor: float = 1.5) -> DataFrame:
    """(*by, threshold, n): how many of the first values stand before the first below ``factor`` times the mean of the last ones."""
    w = Window.partitionBy(*by)
    tail = F.avg(F.when(F.col(index) > F.col("_n") - last, F.col(sd))).over(w) * factor
    marked = df.withColumn("_n", F.max(index).over(w)).withColumn("threshold", tail)
    return marked.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.coalesce(F.min(F.when(F.col(sd) < F.col("threshold"), F.col(index))) - 1, F.max("_n")).alias("n"))


def shortest_interval(df: DataFrame, by: Sequence[str], value: str, mass: float = 0.95) -> DataFrame:
    """(*by, low, high): of the intervals between sorted values that hold floor(mass * n) steps, the shortest, the first of equals."""
    order = Window.partitionBy(*by).orderBy(value)
    placed = df.select(*by, F.col(value).alias("low"), F.row_number().over(order).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    step = F.floor(F.col("_n") * mass)
    far = placed.select(*by, F.col("low").alias("high"), F.col("_i").alias("_j"))
    both = placed.withColumn("_j", F.col("_i") + step).join(far, [*by, "_j"])
    return first_by(both, by, [F.round(F.col("high") - F.col("low"), 9), "_i"]).select(*by, "low", "high")


def crossings(grid: DataFrame, by: Sequence[str], x: str, a: str, b: str) -> DataFrame:
    """Grid points after which the sign of a - b changes."""
    s = F.signum(F.col(a) - F.col(b))
    nxt = F.lead(s).over(Window.partitionBy(*by).orderBy(x))
    return grid.withColumn("_d", nxt - s).filter("_d <> 0").drop("_d")


def extremes(df: DataFrame, by: str, value: str, name: str, n: int) -> DataFrame:
    """The ``n`` largest and ``n`` smallest values of each group, with ``side``."""
    top = Window.partitionBy(by).orderBy(F.col(value).desc(), name)
    low = Window.partitionBy(by).orderBy(F.col(value).asc(), name)
    ranked = lambda w, side: df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).withColumn("side", F.lit(side))
    return ranked(top, "top").unionByName(ranked(low, "bottom"))
