"""Exact order statistics and quantiles of all groups at once, without a sort or a buffer of values.

A wanted value is narrowed down digit by digit: the range that still holds it is
cut into bins, the rows of each bin are counted (and their least and largest value
taken) in every partition before anything is shuffled, and the bin that holds the
rank is the next range. Bins are of any monotone function of the values, so ranges
are exact: their ends are values of the table. A round sees each row once, whatever
the number of ranks. Ranges of at most ``FEW`` rows are sorted in the end; a group
may have any number of rows.

Null and NaN values don't count. Negative zero is zero. Null keys are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.shared import cut

#: Bins of a range.
BINS = 1024
#: Rows of a range that are sorted rather than cut again.
FEW = 1000


def _digit(x: Column, lo: Column, hi: Column) -> Column:
    """The bin of ``x`` in [lo, hi]: by sign, then by logarithms where the ends are far apart, then evenly."""
    inf, part = F.lit(float("inf")), lambda a, b: F.floor(a / b * BINS).cast("double")
    return (
        F.when((lo <= 0) & (hi >= 0), F.signum(x))
        .when(hi == inf, (x == inf).cast("double"))
        .when(lo == -inf, (x > lo).cast("double"))
        .when((lo > 0) & (hi / 16 > lo), part(F.log(x) - F.log(lo), F.log(hi) - F.log(lo)))
        .when((hi < 0) & (lo / 16 < hi), -part(F.log(-x) - F.log(-hi), F.log(-lo) - F.log(-hi)))
        .otherwise(part(x - lo, hi - lo))
    )


def _values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.select(F.struct(*by, F.lit(0).alias("_one")).alias("k"), (x + 0.0).alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))


def _select(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, rank, x): of ``values`` (k, x), the value at each rank from 0 of ``wanted`` (k, rank, n, lo, hi); ranks are within n."""
    ranges = wanted.select("k", "rank", F.col("rank").alias("left"), "lo", "hi", "n")
    done = None
    while True:
        ranges = cut(ranges)
        if ranges.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW)).isEmpty():
            break
        narrow = ranges.filter((F.col("lo") >= F.col("hi")) | (F.col("n") <= FEW))
        done = narrow if done is None else done.unionByName(narrow)
        ranges = ranges.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        # ranges of a group are the same or apart, so a row is in one of them at most
        each = ranges.select("k", "lo", "hi").distinct()
        inside = values.join(each, "k").filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        bins = inside.groupBy("k", "lo", "hi", _digit(F.col("x"), F.col("lo"), F.col("hi")).alias("digit")).agg(F.count("*").alias("m"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = bins.withColumn("upto", F.sum("m").over(Window.partitionBy("k", "lo", "hi").orderBy("digit")))  # a row for each bin
        met = ranges.drop("n").join(upto, ["k", "lo", "hi"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("m")))
        ranges = met.select("k", "rank", (F.col("left") - F.col("upto") + F.col("m")).alias("left"), F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("m").alias("n"))
    ranges = ranges if done is None else done.unionByName(ranges)
    same = ranges.filter("lo >= hi").select("k", "rank", F.col("lo").alias("x"))
    short = ranges.filter("lo < hi")
    inside = values.join(short.select("k", "lo", "hi").distinct(), "k").filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    sorted_ = inside.groupBy("k", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("v"))  # FEW at most
    found = short.join(sorted_, ["k", "lo", "hi"]).select("k", "rank", F.element_at("v", (F.col("left") + 1).cast("int")).alias("x"))
    return same.unionByName(found)


def kth(df: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """(*by, rank, x): the value at each rank from 0 that ``wanted`` (*by, rank) asks for; ranks beyond the group give no row."""
    values = cut(_values(df, by, value))
    ends = values.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    asked = wanted.select(F.struct(*by, F.lit(0).alias("_one")).alias("k"), F.col("rank").cast("long").alias("rank")).distinct()
    out = _select(values, asked.join(ends, "k").filter("rank >= 0 AND rank < n"))
    return out.select(*[F.col("k")[b].alias(b) for b in by], "rank", "x")


def places(n: Column, q: float) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, share of the upper one) of the quantile ``q`` of ``n`` values."""
    h = (n - 1) * F.lit(float(q))
    low = F.floor(h)
    return low, F.least(low + 1, n - 1), h - low


def between(low: Column, high: Column, share: Column) -> Column:
    """The quantile between two neighbouring values."""
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], sizes: DataFrame | None = None) -> DataFrame:
    """(*by, n, q array): exact quantiles, linear between neighbours; groups without a value give no row.

    With ``sizes`` (some columns of ``by``, size), a group has ``size`` values, of
    which all that aren't in ``df`` are zeros; the values of ``df`` are positive then.
    """
    values = cut(_values(df, by, value))
    ends = values.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    if sizes is None:
        ends = ends.withColumn("zeros", F.lit(0).cast("long"))
    else:
        on = [F.col(f"k.{c}").eqNullSafe(sizes[c]) for c in sizes.columns if c != "size"]
        ends = (ends.join(sizes, on) if on else ends.crossJoin(sizes)).select("k", "n", "lo", "hi", (F.col("size") - F.col("n")).alias("zeros"))  # one size without keys
    ends = cut(ends)
    all_ = F.col("n") + F.col("zeros")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(*places(all_, q)[:2]) for q in qs])))
    asked = ends.withColumn("rank", F.explode(ranks)).withColumn("rank", F.col("rank") - F.col("zeros")).filter("rank >= 0").drop("zeros")
    found = _select(values, asked)
    at = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two for each quantile

    def one(q: float) -> Column:
        low, high, share = places(all_, q)
        x = lambda rank: F.when(rank < F.col("zeros"), 0.0).otherwise(F.element_at("at", rank - F.col("zeros")))
        return between(x(low), x(high), share)

    return ends.join(at, "k", "left").select(*[F.col("k")[b].alias(b) for b in by], all_.alias("n"), F.array(*map(one, qs)).alias("q"))
