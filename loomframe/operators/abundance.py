"""Counts of neighbourhoods by sample: negative-binomial regressions with shrunken dispersions, and false discovery rates weighted by the graph."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.distribution import two_sided_p
from loomframe.functions.shared import cut, uncut
from loomframe.functions.shipping import ships

ships(__name__)

#: Dispersions at which the likelihood is known: evenly spaced logarithms.
GRID = [10 ** (-4 + k / 8) for k in range(41)]
#: Samples of a design; it is held by the driver and by each task.
MOST_SAMPLES = 10_000
#: Numbers of a matrix that a task has at once (neighbourhoods x samples).
CHUNK = 1 << 20
#: Rounds of reweighted least squares; a fit stops when no coefficient moves by more than 1e-10.
ROUNDS = 60
#: Penalty of the squared coefficients other than the constant, which keeps fits to groups without any count finite.
RIDGE = 1e-3


def fit(y, x, offset, dispersion, start=None):
    """(coefficients, means, information): rows of counts ``y`` on the design ``x``, log link, with a dispersion for each row.

    Rows without a count get coefficients of 0 and means of 0.
    """
    import numpy as np

    y, dispersion = np.asarray(y, float), np.asarray(dispersion, float)[:, None]
    some = y.sum(1) > 0
    penalty = np.diag([0.0] + [RIDGE] * (x.shape[1] - 1))
    if start is None:
        start = np.zeros((len(y), x.shape[1]))
        start[:, 0] = np.log(np.maximum(y.sum(1), 1e-300) / np.exp(offset).sum())
    beta, live = np.where(some[:, None], start, 0.0), np.flatnonzero(some)

    def weigh(rows):
        mu = np.exp(np.clip(offset + beta[rows] @ x.T, -60, 60))
        w = mu / (1 + dispersion[rows] * mu)
        return mu, w, np.einsum("bs,sp,sq->bpq", w, x, x) + penalty

    for _ in range(ROUNDS):
        if not len(live):
            break
        mu, w, info = weigh(live)
        slope = (w * (y[live] - mu) / mu) @ x - beta[live] @ penalty
        step = np.clip(np.linalg.solve(info, slope[..., None])[..., 0], -3, 3)
        beta[live] += step
        live = live[np.abs(step).max(1) > 1e-10]
    mu, _, info = weigh(np.arange(len(y)))
    return beta, np.where(some[:, None], mu, 0.0), info


def likelihood(y, mu, dispersion):
    """The log likelihood of each row, without what depends on the counts alone."""
    import numpy as np

    size = 1 / np.asarray(dispersion, float)
    total = np.zeros(len(y))
    for value in np.unique(y[y > 0]):  # log Gamma(value + size) / Gamma(size), once for each different pair
        sizes, of = np.unique(size, return_inverse=True)
        rising = np.array([math.lgamma(value + r) - math.lgamma(r) - value * math.log(r) for r in sizes])
        total += rising[of] * (y == value).sum(1)
    logs = np.where(y > 0, y * np.log(np.maximum(mu, 1e-300)), 0.0)
    return total + (logs - (y + size[:, None]) * np.log1p(mu / size[:, None])).sum(1)


def profile(y, x, offset):
    """Each row's likelihood at each dispersion of ``GRID``, adjusted for the coefficients (Cox and Reid)."""
    import numpy as np

    out, beta = np.zeros((len(y), len(GRID))), None
    for k, d in enumerate(GRID):
        beta, mu, info = fit(y, x, offset, np.full(len(y), d), beta)
        out[:, k] = likelihood(y, mu, np.full(len(y), d)) - np.linalg.slogdet(info)[1] / 2
    out[y.sum(1) == 0] = 0.0
    return out


def peak(curve):
    """The dispersion at the top of each row of ``curve``: the best of the grid, moved to the vertex of a parabola within it."""
    import numpy as np

    at, logs = curve.argmax(1), np.log(GRID)
    inner = np.clip(at, 1, len(GRID) - 2)
    rows = np.arange(len(curve))
    a, b, c = curve[rows, inner - 1], curve[rows, inner], curve[rows, inner + 1]
    bend = a - 2 * b + c
    move = np.where((at == inner) & (bend < 0), (a - c) / np.where(bend < 0, 2 * bend, 1.0), 0.0)
    return np.exp(logs[at] + move * (logs[1] - logs[0]))


def abundance_regression(counts: DataFrame, samples: DataFrame, tested: str, covariates: Sequence[str] = (), prior_df: float = 10.0, nhood: str = "nhood", sample: str = "sample", size: str = "size") -> DataFrame:
    """(nhood, log_fc, z, dispersion, p): the effect of the column ``tested`` on a neighbourhood's counts by sample.

    ``counts`` has (nhood, sample, n), where absent and null n are 0 and
    repeated rows are added up; ``samples`` has a row for each sample with its
    ``size`` (above 0), and numeric columns ``tested`` and ``covariates``. Counts of samples that ``samples``
    doesn't have are left out, and samples with a null are, too.

    Each neighbourhood has a negative-binomial regression with its samples'
    sizes as offsets, found by reweighted least squares. Its dispersion is at the
    top of its own adjusted profile likelihood plus the mean one of all
    neighbourhoods, which counts for ``prior_df`` degrees of freedom. z is the
    signed root of the likelihood ratio without ``tested``; p is two-sided. Neighbourhoods without a count have log_fc 0 and p 1.

    Counts meet once, in one row for each neighbourhood that is as long as it has
    samples. The design of at most ``MOST_SAMPLES`` samples is collected and sent
    to the tasks; so is the mean likelihood, ``len(GRID)`` numbers. Not a
    table: an error, if the samples are more, or fewer than the coefficients + 1,
    or if ``tested`` can't be told from the other columns.
    """
    import numpy as np
    import pandas as pd

    columns = [*covariates, tested]
    whole = samples.select(sample, F.col(size).cast("double").alias("_size"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna().orderBy(sample).limit(MOST_SAMPLES + 1).collect()
    if len(whole) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    x = np.array([[1.0, *r[2:]] for r in whole]).reshape(len(whole), len(columns) + 1)
    if len(whole) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("too few samples for the design, or columns that depend on each other")
    if any(r["_size"] <= 0 for r in whole) or len({r[0] for r in whole}) < len(whole):
        raise ValueError("samples need sizes above 0 and different names")
    offset = np.log([r["_size"] for r in whole])
    share, last = prior_df / (len(whole) - x.shape[1]), len(whole)
    spark, kind, name = counts.sparkSession, counts.schema[nhood].dataType.simpleString(), samples.schema[sample].dataType.simpleString()
    places = F.broadcast(spark.createDataFrame([(r[0], i) for i, r in enumerate(whole)], f"`{sample}` {name}, _at int"))  # at most MOST_SAMPLES
    known = counts.select(nhood, sample, F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("n")).join(places, sample, "left")
    summed = known.groupBy(F.col(nhood).alias("nhood"), "_at").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("nhood").agg(F.collect_list(F.when(F.col("_at").isNotNull() & (F.col("n") > 0), F.struct("_at", "n"))).alias("cells"))
    lists = lists.select("nhood", F.col("cells._at").alias("at"), F.col("cells.n").alias("n"))

    def dense(frame):
        step = max(1, CHUNK // last)
        for k in range(0, len(frame), step):
            part = frame.iloc[k : k + step]
            y = np.zeros((len(part), last))
            for row, (at, n) in enumerate(zip(part["at"], part["n"], strict=True)):
                y[row, np.asarray(at, int)] = n
            yield part, y

    def curves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, y in dense(frame):
                yield pd.DataFrame({"nhood": part["nhood"], "at": part["at"], "n": part["n"], "curve": list(profile(y, x, offset))})

    known = cut(lists.mapInPandas(curves, f"nhood {kind}, at array<int>, n array<double>, curve array<double>"))
    # neighbourhoods without a count say nothing about dispersions
    mean = known.filter(F.size("at") > 0).agg(*[F.avg(F.col("curve")[k]).alias(f"m{k}") for k in range(len(GRID))]).first()
    common = np.array([v or 0.0 for v in mean])

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, y in dense(frame):
                d = peak(np.stack(part["curve"].to_numpy()) + share * common)
                beta, mu, _ = fit(y, x, offset, d)
                _, without, _ = fit(y, x[:, :-1], offset, d)
                ratio = 2 * (likelihood(y, mu, d) - likelihood(y, without, d))
                z = np.where(y.sum(1) > 0, np.sign(beta[:, -1]) * np.sqrt(np.maximum(ratio, 0.0)), 0.0)
                yield pd.DataFrame({"nhood": part["nhood"], "log_fc": beta[:, -1], "z": z, "dispersion": d})

    out = known.select("nhood", "at", "n", "curve").mapInPandas(test, f"nhood {kind}, log_fc double, z double, dispersion double")
    done = cut(out.withColumn("p", two_sided_p("z")).withColumnRenamed("nhood", nhood))
    uncut(known)
    return done


def overlap_weights(members: DataFrame, nhood: str = "nhood", key: str = "vec_id") -> DataFrame:
    """(nhood, weight): 1 over the neighbourhoods that a neighbourhood's average cell is in, itself included.

    Neighbourhoods that share all cells weigh as one together. It takes the
    cells' numbers of neighbourhoods, no pairs of neighbourhoods. Nulls and
    repeated memberships don't count.
    """
    pairs = members.select(F.col(nhood).alias("nhood"), F.col(key).alias("_key")).dropna().distinct()
    often = pairs.groupBy("_key").agg(F.count("*").alias("_often"))
    return pairs.join(often, "_key").groupBy("nhood").agg((F.count("*") / F.sum("_often")).alias("weight")).withColumnRenamed("nhood", nhood)


def distance_weights(members: DataFrame, nhood: str = "nhood", dist: str = "dist") -> DataFrame:
    """(nhood, weight): 1 over the distance of the farthest member; 0 where that is 0, null or not finite."""
    far = F.max(F.when(~F.isnan(dist), F.col(dist)))
    out = members.groupBy(nhood).agg(far.alias("_far"))
    fine = (F.col("_far") > 0) & (F.col("_far") < float("inf"))
    return out.select(nhood, F.when(fine, 1 / F.col("_far")).otherwise(0.0).alias("weight"))


def weighted_fdr(df: DataFrame, p: str = "p", weight: str = "weight", out: str = "fdr") -> DataFrame:
    """``df`` with ``out``: the least of p times the sum of all weights over the weights up to p, of this and all larger p, at most 1.

    With equal weights this is the Benjamini-Hochberg adjustment. Rows whose p is
    null or NaN get null and don't count; null weights are 0. Where no weight is
    up to a p, or all are 0, it is 1.

    Different p are put in order within some 5,000 ranges (a thousandth of [0, 1],
    and of each power of ten below), and only the ranges' totals in one task; equal p are added up first.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    levels = df.filter(valid).groupBy(F.col(p).cast("double").alias("_p")).agg(F.sum(F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("_w"))
    power = F.when(F.col("_p") >= 0.001, 0).otherwise(F.least(F.lit(320), -F.floor(F.log10(F.greatest("_p", F.lit(1e-320))))))
    within = F.floor(F.col("_p") * F.when(F.col("_power") == 0, 1000.0).otherwise(F.lit(10.0) * F.pow(F.lit(10.0), F.least(F.col("_power"), F.lit(300)))))
    levels = cut(levels.withColumn("_power", power.cast("int")).withColumn("_in", within.cast("long")))
    place = ["_power", "_in"]
    ahead = Window.partitionBy().orderBy(F.col("_power").desc(), "_in")  # of ranges only
    ranges = levels.groupBy(*place).agg(F.sum("_w").alias("_sum")).withColumn("_before", F.sum("_sum").over(ahead) - F.col("_sum")).withColumn("_all", F.sum("_sum").over(Window.partitionBy()))
    up = Window.partitionBy(*place).orderBy("_p")
    raw = levels.join(ranges.drop("_sum"), place).withColumn("_to", F.col("_before") + F.sum("_w").over(up))
    raw = cut(raw.select("_p", *place, F.when(F.col("_to") > 0, F.col("_p") * F.col("_all") / F.col("_to")).otherwise(1.0).alias("_raw")))
    behind = Window.partitionBy().orderBy(F.col("_power").asc(), F.col("_in").desc()).rowsBetween(Window.unboundedPreceding, -1)  # of ranges only
    later = raw.groupBy(*place).agg(F.min("_raw").alias("_least")).withColumn("_later", F.min("_least").over(behind)).drop("_least")
    down = Window.partitionBy(*place).orderBy(F.col("_p").desc())
    fdr = raw.join(later, place).select("_p", F.least(F.lit(1.0), F.min("_raw").over(down), F.coalesce("_later", F.lit(1.0))).alias(out))
    return df.join(fdr, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")
