"""Doublet scores: two-component mixtures, thresholds, calls and simulated scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.distribution import restore_score, transform_score
from loomframe.functions.shipping import ships

ships(__name__)

_FIT = "mean_1 double, sd_1 double, weight_1 double, mean_2 double, sd_2 double, weight_2 double, lo double, hi double, n long"


def fit_mixtures(df: DataFrame, by: str, score: str, how: str = "logit", rounds: int = 200) -> DataFrame:
    """(by, parameters of both components by rising mean, range and number of the transformed scores) for each group.

    Expectation-maximisation of all groups together, started at the 20 % quantile
    and the median of the top twentieth. Each round is one pass: every row's
    responsibilities are columns, their sums (and those with the scores and their
    squares, about the group's mean) are added up in Spark, and only a row for
    each group reaches the driver. A group rests once its mean log-likelihood
    gains less than 1e-6. Groups of fewer than ten scores give no row; null
    scores don't count.
    """
    from loomframe.functions.shared import cut
    from loomframe.operators.orderstats import quantiles

    spark, kind = df.sparkSession, df.schema[by].dataType.simpleString()
    t = cut(df.filter(F.col(score).isNotNull()).select(F.col(by).alias("g"), transform_score(F.col(score), how).alias("y")))
    ends = quantiles(t, ["g"], "y", [0.0, 0.2, 0.95, 1.0]).filter("n >= 10")
    same = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
    top = t.alias("t").join(ends.alias("e"), same("t", "e")).filter("y >= q[2]").select("t.g", "y")
    moments = t.groupBy("g").agg(F.avg("y").alias("mean"), F.var_pop("y").alias("var"))
    first = ends.alias("e").join(quantiles(top, ["g"], "y", [0.5]).select("g", F.element_at("q", 1).alias("high")).alias("h"), same("e", "h")).join(moments.alias("m"), same("e", "m"))
    state = {}
    for r in first.select("e.g", "n", "q", "high", "mean", "var").collect():  # a row for each group
        state[r["g"]] = {"n": r["n"], "lo": r["q"][0], "hi": r["q"][3], "about": r["mean"], "mean": [r["q"][1], r["high"]], "var": [r["var"] + 1e-6] * 2, "weight": [0.5, 0.5], "before": -math.inf}
    going = set(state)
    for _ in range(rounds):
        if not going:
            break
        for r in _sums(t, spark.createDataFrame([(g, state[g]["about"], *state[g]["mean"], *state[g]["var"], *state[g]["weight"]) for g in going], f"g {kind}, c double, m1 double, m2 double, v1 double, v2 double, w1 double, w2 double")).collect():
            s = state[r["g"]]
            for k in (0, 1):
                n = r[f"r{k + 1}"] + 1e-12
                away = r[f"a{k + 1}"] / n
                # about the new mean, which is (almost) c + away
                s["mean"][k] = (r[f"a{k + 1}"] + s["about"] * r[f"r{k + 1}"]) / n
                step = s["mean"][k] - s["about"]
                s["var"][k] = (r[f"q{k + 1}"] - 2 * step * r[f"a{k + 1}"] + step * step * r[f"r{k + 1}"]) / n + 1e-6
                s["weight"][k] = n / s["n"]
            now = r["ll"] / s["n"]
            if now - s["before"] < 1e-6:
                going.discard(r["g"])
            s["before"] = now
    rows = []
    for g, s in state.items():
        parts = sorted(zip(s["mean"], s["var"], s["weight"], strict=True))
        rows.append((g, *[float(x) for m, v, w in parts for x in (m, math.sqrt(v), w)], s["lo"], s["hi"], s["n"]))
    return spark.createDataFrame(rows, f"{by} {kind}, {_FIT}")


def _sums(t: DataFrame, now: DataFrame) -> DataFrame:
    """For each group: responsibilities (r), with the distance to ``c`` (a) and its square (q), and the log-likelihood."""
    density = lambda k: F.col(f"w{k}") * F.exp(-((F.col("y") - F.col(f"m{k}")) ** 2) / (2 * F.col(f"v{k}"))) / F.sqrt(2 * math.pi * F.col(f"v{k}"))
    rows = t.alias("t").join(now.alias("p"), F.col("t.g").eqNullSafe(F.col("p.g"))).select("t.g", (F.col("y") - F.col("c")).alias("u"), density(1).alias("d1"), density(2).alias("d2"))
    rows = rows.withColumn("all", F.col("d1") + F.col("d2") + 1e-300)
    share = {k: F.col(f"d{k}") / F.col("all") for k in (1, 2)}
    sums = [F.sum(share[k] * x).alias(f"{name}{k}") for k in (1, 2) for name, x in (("r", F.lit(1.0)), ("a", F.col("u")), ("q", F.col("u") * F.col("u")))]
    return rows.groupBy("g").agg(*sums, F.sum(F.log("all")).alias("ll"))


def thresholds(fits: DataFrame, by: str, how: str = "logit", points: int = 500) -> DataFrame:
    """(by, threshold): where the weighted densities cross on a grid over the scores.

    Of several crossings, the one nearest to 0 in the transformed space; null
    where they don't cross.
    """
    from loomframe.functions.distribution import normal_pdf

    grid = fits.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    grid = grid.withColumn("x", x)
    grid = grid.withColumns({"a": F.col("weight_1") * normal_pdf(F.col("x"), F.col("mean_1"), F.col("sd_1")), "b": F.col("weight_2") * normal_pdf(F.col("x"), F.col("mean_2"), F.col("sd_2"))})
    from loomframe.operators.tables import crossings, first_by

    best = first_by(crossings(grid, [by], "x", "a", "b").select(by, "x", "i"), [by], [F.abs("x"), "i"])
    return fits.select(by).join(best.select(by, restore_score(F.col("x"), how).alias("threshold")), by, "left")


def call(df: DataFrame, limits: DataFrame, by: str, score: str, strict: bool = True) -> DataFrame:
    """``call``: doublet from the threshold on. A group without a threshold is an error, or is left out."""
    joined = df.join(F.broadcast(limits.filter("threshold IS NOT NULL")) if not strict else F.broadcast(limits), by)
    limit = F.when(F.col("threshold").isNull(), F.raise_error(F.concat(F.lit("no threshold for "), F.col(by).cast("string"))).cast("double")).otherwise(F.col("threshold")) if strict else F.col("threshold")
    return joined.withColumn("call", F.when(F.col(score) >= limit, "doublet").otherwise("singlet")).drop("threshold")


def expected(df: DataFrame, by: str, label: str, rate: float) -> DataFrame:
    """(by, n, homotypic, n_expected, n_adjusted): expected doublets, and those of unlike cells only."""
    n = df.groupBy(by, label).agg(F.count("*").alias("c"))
    out = n.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("homotypic"))
    return out.select(by, "n", "homotypic", F.round(rate * F.col("n")).cast("long").alias("n_expected"), F.round(rate * F.col("n") * (1 - F.col("homotypic"))).cast("long").alias("n_adjusted"))


def simulated_scores(df: DataFrame, k: int = 10, ratio: float = 1.0, rate: float = 0.06, seed: int = 0, vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(key, score): the posterior of being a doublet from the share of simulated pairs among the neighbours.

    Each vector is paired with the one that follows it in a random order; the
    mean of both is a simulated doublet.
    """
    from pyspark.sql import Window

    from loomframe.operators.vectors import nearest

    mixed = df.select(key, vec, F.xxhash64(key, F.lit(seed)).alias("h"))
    part = F.pmod("h", F.lit(64))
    mate = F.lead(vec).over(Window.partitionBy(part).orderBy("h"))
    pairs = mixed.withColumn("_m", mate).filter(F.col("_m").isNotNull() & (F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * ratio)))
    made = pairs.select((-F.col(key) - 1).alias(key), F.zip_with(vec, "_m", lambda a, b: (a + b) / 2).alias(vec))
    both = df.select(key, vec).unionByName(made)
    near = nearest(both, k, df.select(key, vec), vec, key)
    q = near.groupBy(F.col("src").alias(key)).agg((F.count_if(F.col("dst") < 0) + 1).alias("s"), (F.count("*") + 2).alias("n"))
    share = F.col("s") / F.col("n")
    return q.select(key, (share * rate / ratio / (1 - rate - share * (1 - rate - rate / ratio))).alias("score"))




def _simulated(df: DataFrame, share: float, seed: int, vec: str, key: str) -> DataFrame:
    """Means of pairs of vectors, with negative keys, so many that they are ``share`` of all."""
    from pyspark.sql import Window

    from loomframe.functions.shared import unit

    ratio = share / (1 - share)
    rounds = -(-int(1000 * ratio) // 1000) or 1
    out = None
    for k in range(rounds):
        h = F.xxhash64(key, F.lit(seed + k))
        mixed = df.select(key, vec, h.alias("h")).withColumn("_m", F.lead(vec).over(Window.partitionBy(F.pmod("h", F.lit(64))).orderBy("h", key)))
        made = mixed.filter(F.col("_m").isNotNull() & (unit(key, F.lit(seed + k)) < ratio / rounds))
        made = made.select((-(F.col(key) * rounds + k) - 1).alias(key), F.zip_with(vec, "_m", lambda a, b: (a + b) / 2).alias(vec))
        out = made if out is None else out.unionByName(made)
    return out


def neighbour_shares(df: DataFrame, share: float = 0.25, pks: tuple[float, ...] = (0.005, 0.01, 0.03, 0.09), seed: int = 0, vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(pk, key, pann): the share of simulated doublets among a vector's pk * (real and simulated) nearest neighbours.

    The neighbours are counted, not told: they are a share of all vectors.
    """
    from loomframe.operators.vectors import neighbour_counts

    both = df.select(key, vec).unionByName(_simulated(df, share, seed, vec, key))
    n = both.count()
    sizes = [(pk, max(1, round(pk * n))) for pk in pks]
    near = neighbour_counts(both, [k for _, k in sizes], df.select(key, vec), vec, key)
    pk = F.explode(F.array(*[F.struct(F.lit(p).alias("pk"), F.lit(k).alias("k")) for p, k in sizes])).alias("s")
    return near.select("src", "k", "n", "negatives", pk).filter("k = s.k").select(F.col("s.pk").alias("pk"), F.col("src").alias(key), (F.col("negatives") / F.col("n")).alias("pann"))


def bimodality(shares: DataFrame, value: str = "pann") -> DataFrame:
    """(pk, bc): the bimodality coefficient of each pk's shares, (skewness^2 + 1) / (excess kurtosis + 3 (n - 1)^2 / ((n - 2) (n - 3)))."""
    n = F.col("n").cast("double")
    m = shares.groupBy("pk").agg(F.count("*").alias("n"), F.skewness(value).alias("g"), F.kurtosis(value).alias("h"))
    skew = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("h") + 6)
    return m.select("pk", ((skew * skew + 1) / (kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).alias("bc"))


def sweep(df: DataFrame, pns: tuple[float, ...] = (0.1, 0.2, 0.3), pks: tuple[float, ...] = (0.005, 0.01, 0.03, 0.09), vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(pk, mean, variance, metric, best): over the shares of simulated doublets, mean over variance of each pk's bimodality; the largest is best."""
    from pyspark.sql import Window

    every = None
    for k, pn in enumerate(pns):
        one = bimodality(neighbour_shares(df, pn, pks, 100 * k, vec, key))
        every = one if every is None else every.unionByName(one)
    m = every.groupBy("pk").agg(F.avg("bc").alias("mean"), F.var_samp("bc").alias("variance")).withColumn("metric", F.col("mean") / F.nullif(F.col("variance"), F.lit(0.0)))
    top = F.row_number().over(Window.orderBy(F.col("metric").desc_nulls_last(), "pk"))  # a row for each pk
    return m.withColumn("best", top == 1)


def valley(df: DataFrame, score: str, bins: int = 50, rounds: int = 200) -> float | None:
    """The least point between the two modes of the scores' histogram, which is smoothed until it has two; None if it never has.

    ``bins`` counts reach the driver.
    """
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if lo is None or hi <= lo:
        return None
    at = F.least(F.floor((F.col(score) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    h = [0.0] * bins
    for r in df.filter(F.col(score).isNotNull()).groupBy(at.alias("b")).count().collect():
        h[r["b"]] = float(r["count"])
    for _ in range(rounds):
        peaks = [i for i in range(bins) if (i == 0 or h[i] > h[i - 1]) and (i == bins - 1 or h[i] >= h[i + 1])]
        if len(peaks) == 2:
            low = min(range(peaks[0], peaks[1] + 1), key=lambda i: (h[i], i))
            return lo + (hi - lo) * (low + 0.5) / bins
        if len(peaks) < 2:
            return None
        h = [(h[max(0, i - 1)] + h[i] + h[min(bins - 1, i + 1)]) / 3 for i in range(bins)]
    return None


def simulated_threshold(df: DataFrame, k: int = 10, rate: float = 0.06, vec: str = "vec", key: str = "vec_id", seed: int = 0) -> tuple[DataFrame, float | None]:
    """((key, score, call), threshold): scores against simulated doublets, cut in the valley of the scores of the simulated ones."""
    from loomframe.functions.shared import cut
    from loomframe.operators.vectors import nearest

    both = cut(df.select(key, vec).unionByName(_simulated(df, 0.5, seed, vec, key)))
    near = nearest(both, k, None, vec, key)
    q = near.groupBy(F.col("src").alias(key)).agg((F.count_if(F.col("dst") < 0) + 1).alias("s"), (F.count("*") + 2).alias("n"))
    share = F.col("s") / F.col("n")
    scored = cut(q.select(key, (share * rate / (1 - rate - share * (1 - 2 * rate))).alias("score")))  # read three times
    limit = valley(scored.filter(F.col(key) < 0), "score")
    own = scored.filter(F.col(key) >= 0)
    return own.withColumn("call", F.when(F.lit(limit).isNotNull() & (F.col("score") > F.lit(limit)), "doublet").otherwise("singlet")), limit
