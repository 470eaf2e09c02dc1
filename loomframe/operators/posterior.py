"""Posterior draws of compositions, log-ratios and seeded parameter draws."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.shared import unit
from loomframe.functions.shipping import ships

ships(__name__)


def log2_changes(draws: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(draw, label, log2fc) of draws (draw, label, alpha, beta): softmax of alpha + beta over softmax of alpha."""
    w = Window.partitionBy("draw")
    parts = draws.withColumns({"e0": F.exp(F.col("alpha") - F.max("alpha").over(w)), "e1": F.exp(F.col("alpha") + F.col("beta") - F.max(F.col("alpha") + F.col("beta")).over(w))})
    share = lambda c: F.col(c) / F.sum(c).over(w)
    return parts.withColumns({"p0": share("e0"), "p1": share("e1")}).select("draw", "label", F.log2((F.col("p1") + eps) / (F.col("p0") + eps)).alias("log2fc"))


def summary(changes: DataFrame, mass: float = 0.95) -> DataFrame:
    """(label, mean, low, high): the mean and the shortest interval with the mass."""
    from loomframe.operators.tables import shortest_interval

    mean = changes.groupBy("label").agg(F.avg("log2fc").alias("mean"))
    return mean.join(shortest_interval(changes, ["label"], "log2fc", mass), "label")


def centred_log_ratio(counts: DataFrame, sample: str, label: str, n: str = "n", pseudo: float = 0.5) -> DataFrame:
    """(sample, label, clr): a deterministic alternative to a Bayesian fit of compositions."""
    x = counts.withColumn("_l", F.log(F.col(n) + pseudo))
    return x.select(sample, label, (F.col("_l") - F.avg("_l").over(Window.partitionBy(sample))).alias("clr"))


def random_trials(spark, n: int, choices: dict[str, list], ranges: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """``n`` draws of a search space: choices uniformly, ranges log-uniformly; equal seeds give equal draws."""
    drawn_at = lambda name: unit(F.lit(seed), F.lit(name), "trial")
    out = spark.range(n).withColumnRenamed("id", "trial")
    picked = {k: F.element_at(F.array(*map(F.lit, v)), (F.floor(drawn_at(k) * len(v)) + 1).cast("int")) for k, v in choices.items()}
    drawn = {k: F.exp(drawn_at(k) * (F.log(F.lit(float(b))) - F.log(F.lit(float(a)))) + F.log(F.lit(float(a)))) for k, (a, b) in ranges.items()}
    return out.withColumns({"name": F.format_string("trial_%03d", "trial"), **picked, **drawn})


def composition_draws(counts: DataFrame, sample: str = "sample", label: str = "label", condition: str = "condition", n: str = "n", draws: int = 400, chains: int = 2, seed: int = 1, reference: str | None = None) -> DataFrame:
    """(chain, draw, label, alpha, beta): posterior draws of a Dirichlet-multinomial regression of compositions on a condition (0 or 1).

    A sample's counts have the concentrations exp(alpha + beta * condition), with
    normal priors of 0 and 5 for alpha and of 0 and 1 for beta; the beta of the
    ``reference`` label (the first by name) is 0. Each chain is a
    task: a Metropolis walk, one coordinate at a time, over a table of samples
    and labels, both few; its steps are tuned in the first half, which goes.
    """

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np

        chain = int(f["chain"].iloc[0])
        table = f.pivot_table(index=["sample", "condition"], columns="label", values="n", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1)
        y, x, names = table.to_numpy(float), np.array([c for _, c in table.index], float), list(table.columns)
        lg = np.vectorize(math.lgamma, otypes=[float])
        r, k = np.random.default_rng(seed * 1000 + chain), len(names)
        fixed = names.index(reference) if reference in names else 0
        alpha, beta = np.log(y.mean(0) / max(1.0, y.mean()) + 0.1), np.zeros(k)
        size, total = y.sum(1), None
        each = lambda a, j: lg(a + y[:, j]) - lg(a)
        held = np.exp(alpha + x[:, None] * beta)
        parts, steps, taken, out = np.stack([each(held[:, j], j) for j in range(k)], 1), np.full((2, k), 0.3), np.zeros((2, k)), []
        whole = lambda s: lg(s) - lg(s + size)
        total = whole(held.sum(1))
        for it in range(2 * draws):
            for which, at, scale in ((0, alpha, 5.0), (1, beta, 1.0)):
                for j in range(k):
                    if which == 1 and j == fixed:
                        continue
                    new = at[j] + r.normal() * steps[which, j]
                    column = np.exp((new if which == 0 else alpha[j]) + x * (new if which == 1 else beta[j]))
                    part, now = each(column, j), whole(held.sum(1) - held[:, j] + column)
                    gain = (part - parts[:, j]).sum() + (now - total).sum() + (at[j] ** 2 - new**2) / (2 * scale**2)
                    if math.log(r.random() + 1e-300) < gain:
                        at[j], held[:, j], parts[:, j], total = new, column, part, now
                        taken[which, j] += 1
            if it < draws and it % 25 == 24:
                steps *= np.exp((taken / 25 - 0.4) * 1.5)
                taken[:] = 0
            if it >= draws:
                out += [(chain, it - draws, name, float(a), float(b)) for name, a, b in zip(names, alpha, beta, strict=True)]
        return pd.DataFrame(out, columns=["chain", "draw", "label", "alpha", "beta"])

    rows = counts.select(F.col(sample).cast("string").alias("sample"), F.col(label).cast("string").alias("label"), F.col(condition).cast("int").alias("condition"), F.col(n).cast("long").alias("n"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(chains))).alias("chain"))
    return spread.groupBy("chain").applyInPandas(walk, "chain int, draw int, label string, alpha double, beta double")


def credible(draws: DataFrame, fdr: float = 0.05, effect: str = "beta") -> DataFrame:
    """(label, mean, wrong, credible): the chance that a label's effect has the other sign, and whether it is taken.

    Labels are taken, the surest first, as long as the mean chance of those
    taken is at most ``fdr``.
    """
    each = draws.groupBy("label").agg(F.avg(effect).alias("mean"), F.least(F.avg((F.col(effect) > 0).cast("int")), F.avg((F.col(effect) <= 0).cast("int"))).alias("wrong"))
    order = Window.orderBy("wrong", "label").rowsBetween(Window.unboundedPreceding, 0)  # labels are few
    return each.withColumn("credible", F.avg("wrong").over(order) <= fdr)


def effective_sizes(draws: DataFrame, value: str = "beta", lags: int = 50) -> DataFrame:
    """(label, draws, ess): draws over 1 + 2 * the sum of autocorrelations up to the first that isn't positive."""
    w = Window.partitionBy("label", "chain")
    z = draws.withColumn("_z", F.col(value) - F.avg(value).over(w))
    ordered = w.orderBy("draw")
    later = z.withColumn("_later", F.array(*[F.lead("_z", k).over(ordered) for k in range(lags + 1)]))
    many = later.select("label", "chain", "draw", "_z", F.posexplode("_later").alias("lag", "_y"))
    rho = many.groupBy("label", "lag").agg(F.sum(F.col("_z") * F.col("_y")).alias("c"), F.count("_z").alias("n"))
    first = F.first("c").over(Window.partitionBy("label").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    rho = rho.withColumn("rho", F.col("c") / F.nullif(first, F.lit(0.0)))
    good = F.min(F.coalesce((F.col("rho") > 0).cast("int"), F.lit(0))).over(Window.partitionBy("label").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    kept = rho.withColumn("_g", good)
    return kept.groupBy("label").agg(F.max("n").alias("draws"), (F.max("n") / (1 + 2 * F.sum(F.when((F.col("lag") > 0) & (F.col("_g") == 1), F.col("rho")).otherwise(0.0)))).alias("ess"))


def replicates(expected: DataFrame, n: int = 1, keys: tuple[str, ...] = ("cell_id", "gene_id"), mean: str = "mean", dispersion: float = 0.0) -> DataFrame:
    """(replicate, *keys, count): ``n`` posterior predictive draws of counts with the given means.

    Poisson, or with a ``dispersion`` negative binomial (variance mean +
    dispersion * mean^2). A draw is the inverse of the distribution at a digest
    of keys and replicate, so it is the same wherever it is made.
    """
    import numpy as np

    def draw(u: pd.Series, m: pd.Series) -> pd.Series:
        u, m = u.to_numpy(float), np.maximum(m.to_numpy(float), 0)
        if dispersion > 0:
            size = 1 / dispersion
            p = np.exp(-size * np.log1p(m / size))
            step = lambda k: (k - 1 + size) / k * (m / (m + size))
        else:
            p, step = np.exp(-m), lambda k: m / k
        upto, out, k = p.copy(), np.zeros(len(u), np.int64), 0
        limit = m + 40 * np.sqrt(m + dispersion * m * m) + 60
        live = (u >= upto) & (m > 0)
        while live.any():
            k += 1
            p = p * step(k)
            out[live] = k
            upto = upto + p
            live &= (u >= upto) & (k < limit)
        # where the mean is so large that no chance near 0 can be told, a normal draw
        far = m > 600
        if far.any():
            from loomframe.functions.distribution import quantile

            out[far] = np.maximum(0, np.round(m[far] + quantile(np.clip(u[far], 1e-12, 1 - 1e-12)) * np.sqrt(m[far] + dispersion * m[far] ** 2)))
        return pd.Series(out)

    many = expected.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"), *keys, mean)
    return many.select("replicate", *keys, F.pandas_udf(draw, "long")(unit("replicate", *keys), F.col(mean).cast("double")).alias("count"))
