"""Neighbours, layouts, significance, posterior draws: against brute force or known values."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomframe.constants import G2M_GENES, S_GENES
from loomframe.functions import distribution
from loomframe.functions.shared import unit
from loomframe.operators import doublets, graphs, layout, metrics, network, posterior, vectors


def frame(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    return spark.createDataFrame([(i, [float(v) for v in row], int(l)) for i, (row, l) in enumerate(zip(x, labels))], "vec_id long, vec array<double>, label int")


def blobs(n=60, seed=1, dims=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims)) * 6
    return np.concatenate([c + r.normal(size=(n, dims)) for c in centres]), np.repeat(np.arange(4), n)


def test_normal_distribution(spark):
    x = np.concatenate([np.linspace(-38, 38, 4001), [0, 2.4999999, 2.5, 1e-300]])
    got = distribution.erfc(x)
    assert all(abs(g - math.erfc(v)) <= 1e-11 * math.erfc(v) + 1e-300 for g, v in zip(got, x))
    from statistics import NormalDist

    p = np.array([1e-12, 1e-5, 0.02, 0.025, 0.3, 0.5, 0.7, 0.975, 0.99999])
    assert np.allclose(distribution.quantile(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-9, atol=1e-12)
    df = spark.createDataFrame([(0.0,), (None,), (1.96,)], "z double").select(distribution.normal_cdf("z").alias("c"), distribution.two_sided_p("z").alias("p"))
    rows = df.collect()
    assert rows[1].c is None and rows[1].p is None and abs(rows[2].p - 0.049995790296) < 1e-9
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "p double").select(distribution.normal_ppf("p")).collect()] == [-math.inf, math.inf, math.inf]


def test_ties_of_neighbours(spark):
    """100 equal vectors among others: of those equally near, the least keys."""
    r = np.random.default_rng(2)
    x = r.normal(size=(180, 6))
    x[40:140] = x[40]
    got = {}
    for row in vectors.nearest(frame(spark, x), 5, block=32).collect():
        got.setdefault(row.src, []).append((row["rank"], row.dst))
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:5]
        assert [j for _, j in sorted(got[i])] == want


def test_recall_of_probed_neighbours(spark):
    x, _ = blobs(400, 3, 16)
    df = frame(spark, x)
    asked = df.filter("vec_id % 50 = 0")
    exact = {(r.src, r.dst) for r in vectors.nearest(df, 10, asked).collect()}
    found = {(r.src, r.dst) for r in vectors.nearest_probed(df, 10, asked, probes=12).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_kernel_spreading(spark):
    x, y = blobs(20)
    df = frame(spark, x, y)
    got = graphs.spread_by_kernel(df, df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("node"), "label"), 0.05, 0.3, 4).collect()
    w = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(w, 0)
    s = w / np.sqrt(w.sum(1)[:, None] * w.sum(1)[None])
    start = np.array([[float(i % 3 == 0 and y[i] == l) for l in range(4)] for i in range(len(x))])
    f = start
    for _ in range(4):
        f = 0.3 * s @ f + 0.7 * start
    assert np.allclose([f[r.node, r.label] for r in got], [r.score for r in got]) and len(got) == f.size


def test_layout_keeps_neighbours(spark):
    x, y = blobs(40)
    df = frame(spark, x, y)
    edges = layout.fuzzy_weights(vectors.nearest(df, 10))
    weights = [r.weight for r in edges.collect()]
    assert min(weights) > 0 and max(weights) <= 1 + 1e-9
    start = spark.createDataFrame([(i, float(v[0]), float(v[1])) for i, v in enumerate(x)], "node long, x double, y double")
    out = {r.node: (r.x, r.y) for r in layout.layout(edges, start, rounds=12).collect()}
    p = np.array([out[i] for i in range(len(x))])
    near = np.argsort(((p[:, None] - p[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert np.isfinite(p).all() and (y[near] == y[:, None]).mean() >= 0.95


def test_metrics(spark):
    x, y = blobs(30)
    df = frame(spark, x, y).withColumn("batch", F.when(F.col("label") == 3, 0).otherwise(F.col("vec_id") % 3))
    assert [(r.label, r.batches) for r in metrics.isolated_labels(df, "label", "batch").collect()] == [(3, 1)]
    assert metrics.isolated_widths(df, "label", "batch").first().score > 0.8
    assert metrics.kmeans_agreement(df, "label").first().ari > 0.95
    assert metrics.pc_regression(df, "label").first().pcr > 0.8 > metrics.pc_regression(df.withColumn("b", F.col("vec_id") % 2), "b").first().pcr


def test_centralities(spark):
    """A path of four groups, and a star."""
    rows = [("p", a, b, 1.0) for a, b in (("a", "b"), ("b", "c"), ("c", "d"))] + [("q", "hub", x, 2.0) for x in "xyz"]
    got = {(r.pathway, r.node): r for r in network.centralities(spark.createDataFrame(rows, "pathway string, source string, target string, prob double")).collect()}
    assert [got["p", n].betweenness for n in "abcd"] == [0, 2, 2, 0]
    assert got["q", "hub"].hub == 1 and abs(got["q", "x"].authority - 1 / 3) < 1e-9
    assert abs(sum(got["q", n].pagerank for n in ("hub", "x", "y", "z")) - 1) < 1e-9
    assert abs(got["q", "hub"].eigen - 1) < 1e-9 and abs(got["q", "x"].eigen - 1 / math.sqrt(3)) < 1e-6


def test_patterns(spark):
    rows = [(f"g{i}", f"p{j}", float(1 + i % 3) if (i < 3) == (j < 4) else 0.01) for i in range(6) for j in range(8)]
    edges = spark.createDataFrame(rows, "source string, pathway string, prob double")
    found = {(r.axis, r.name, r.pattern): r.weight for r in network.patterns(edges, 2).collect()}
    top = {n: max((1, 2), key=lambda k: found["source", n, k]) for n in (f"g{i}" for i in range(6))}
    assert len({top[f"g{i}"] for i in range(3)}) == 1 and {top["g0"], top["g5"]} == {1, 2}
    numbers = {r.k: r.cophenetic for r in network.pattern_numbers(edges, 3, runs=4).collect()}
    assert numbers[2] > 0.99


def test_composition(spark):
    r = np.random.default_rng(4)
    rows = []
    for s in range(16):
        c = s % 2
        share = np.array([0.3, 0.3, 0.2 * (4 if c else 1), 0.2])
        rows += [(f"s{s}", f"t{k}", c, int(n)) for k, n in enumerate(r.multinomial(500, share / share.sum()))]
    draws = posterior.composition_draws(spark.createDataFrame(rows, "sample string, label string, condition int, n long"), draws=150)
    out = {x.label: x for x in posterior.credible(draws).collect()}
    assert out["t2"].credible and out["t2"].mean > 0.7 and not out["t3"].credible and out["t0"].mean == 0
    ess = {x.label: x.ess for x in posterior.effective_sizes(draws.filter("label <> 't0'")).collect()}
    assert all(0 < v <= 400 for v in ess.values())


def test_replicates(spark):
    df = spark.range(4000).select(F.col("id").alias("cell_id"), F.lit(1).alias("gene_id"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(0.0).alias("mean"))
    got = posterior.replicates(df, 2).collect()
    x = np.array([r["count"] for r in got if r.cell_id % 2 == 0])
    assert abs(x.mean() - 3) < 0.15 and abs(x.var() - 3) < 0.3 and not any(r["count"] for r in got if r.cell_id % 2)
    y = np.array([r["count"] for r in posterior.replicates(df, 2, dispersion=0.5).collect() if r.cell_id % 2 == 0])
    assert abs(y.mean() - 3) < 0.25 and abs(y.var() - 7.5) < 1.2
    assert [tuple(a) for a in got[:50]] == [tuple(a) for a in posterior.replicates(df, 2).collect()[:50]]


def test_doublets(spark):
    x, y = blobs(60, 5)
    r = np.random.default_rng(6)
    i = r.choice(120, 20), 120 + r.choice(120, 20)
    x = np.concatenate([x, (x[i[0]] + x[i[1]]) / 2])
    calls, limit = doublets.simulated_threshold(frame(spark, x))
    rows = {r.vec_id: r for r in calls.collect()}
    real, mixed = np.mean([rows[k].score for k in range(240)]), np.mean([rows[k].score for k in range(240, 260)])
    assert mixed > real and len(rows) == 260
    best = doublets.sweep(frame(spark, x), (0.15, 0.25), (0.01, 0.05)).collect()
    assert sum(b.best for b in best) == 1
    bimodal = spark.createDataFrame([(float(v),) for v in np.concatenate([r.normal(0, 1, 500), r.normal(8, 1, 200)])], "s double")
    assert 2 < doublets.valley(bimodal, "s") < 6
    assert doublets.valley(bimodal.limit(0), "s") is None


def test_draws_and_constants(spark):
    u = [r[0] for r in spark.range(2000).select(unit("id", F.lit("x"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
    assert len(set(S_GENES)) == 43 and len(set(G2M_GENES)) == 54 and not set(S_GENES) & set(G2M_GENES)


def test_over_expressed_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, "p"), (3, 4, "q"), (5, 1, "r")], "ligand int, receptor int, pathway string")
    got = network.over_expressed_pairs(pairs, spark.createDataFrame([(1,), (1,)], "gene_id int")).collect()
    assert sorted(r.pathway for r in got) == ["p", "r"]


def test_permutations_keep_group_sizes_and_every_draw(spark):
    """Against ranks of the digests, made by hand."""
    import hashlib
    from collections import Counter

    names = ["b"] * 70 + ["a"] * 25 + ["c"] * 5
    cells = spark.createDataFrame([(i, g) for i, g in enumerate(names)], "cell_id long, g string")
    got = {}
    for r in network.permuted_groups(cells, "g", 12).collect():
        got.setdefault(r["round"], {})[r["cell_id"]] = r["g"]
    assert sorted(got) == list(range(1, 13))
    order = sorted(names)
    for k, placed in got.items():
        assert Counter(placed.values()) == Counter(names)
        ranked = sorted(range(100), key=lambda i: hashlib.md5(f"{i}:{k}".encode()).hexdigest()[:12])  # noqa: B023
        assert [placed[i] for i in ranked] == order
    assert len({tuple(sorted(p.items())) for p in got.values()}) == 12
    one = network.permuted_groups(cells.filter("g = 'a'"), "g", 3)
    assert one.count() == 75 and one.select("g").distinct().count() == 1
    assert network.permuted_groups(cells.limit(0), "g", 3).count() == 0


def test_over_expressed_genes(spark):
    rows = [(i, 1, 5.0 + i % 3) for i in range(20)] + [(i, 2, 1.0 + i % 4) for i in range(0, 40, 2)] + [(i, 3, 3.0) for i in range(20, 40)]
    cells = spark.createDataFrame([(i, "x" if i < 20 else "y") for i in range(40)], "cell_id long, g string")
    got = network.over_expressed_genes(spark.createDataFrame(rows, "cell_id long, gene_id long, x double"), cells, "g")
    assert sorted(tuple(r) for r in got.select("g", "gene_id").collect()) == [("x", 1), ("y", 3)]
