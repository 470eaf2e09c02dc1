"""Small fixtures with values worked out by hand or with dense arrays."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import distribution
from loomframe.operators import doublets, filters, graphs, joins, labels, matrix, network, posterior, qc, reduction, tables
from loomframe.operators import vectors as vec


def close(a, b, eps=1e-9):
    return abs(a - b) < eps


def test_mad_mask(spark):
    rows = [("p", f"c{i}", float(v)) for i, v in enumerate((1, 2, 3, 4, 100))] + [("q", f"d{i}", float(v)) for i, v in enumerate((5, 5, 5, 9))]
    df = spark.createDataFrame(rows, "platform string, cell_id string, m double")
    stats = {r.platform: r for r in qc.robust_stats(qc.unpivot(df, ["platform"], ["m"]), ["platform"]).collect()}
    assert close(stats["p"].med, 3) and close(stats["p"].mad, 1.4825796887, 1e-8) and stats["q"].mad == 0
    kept = {r.cell_id for r in qc.mad_mask(df, ["m"]).filter("keep").collect()}
    assert kept == {"c0", "c1", "c2", "c3", "d0", "d1", "d2", "d3"}


def test_log_normalise_and_average_rank(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 7.0)], "cell_id string, gene_id int, count double")
    assert close(matrix.log_normalize(df).filter("gene_id = 1").first().x, 8.0067008454, 1e-8)
    r = spark.createDataFrame([(i, v) for i, v in enumerate((0, 0, 0, 2, 5, 1))], "i int, v int").select("i", tables.average_rank(["v"], []).alias("r"))
    assert [x.r for x in r.orderBy("i").collect()] == [2, 2, 2, 5, 6, 4]


def test_rank_sum_small_and_dense(spark):
    values = [0, 0, 0, 2, 5, 1]
    groups = spark.createDataFrame([(i, "in" if i in (2, 3, 4) else "out") for i in range(6)], "cell_id int, g string")
    long = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(values) if v], "cell_id int, gene_id int, x double")
    got = matrix.rank_sum(long, groups, "g").filter("g = 'in'").first()
    assert got.u == 7 and close(got.z, 1.0910894512, 1e-8)
    r = np.random.default_rng(0)
    dense = r.poisson(0.7, (40, 8))
    member = r.integers(0, 3, 40)
    groups = spark.createDataFrame([(i, int(m)) for i, m in enumerate(member)], "cell_id int, g int")
    long = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(8) if dense[i, j]], "cell_id int, gene_id int, x double")
    got = {(x.g, x.gene_id): x for x in matrix.rank_sum(long, groups, "g", tie_correct=True).collect()}
    for j in range(8):
        x = dense[:, j]
        rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        for g in range(3):
            n1, n = (member == g).sum(), 40
            r1 = rank[member == g].sum()
            _, t = np.unique(x, return_counts=True)
            var = n1 * (n - n1) / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1)))
            assert close(got[g, j].u, r1 - n1 * (n1 + 1) / 2) and close(got[g, j].z, (r1 - n1 * (n + 1) / 2) / math.sqrt(var))


def test_moments_scaling_and_trimean_against_dense(spark):
    r = np.random.default_rng(3)
    dense = r.poisson(1.2, (30, 5)).astype(float)
    long = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(30) for j in range(5) if dense[i, j]], "cell_id int, gene_id int, x double")
    m = {x.gene_id: x for x in matrix.gene_moments(long, "x").collect()}
    z = {(x.cell_id, x.gene_id): x for x in matrix.scaled(long).collect()}
    for j in range(5):
        assert close(m[j].mean, dense[:, j].mean()) and close(m[j]["var"], dense[:, j].var(ddof=1))
    for (i, j), x in z.items():
        assert close(x.z, min(10, (dense[i, j] - dense[:, j].mean()) / dense[:, j].std(ddof=1)))
    groups = spark.createDataFrame([(i, i % 2) for i in range(30)], "cell_id int, g int")
    for x in matrix.trimean(long, groups, "g").collect():
        q = np.quantile(dense[np.arange(30) % 2 == x.g, x.gene_id], [0.25, 0.5, 0.75])
        assert close(x.trimean, (q[0] + 2 * q[1] + q[2]) / 4)


def test_regression_against_least_squares(spark):
    r = np.random.default_rng(4)
    dense, a, b = r.poisson(1.0, (25, 3)).astype(float), r.normal(size=25), r.normal(size=25)
    long = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(25) for j in range(3) if dense[i, j]], "cell_id int, gene_id int, x double")
    cov = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(25)], "cell_id int, a double, b double")
    for x in matrix.regress_out(long, cov, "a", "b").collect():
        k = np.linalg.lstsq(np.stack([np.ones(25), a, b], 1), dense[:, x.gene_id], rcond=None)[0]
        assert np.allclose([x.k0, x.ka, x.kb], k)


def test_fuzzy_overlap(spark):
    soft = spark.createDataFrame([(c, l, p) for c, row in enumerate(((0.7, 0.2, 0.1), (0.1, 0.6, 0.3), (0.0, 0.5, 0.5))) for l, p in enumerate(row)], "cell_id int, label int, prob double")
    got = {(x.a, x.b): x for x in vec.fuzzy_overlap(soft).collect()}
    want = [[0.8, 0.3, 0.2], [0.3, 1.3, 0.9], [0.2, 0.9, 0.9]]
    assert all(close(got[i, j].overlap, want[i][j]) for i in range(3) for j in range(3))
    assert close(got[0, 1].ochiai, 0.2941742, 1e-6) and close(got[0, 2].ochiai, 0.2357023, 1e-6) and close(got[1, 2].ochiai, 0.8320503, 1e-6)


def test_leading_count_and_interval(spark):
    sd = spark.createDataFrame([("g", i + 1, float(v)) for i, v in enumerate([10, 8, 6, 3] + [2] * 10)], "g string, i int, sd double")
    got = tables.leading_count(sd, ["g"], "i", "sd").first()
    assert got.threshold == 3.0 and got.n == 4
    df = spark.createDataFrame([("g", float(v)) for v in (0, 1, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 5, 9)], "g string, v double")
    got = tables.shortest_interval(df, ["g"], "v", 0.8).first()
    assert (got.low, got.high) == (0, 5)


def test_run_ranking(spark):
    runs = spark.createDataFrame([("a", 1.0, 5.0, 1.0, 1.0), ("b", 1.0, 4.0, 2.0, 1.0), ("c", 2.0, 3.0, 3.0, 2.0)], "params string, elbo double, rec double, cyc double, kl double")
    got = tables.rank_runs(runs, {"elbo": (0.5, False), "rec": (0.2, False), "cyc": (0.2, True), "kl": (0.1, False)}).orderBy("position").collect()
    assert [(x.params, round(x.score, 6)) for x in got] == [("b", 1.4), ("a", 1.8), ("c", 2.2)]


def test_agreement_and_silhouette(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "x int, y int")
    got = vec.agreement(df, "x", "y").first()
    assert close(got.ari, -0.1111111111, 1e-8) and close(got.nmi, 0.0817041659, 1e-8)
    assert close(vec.agreement(df, "x", "x").first().ari, 1)
    points = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [5.0, 0.0], 1), (3, [5.0, 1.0], 1)], "vec_id int, vec array<double>, label int")
    assert all(close(x.width, 0.8019609728, 1e-8) for x in vec.silhouette(points).collect())


def test_adjusted_p_and_normal_tail(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "i int, p double")
    got = [x.p_adj for x in matrix.bh_adjust(df, "p", ties=["i"]).orderBy("i").collect()]
    assert np.allclose(got, [0.04, 0.0533333333, 0.0533333333, 0.5])
    x = spark.createDataFrame([(0.975, 1.96)], "p double, z double").select(distribution.normal_ppf("p").alias("q"), distribution.normal_cdf("z").alias("c")).first()
    assert close(x.q, 1.9599639845, 1e-8) and close(x.c, 0.9750021049, 1e-8)


def test_barcodes_and_removal(spark):
    df = spark.createDataFrame([("s1_ACGTACGTACGTACGT-2",), ("ACGTACGTACGTACGT",), ("foo",)], "x string")
    assert [r[0] for r in df.select(joins.core_barcode(F.col("x"))).collect()] == ["ACGTACGTACGTACGT-2", "ACGTACGTACGTACGT-1", "foo"]
    scores = spark.createDataFrame([(2, 0.8), (3, 0.7), (4, 0.1)], "cell_id int, s double")
    left = filters.below_kth(scores, "s", ["cell_id"], spark.createDataFrame([(2,)], "n long"))
    assert [r.cell_id for r in left.collect()] == [4]


def test_errors_and_ties(spark):
    df = spark.createDataFrame([("g", "A"), ("g", "A"), ("g", "B"), ("g", "B")], "g string, l string")
    assert sorted(r.l for r in tables.dominant(df, "g", "l").collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="repeated"):
        qc.require_unique(df, ["l"])
    with pytest.raises(ValueError, match="no gene"):
        qc.flag_genes(spark.createDataFrame([("x",)], "gene_name string"), {"is_mt": ["MT-"]})
    with pytest.raises(ValueError, match="none of"):
        labels.present(df, ["z"])
    with pytest.raises(ValueError, match="fewer"):
        filters.soft_mass(spark.createDataFrame([("a", 1.0)], "label string, prob double"), 10)
    assert tables.contingency(spark.createDataFrame([("a", "x"), ("b", "y")], "r string, c string"), "r", "c").count() == 4
    n = spark.createDataFrame([(None, "A"), (1, None)], "a int, b string")
    assert labels.encode(n, "b", "code").filter("b IS NULL").first().code == -1


def test_mixture_threshold_and_calls(spark):
    r = random.Random(1)
    rows = [("s", i, min(0.99, max(0.01, r.gauss(0.1, 0.03)))) for i in range(400)] + [("s", 400 + i, min(0.99, max(0.01, r.gauss(0.6, 0.08)))) for i in range(60)]
    df = spark.createDataFrame(rows, "sample string, cell_id int, score double")
    fits = doublets.fit_mixtures(df, "sample", "score", "raw")
    f = fits.first()
    assert abs(f.mean_1 - 0.1) < 0.02 and abs(f.mean_2 - 0.6) < 0.05 and close(f.weight_1 + f.weight_2, 1, 1e-6)
    limits = doublets.thresholds(fits, "sample", "raw")
    assert 0.15 < limits.first().threshold < 0.45
    assert abs(doublets.call(df, limits, "sample", "score").filter("call = 'doublet'").count() - 60) <= 3
    with pytest.raises(Exception, match="no threshold"):
        doublets.call(df, limits.withColumn("threshold", F.lit(None).cast("double")), "sample", "score").collect()


def _em(values, rounds=200):
    """The same mixture, of one group, on an array."""
    x = np.sort(values)
    top = x[x >= np.quantile(x, 0.95)]
    mean, weight, var, before = np.array([np.quantile(x, 0.2), np.median(top)]), np.array([0.5, 0.5]), np.full(2, x.var() + 1e-6), -math.inf
    for _ in range(rounds):
        dens = weight * np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var)
        total = dens.sum(1, keepdims=True) + 1e-300
        n = (dens / total).sum(0) + 1e-12
        mean = (dens / total * x[:, None]).sum(0) / n
        var = (dens / total * (x[:, None] - mean) ** 2).sum(0) / n + 1e-6
        weight, now = n / len(x), float(np.log(total).mean())
        if now - before < 1e-6:
            break
        before = now
    order = np.argsort(mean)
    return [float(v) for k in order for v in (mean[k], math.sqrt(var[k]), weight[k])]


def test_mixtures_of_all_groups_against_arrays(spark):
    r = np.random.default_rng(8)
    groups = {"a": np.concatenate((r.normal(0.2, 0.05, 600), r.normal(0.7, 0.1, 90))), "b": np.concatenate((r.normal(0.4, 0.02, 300), r.normal(0.5, 0.2, 300))), None: r.random(50), "few": r.random(9), "same": np.full(30, 0.25)}
    rows = [(g, float(min(0.99, max(0.01, x)))) for g, v in groups.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "sample string, score double").repartition(5)
    got = {x["sample"]: x for x in doublets.fit_mixtures(df, "sample", "score", "logit").collect()}
    assert set(got) == {"a", "b", None, "same"}
    for g, f in got.items():
        x = np.array([v for k, v in rows if k == g and v is not None])
        y = np.log(x / (1 - x))
        assert np.allclose([f.mean_1, f.sd_1, f.weight_1, f.mean_2, f.sd_2, f.weight_2], _em(y), rtol=1e-7, atol=1e-8)
        assert np.allclose([f.lo, f.hi, f.n], [y.min(), y.max(), len(y)])
    assert doublets.fit_mixtures(df.limit(0), "sample", "score").count() == 0


def test_transforms_return(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "s double")
    for how in ("raw", "log", "logit", "probit"):
        for x in df.select("s", distribution.transform_score(F.col("s"), how).alias("y")).select("s", distribution.restore_score(F.col("y"), how).alias("b")).collect():
            assert close(x.s, x.b, 1e-6)
    d = spark.createDataFrame([(0.4,)], "y double").select(distribution.restore_density(F.lit(1.0), F.col("y"), "logit").alias("d")).first().d
    s = 1 / (1 + math.exp(-0.4))
    assert close(d, 1 / (s * (1 - s)))


def test_neighbours_against_dense(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "vec_id int, vec array<double>")
    for block in (4096, 13):
        got = vec.nearest(df, 5, block=block).collect()
        assert len(got) == 300
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        for row in got:
            assert np.argsort(d[row.src])[row["rank"] - 1] == row.dst and close(row.dist, d[row.src, row.dst])


def test_components_of_variance(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 4)) @ np.diag([4, 2, 1, 0.2]) + 3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "vec_id int, vec array<double>")
    scores, loadings, variances = reduction.principal_components(df, 4)
    assert np.allclose([v.variance for v in variances.orderBy("pc").collect()], np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    got = np.array([s.pc for s in scores.orderBy("vec_id").collect()])
    axes = np.zeros((4, 4))
    for row in loadings.collect():
        axes[row.dim, row.pc - 1] = row.loading
    assert np.allclose(got, (x - x.mean(0)) @ axes) and np.allclose(axes.T @ axes, np.eye(4))


def test_communities_and_spreading(spark):
    edges = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(4, 10, 0.1)]
    df = spark.createDataFrame(edges, "a int, b int, weight double")
    got = {x.node: x.community for x in graphs.communities(df).collect()}
    again = {x.node: x.community for x in graphs.communities(spark.createDataFrame(edges[::-1], "a int, b int, weight double")).collect()}
    assert got == again and len(set(got.values())) == 2 and got[0] == got[4] != got[10] == got[14]
    both = df.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(df.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    labels_ = spark.createDataFrame([(0, "x"), (14, "y")], "node int, label string")
    out = {x.node: x for x in graphs.confident(graphs.spread_labels(both, labels_, 0.5, 6)).collect()}
    assert out[3].label == "x" and out[12].label == "y" and 0.5 <= out[3].confidence <= 1


def test_silhouettes_and_communities_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(60, 5)) + 100, rng.integers(0, 3, 60)
    x[7] = x[8]
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(60)], "vec_id int, vec array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    expected = []
    for i in range(60):
        m = {c: d[i, (lab == c) & (np.arange(60) != i)].mean() for c in range(3)}
        a, b = m.pop(lab[i]), min(m.values())
        expected.append((b - a) / max(a, b))
    monkeypatch.setattr(vec, "MOST_PAIRED", 10)
    got = {r.vec_id: r.width for r in vec.silhouette(df).collect()}
    assert np.allclose([got[i] for i in range(60)], expected, atol=1e-9)
    means = {(r.vec_id, r.lb): r.m for r in vec.label_means(df, block=16).collect()}
    assert all(close(means[i, c], d[i, (lab == c) & (np.arange(60) != i)].mean(), 1e-9) for i in range(60) for c in range(3))
    edges = [(i, j, 1.0) for g in range(0, 60, 10) for i in range(g, g + 6) for j in range(i + 1, g + 6)] + [(g, g + 10, 0.1) for g in range(0, 50, 10)]
    df = spark.createDataFrame(edges, "a int, b int, weight double")
    small = {r.node: r.community for r in graphs.communities(df).collect()}
    assert len(set(small.values())) == 6


def test_leaf_order(spark):
    m = {("a", "c"): 0.9, ("b", "d"): 0.8, ("a", "b"): 0.1, ("a", "d"): 0.1, ("c", "b"): 0.1, ("c", "d"): 0.1}
    rows = [(x, y, 1.0 if x == y else m.get((x, y), m.get((y, x)))) for x in "abcd" for y in "abcd"]
    got = [x.label for x in graphs.leaf_order(spark.createDataFrame(rows, "a string, b string, value double")).orderBy("place").collect()]
    assert sorted(got[:2]) in (["a", "c"], ["b", "d"]) and sorted(got) == list("abcd")


def test_posterior_and_networks(spark):
    draws = spark.createDataFrame([(d, l, a, b) for d in range(3) for l, a, b in (("x", 0.0, 0.0), ("y", 0.0, math.log(3)))], "draw int, label string, alpha double, beta double")
    out = {x.label: x.mean for x in posterior.summary(posterior.log2_changes(draws), 0.5).collect()}
    assert close(out["x"], -1, 1e-6) and close(out["y"], math.log2(1.5), 1e-6)
    e = spark.createDataFrame([("a", "b", 1.0, "p"), ("a", "b", 2.0, "q"), ("b", "a", 4.0, "p")], "source string, target string, prob double, pathway string")
    s = {x.node: x for x in network.strengths(e).collect()}
    assert (s["a"].out_degree, s["a"].out_strength, s["a"].in_strength) == (1, 3.0, 4.0)
    assert network.edge_jaccard(e).first().jaccard == 0.5
    a, b = posterior.random_trials(spark, 20, {"k": [1, 2]}, {"lr": (1e-4, 1e-2)}, 3).collect(), posterior.random_trials(spark, 20, {"k": [1, 2]}, {"lr": (1e-4, 1e-2)}, 3).collect()
    assert a == b and all(1e-4 <= x.lr <= 1e-2 for x in a)
