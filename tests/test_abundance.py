import math
import random

import numpy as np
import pytest

from loomframe.operators import abundance

SIZES = [400, 520, 610, 380, 450, 700, 330, 590]


def drawn(rng, mean, dispersion):
    return int(rng.poisson(rng.gamma(1 / dispersion, mean * dispersion)))


def made(rng, groups, dispersion=0.1, change=0.0, n=60, changed=0, half=4):
    """Counts of ``n`` neighbourhoods; the first ``changed`` have a log fold change."""
    share = rng.uniform(0.01, 0.08, n)
    return {g: [drawn(rng, share[g] * s * math.exp(change * c if g < changed else 0), dispersion) for s, c in zip(SIZES, groups, strict=True)] for g in range(n)}


def frames(spark, counts, columns, zeros=True):
    rows = [(g, f"s{i}", n) for g, r in counts.items() for i, n in enumerate(r) if n or zeros]
    names = list(columns)
    samples = [(f"s{i}", s, *[columns[c][i] for c in names], "x") for i, s in enumerate(SIZES)]
    return spark.createDataFrame(rows, "nhood int, sample string, n int"), spark.createDataFrame(samples, f"sample string, size int, {', '.join(f'{c} double' for c in names)}, n string")


# A plain fit: one row at a time, by climbing with halved steps on numerical slopes of the written-out likelihood.

def plain_logpmf(y, mu, d):
    r = 1 / d
    return math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) + r * math.log(r / (r + mu)) + (y * math.log(mu / (r + mu)) if y else 0.0)


def plain_fit(y, x, d):
    def value(b):
        return sum(plain_logpmf(n, s * math.exp(float(np.dot(row, b))), d) for n, s, row in zip(y, SIZES, x, strict=True)) - abundance.RIDGE / 2 * sum(v * v for v in b[1:])

    b = np.zeros(x.shape[1])
    b[0] = math.log(sum(y) / sum(SIZES))
    now = value(b)
    for _ in range(200):
        mu = np.array(SIZES) * np.exp(x @ b)
        pen = np.diag([0.0] + [abundance.RIDGE] * (len(b) - 1))
        hess = (x.T * (mu * (1 + d * np.array(y)) / (1 + d * mu) ** 2)) @ x + pen  # the observed one
        step = np.linalg.solve(hess, x.T @ ((np.array(y) - mu) / (1 + d * mu)) - pen @ b)
        while value(b + step) < now - 1e-12 and np.abs(step).max() > 1e-12:
            step = step / 2
        b, old = b + step, now
        now = value(b)
        if abs(now - old) < 1e-13 and np.abs(step).max() < 1e-9:
            break
    mu = np.array(SIZES) * np.exp(x @ b)
    info = (x.T * (mu / (1 + d * mu))) @ x + np.diag([0.0] + [abundance.RIDGE] * (len(b) - 1))
    return b, sum(plain_logpmf(n, m, d) for n, m in zip(y, mu, strict=True)), math.log(np.linalg.det(info))


def plain_test(counts, x, prior_df=10.0):
    grid = abundance.GRID
    curves = {g: [(lambda f: f[1] - f[2] / 2)(plain_fit(y, x, d)) for d in grid] for g, y in counts.items() if sum(y)}
    common = np.mean(list(curves.values()), axis=0)
    out = {}
    for g, c in curves.items():
        total = np.array(c) + prior_df / (len(SIZES) - x.shape[1]) * common
        k = int(total.argmax())
        logs = np.log(grid)
        best = logs[k]
        if 0 < k < len(grid) - 1:
            a, b, e = total[k - 1 : k + 2]
            best += (logs[1] - logs[0]) * (a - e) / (2 * (a - 2 * b + e))
        d = math.exp(best)
        full, less = plain_fit(counts[g], x, d), plain_fit(counts[g], x[:, :-1], d)
        out[g] = (full[0][-1], math.copysign(math.sqrt(max(0.0, 2 * (full[1] - less[1]))), full[0][-1]), d)
    return out


@pytest.mark.parametrize("zeros", [True, False])
def test_equals_a_plain_fit(spark, zeros):
    rng = np.random.default_rng(3)
    c, batch = [0, 0, 0, 0, 1, 1, 1, 1], [0.0, 1.0, 0.5, 0.0, 1.0, 0.0, 0.5, 1.0]
    counts = made(rng, c, dispersion=0.2, change=1.0, n=12, changed=4)
    counts[12] = [0, 0, 0, 0, 9, 7, 8, 11]  # nothing in one condition
    counts[13] = [5] * 8
    x = np.column_stack([np.ones(8), batch, c])
    got = abundance.abundance_regression(*frames(spark, counts, {"c": [float(v) for v in c], "b": batch}, zeros), "c", ["b"])
    assert got.columns == ["nhood", "log_fc", "z", "dispersion", "p"]
    rows = {r["nhood"]: r for r in got.collect()}
    want = plain_test(counts, x)
    assert rows.keys() == want.keys()
    for g, (fc, z, d) in want.items():
        assert rows[g]["log_fc"] == pytest.approx(fc, abs=2e-6), g
        assert rows[g]["z"] == pytest.approx(z, abs=2e-6), g
        assert rows[g]["dispersion"] == pytest.approx(d, rel=1e-5), g
        assert rows[g]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6), g


def test_odd_rows(spark):
    c = {"c": [0.0] * 4 + [1.0] * 4}
    counts, samples = frames(spark, {1: [3, 4, 2, 5, 9, 12, 8, 15], 2: [0] * 8, 3: [2] * 8}, c)
    more = spark.createDataFrame([(4, "s0", None), (5, "elsewhere", 50), (5, None, 3), (1, "elsewhere", 1000)], "nhood int, sample string, n int")
    rows = {r["nhood"]: r for r in abundance.abundance_regression(counts.union(more), samples, "c").collect()}
    plain = {r["nhood"]: r for r in abundance.abundance_regression(counts, samples, "c").collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    for g in (1, 2, 3):
        assert rows[g] == plain[g]
    for g in (2, 4, 5):
        assert (rows[g]["log_fc"], rows[g]["z"], rows[g]["p"]) == (0.0, 0.0, 1.0)
    assert abundance.abundance_regression(counts.limit(0), samples, "c").count() == 0
    twice = {r["nhood"]: r for r in abundance.abundance_regression(counts.unionAll(counts), samples, "c").collect()}
    assert twice[1]["log_fc"] == pytest.approx(plain[1]["log_fc"], abs=0.05)
    for bad in (samples.limit(2), samples.unionAll(samples), samples.withColumn("c", samples["c"] * 0), samples.withColumn("size", samples["size"] * 0)):
        with pytest.raises(ValueError):
            abundance.abundance_regression(counts, bad, "c")


def test_planted_changes_and_size(spark):
    rng = np.random.default_rng(11)
    c = [0, 1, 0, 1, 0, 1, 0, 1]
    counts = made(rng, c, dispersion=0.05, change=1.5, n=300, changed=30)
    got = abundance.weighted_fdr(abundance.abundance_regression(*frames(spark, counts, {"c": [float(v) for v in c]}), "c").selectExpr("*", "1.0D AS weight")).collect()
    found = {r["nhood"] for r in got if r["fdr"] < 0.1}
    assert len(found & set(range(30))) >= 24
    assert len(found - set(range(30))) <= 8
    null = [r["p"] for r in got if r["nhood"] >= 30]
    assert 0.02 <= sum(p < 0.05 for p in null) / len(null) <= 0.10
    assert sorted(r["dispersion"] for r in got)[150] == pytest.approx(0.05, rel=0.5)


def adjusted(pairs):
    order = sorted(range(len(pairs)), key=lambda i: pairs[i][0])
    total, run, raw = sum(w for _, w in pairs), 0.0, {}
    for i in order:
        run += pairs[i][1]
        raw[i] = pairs[i][0] * total / run if run else 1.0
    out, least = {}, 1.0
    for i in reversed(order):
        least = min(least, raw[i])
        out[i] = least
    for i in order:  # of equal p, the last counts
        out[i] = min(out[j] for j in order if pairs[j][0] == pairs[i][0])
    return out


def test_weighted_rates(spark):
    r = random.Random(5)
    pairs = [(r.random() ** r.choice([1, 8]), r.random()) for _ in range(400)] + [(1.0, 0.5)] * 30 + [(0.0, 0.1), (0.25, 0.0), (1e-310, 0.3), (5e-324, 0.2), (1e-301, 1.0), (1e-300, 1.0), (0.001, 1.0), (0.000999999999, 1.0)] + [(10.0**-k, 0.4) for k in range(1, 12)] + [(0.25, 0.2)] * 5
    df = spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(pairs)] + [(-1, None, 9.0), (-2, math.nan, 9.0)], "id int, p double, weight double")
    got = {x["id"]: x["fdr"] for x in abundance.weighted_fdr(df).collect()}
    assert len(got) == len(pairs) + 2 and got[-1] is None and got[-2] is None
    want = adjusted(pairs)
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9), (i, pairs[i])
    none = spark.createDataFrame([(1, 0.01, 0.0), (2, 0.5, None)], "id int, p double, weight double")
    assert [x["fdr"] for x in abundance.weighted_fdr(none).collect()] == [1.0, 1.0]
    assert abundance.weighted_fdr(none.limit(0)).count() == 0


def test_weights(spark):
    sets = {1: "abc", 2: "abc", 3: "cd", 4: "e"}
    members = spark.createDataFrame([(g, k, 1.0 + i) for g, s in sets.items() for i, k in enumerate(s)] + [(4, "e", math.nan), (4, None, None)], "nhood int, vec_id string, dist double")
    got = {r["nhood"]: r["weight"] for r in abundance.overlap_weights(members).collect()}
    for g, s in sets.items():
        shared = sum(len(set(s) & set(t)) for t in sets.values()) / len(s)
        assert got[g] == pytest.approx(1 / shared)
    far = {r["nhood"]: r["weight"] for r in abundance.distance_weights(members).collect()}
    assert far == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 0.5, 4: 1.0})
    assert abundance.distance_weights(spark.createDataFrame([(1, 0.0), (2, None)], "nhood int, dist double")).agg({"weight": "sum"}).first()[0] == 0.0
