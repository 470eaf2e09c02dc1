"""Queries of searches, tests of significance, integration metrics and layouts."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.functions.shared import UNIT_SQL, cut, unit
from loomframe.model import cells, counts, genes, r6, runs, sql, vectors
from loomframe.operators import abundance, descent, doublets, graphs, layout, matrix, metrics, neighbourhoods, network, posterior, reduction, search
from loomframe.operators import vectors as vec_ops
from loomframe.plans.matrix_queries import _D
from loomframe.plans.model_queries import _LR, _net
from loomframe.plans.registry import query

#: The vectors' stand-ins for batches and samples.
_BATCH = "vec_id % 3 AS batch"


def _batched(s, d):
    return vectors(s, d).withColumn("batch", F.col("vec_id") % 3)


_PCR = """x AS (SELECT batch, i, vec[i] AS x FROM (SELECT vec_id % 3 AS batch, vec, unnest(range(1, len(vec) + 1)) AS i FROM vectors)),
p AS (SELECT i, batch, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2), g AS (SELECT i, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS w FROM p GROUP BY 1)"""


@query(sql("SELECT round(sum((w - s * s / n) / (n - 1)) / sum((q - s * s / n) / (n - 1)), 9) AS pcr FROM g", "vectors", more=_PCR))
def pc_regression(s, d):
    return metrics.pc_regression(_batched(s, d), "batch").select(r6("pcr", 9).alias("pcr"))


@query()
def pcr_comparison(s, d):
    """Before and after the batches' means are taken out."""
    v = _batched(s, d)
    mean = v.select("batch", F.posexplode("vec").alias("i", "x")).groupBy("batch", "i").agg(F.avg("x").alias("m")).groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("m"))
    after = v.join(F.broadcast(mean), "batch").withColumn("vec", F.zip_with("vec", "m", lambda a, b: a - b))  # three batches
    return metrics.pcr_comparison(v, after, "batch").select(r6("before").alias("before"), r6("after").alias("after"), r6("score").alias("score"))


@query(sql("""SELECT la AS label, round((avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) + 1) / 2, 6) AS score
FROM (SELECT src, any_value(la) AS la, avg(dist) FILTER (la = lb) AS a, avg(dist) FILTER (la <> lb) AS b FROM dd GROUP BY 1) GROUP BY 1 HAVING la IN (SELECT label FROM nb WHERE n = (SELECT min(n) FROM nb))""", "vectors", more=_D + ", nb AS (SELECT label, count(DISTINCT vec_id % 3) AS n FROM vectors GROUP BY 1)"))
def isolated_labels(s, d):
    return metrics.isolated_widths(_batched(s, d), "label", "batch").select("label", r6("score").alias("score"))


@query()
def kmeans_agreement(s, d):
    return metrics.kmeans_agreement(vectors(s, d), "label")


_GAMMA = 0.02
_RBF = f"""w AS (SELECT a.vec_id AS src, b.vec_id AS dst, exp(-{_GAMMA}::DOUBLE * list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec)) AS w FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
st AS (SELECT src, sqrt(sum(w)) AS s FROM w GROUP BY 1), sm AS MATERIALIZED (SELECT w.src, w.dst, w / (x.s * y.s) AS w FROM w JOIN st x ON x.src = w.src JOIN st y ON y.src = w.dst),
lb AS (SELECT DISTINCT label FROM vectors WHERE vec_id % 2 = 0), y0 AS (SELECT vec_id AS node, lb.label, CASE WHEN vec_id % 2 = 0 AND vectors.label = lb.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM vectors CROSS JOIN lb)"""
_RBF += "".join(f", y{k + 1} AS (SELECT y0.node, y0.label, 0.2::DOUBLE * g + 0.8::DOUBLE * y0.y AS y FROM y0 JOIN (SELECT src AS node, label, sum(w * y) AS g FROM sm JOIN y{k} ON node = dst GROUP BY 1, 2) USING (node, label))" for k in range(2))


@query(sql("SELECT node, label, round(y, 8) AS score FROM y2", "vectors", more=_RBF))
def kernel_spreading(s, d):
    """Label spreading with the RBF kernel over all vectors, two rounds."""
    labels = vectors(s, d).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("node"), "label")
    return graphs.spread_by_kernel(vectors(s, d), labels, _GAMMA, 0.2, 2).withColumn("score", r6("score", 8))


@query()
def umap_layout(s, d):
    """A layout of the graph of 15 neighbours, from the first two principal components."""
    v = vectors(s, d)
    edges = layout.fuzzy_weights(vec_ops.nearest(v, 15))
    pcs = reduction.principal_components(v, 2)[0]
    start = pcs.select(F.col("vec_id").alias("node"), F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))
    return layout.layout(edges, start, rounds=20).select(F.col("node").alias("vec_id"), r6("x", 4).alias("x"), r6("y", 4).alias("y"))


@query()
def fuzzy_weights(s, d):
    return layout.fuzzy_weights(vec_ops.nearest(vectors(s, d), 10)).withColumn("weight", r6("weight"))


@query()
def knn_probed(s, d):
    """Neighbours by the inverted index, for the vectors whose id is divisible by 50, against all."""
    v = vectors(s, d)
    return vec_ops.nearest_probed(v, 10, v.filter("vec_id % 50 = 0"), probes=12).select("src", "dst", r6("dist").alias("dist"), "rank")


@query()
def knn_descent(s, d):
    """Neighbours by descent over all vectors, given for those whose id is divisible by 50."""
    return descent.nearest_by_descent(vectors(s, d), 10).filter("src % 50 = 0").select("src", "dst", r6("dist").alias("dist"), "rank")


@query()
def clustering_sweep(s, d):
    """A row (dim, k, resolution, n_clusters, silhouette) for each setting; all communities are found together."""
    v, graph, some = vectors(s, d), None, {}
    for dim in (32, 64):
        some[dim] = vec_ops.first_dims(v, dim)
        near = cut(vec_ops.nearest(some[dim], 20))
        for k in (10, 20):
            edges = vec_ops.shared_neighbours(near.filter(F.col("rank") <= k)).select(F.lit(dim).alias("dim"), F.lit(k).alias("k"), "a", "b", "weight")
            graph = edges if graph is None else graph.unionByName(edges)
    found, out = graphs.leiden(graph, (0.5, 1.0), ["dim", "k"]), None
    for dim, k, resolution in product((32, 64), (10, 20), (0.5, 1.0)):
        own = found.filter((F.col("dim") == dim) & (F.col("k") == k) & (F.col("resolution") == resolution)).select(F.col("node").alias("vec_id"), F.col("community").alias("c"))
        width = vec_ops.silhouette(some[dim].join(own, "vec_id"), "c")
        row = width.agg(F.lit(dim).alias("dim"), F.lit(k).alias("k"), F.lit(resolution).alias("resolution"), F.count_distinct("c").alias("n_clusters"), r6(F.avg("width")).alias("silhouette"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def communities_by_resolution(s, d):
    """Communities of the graph of 20 shared neighbours at eight resolutions."""
    edges = vec_ops.shared_neighbours(vec_ops.nearest(vectors(s, d), 20))
    found = graphs.leiden(edges, (0.1, 0.3, 0.5, 0.8, 1.0, 1.2, 1.5, 2.0))
    return found.select("resolution", F.col("node").alias("vec_id"), "community")


@query()
def doublet_sweep(s, d):
    """The share of neighbours to look at, by the bimodality of the simulated doublets' shares."""
    return doublets.sweep(vectors(s, d), (0.1, 0.2, 0.3), (0.005, 0.01, 0.03)).select("pk", r6("mean").alias("mean"), r6("metric", 2).alias("metric"), "best")


@query()
def doublet_calls(s, d):
    return doublets.simulated_threshold(vectors(s, d))[0].select("vec_id", r6("score").alias("score"), "call")


def _halving_sql(grace: int, factor: int, last: int) -> str:
    parts, alive = [], "SELECT DISTINCT params FROM runs"
    for k, at in enumerate(search.rungs(grace, factor, last)):
        parts.append(f"b{k} AS (SELECT params, min(value) AS best FROM runs WHERE epoch <= {at} AND params IN ({alive}) GROUP BY 1 HAVING max(epoch) >= {at})")
        parts.append(f"g{k} AS (SELECT params, {at} AS rung, best, row_number() OVER (ORDER BY best, params) <= ceil((SELECT count(*) FROM b{k}) / {factor}) AS promoted FROM b{k})")
        alive = f"SELECT params FROM g{k} WHERE promoted"
    union = " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(len(parts) // 2))
    return sql(f"SELECT params, rung, round(best, 6) AS best, promoted FROM ({union}) QUALIFY row_number() OVER (PARTITION BY params ORDER BY rung DESC) = 1", "runs", more=", ".join(parts))


@query(_halving_sql(1, 3, 27))
def successive_halving(s, d):
    return search.successive_halving(runs(s, d), 1, 3, 27).withColumn("best", r6("best"))


# significance of interactions

_ROUNDS = 100
_PERM = _LR + f""", ce AS (SELECT cell_id, cluster FROM cells WHERE cell_id IN (SELECT cell_id FROM counts)), cn AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER (ORDER BY cluster) AS upto FROM ce GROUP BY 1),
dr AS (SELECT cell_id, b, row_number() OVER (PARTITION BY b ORDER BY {UNIT_SQL.format("cell_id || ':' || b")}, cell_id) AS r FROM ce, range(1, {_ROUNDS + 1}) t(b)),
cb AS (SELECT cell_id, b, cluster FROM dr JOIN cn ON r > upto - n AND r <= upto),
bq AS (SELECT b, cluster, gene_id, list(x) AS v FROM lx JOIN cb USING (cell_id) WHERE x > 0 AND gene_id <= 40 GROUP BY 1, 2, 3),
bt AS (SELECT b, cluster, gene_id, (quantile_cont(x, 0.25) + 2 * quantile_cont(x, 0.5) + quantile_cont(x, 0.75)) / 4 AS t FROM (SELECT b, cluster, gene_id, unnest(list_concat(list_transform(range(n - len(v)), lambda i: 0.0::DOUBLE), v)) AS x FROM bq JOIN cn USING (cluster)) GROUP BY 1, 2, 3),
ob AS (SELECT a.cluster AS source, b.cluster AS target, ligand, receptor, pathway, a.t * b.t / (0.5::DOUBLE + a.t * b.t) AS prob FROM pr JOIN av a ON a.gene_id = ligand JOIN av b ON b.gene_id = receptor WHERE a.t * b.t > 0),
nu AS (SELECT l.b, l.cluster AS source, r.cluster AS target, ligand, receptor, l.t * r.t / (0.5::DOUBLE + l.t * r.t) AS prob FROM pr JOIN bt l ON l.gene_id = ligand JOIN bt r ON r.gene_id = receptor AND r.b = l.b),
ls AS (SELECT ob.*, coalesce(k, 0) / {_ROUNDS} AS p FROM ob LEFT JOIN (SELECT ob.source, ob.target, ob.ligand, ob.receptor, count(*) AS k FROM ob JOIN nu USING (source, target, ligand, receptor) WHERE round(nu.prob, 12) >= round(ob.prob, 12) GROUP BY 1, 2, 3, 4) USING (source, target, ligand, receptor)),
oe AS (SELECT gene_id, cluster, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2 AS r FROM lx JOIN ce USING (cell_id) WHERE x > 0 AND gene_id <= 40),
og AS (SELECT gene_id, cluster, sum(r) AS rs, count(*) AS pos FROM oe GROUP BY 1, 2), oz AS (SELECT gene_id, sum(pos) AS nnz FROM og GROUP BY 1), oa AS (SELECT sum(n) AS nn FROM cn),
om AS (SELECT gene_id, cluster, ((n - coalesce(pos, 0)) * (nn - nnz + 1) / 2 + coalesce(rs, 0) + coalesce(pos, 0) * (nn - nnz) - n * (nn + 1) / 2) / sqrt(n * (nn - n) * (nn + 1)::DOUBLE / 12) AS z FROM oz CROSS JOIN cn CROSS JOIN oa LEFT JOIN og USING (gene_id, cluster))"""


def _folded(s, d):
    """Counts of 40 genes, the cells' clusters and the pairs of ligand and receptor."""
    folded = cut(counts(s, d).groupBy("cell_id", (F.col("gene_id") % 40 + 1).alias("gene_id")).agg(F.sum("count").alias("x")))
    groups = cells(s, d).join(folded.select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "cluster")
    i = F.col("id")
    pairs = s.range(1, 31).select(i.alias("ligand"), (i % 40 + 1).alias("receptor"), F.concat(F.lit("path"), (i % 4).cast("string")).alias("pathway"))
    return folded, groups, pairs


def _lr_significance(s, d):
    return network.significance(*_folded(s, d), "cluster", _ROUNDS)


@query(sql("SELECT source, target, ligand, receptor, pathway, round(prob, 6) AS prob, round(p, 6) AS p FROM ls", "counts", "cells", "genes", more=_PERM))
def lr_significance(s, d):
    return _lr_significance(s, d).withColumns({"prob": r6("prob"), "p": r6("p")})


@query(sql("SELECT source, target, ligand, receptor, pathway, round(p, 6) AS p FROM ls WHERE p <= 0.05", "counts", "cells", "genes", more=_PERM))
def enriched_pairs(s, d):
    """Interactions that at most a twentieth of 100 permutations of the cells' groups reach."""
    return _lr_significance(s, d).filter("p <= 0.05").select("source", "target", "ligand", "receptor", "pathway", r6("p").alias("p"))


@query(sql("SELECT ligand, receptor, pathway FROM pr WHERE ligand IN (SELECT gene_id FROM om WHERE z > 1.959963984540054) OR receptor IN (SELECT gene_id FROM om WHERE z > 1.959963984540054)", "counts", "cells", "genes", more=_PERM))
def over_expressed_pairs(s, d):
    """The pairs with a gene that is higher in some cluster than in the rest, by the rank-sum test at 0.05."""
    folded, groups, pairs = _folded(s, d)
    markers = network.over_expressed_genes(folded.withColumn("x", F.col("x").cast("double")), groups, "cluster")
    return network.over_expressed_pairs(pairs, markers)


@query()
def network_centrality(s, d):
    return network.centralities(_net(s, d)).select("pathway", "node", *[r6(c).alias(c) for c in ("hub", "authority", "eigen", "pagerank", "betweenness")])


@query()
def network_patterns(s, d):
    return network.patterns(_net(s, d), 3).withColumn("weight", r6("weight", 4))


@query()
def pattern_numbers(s, d):
    return network.pattern_numbers(_net(s, d), 4, runs=5).withColumn("cophenetic", r6("cophenetic", 4))


# posterior

@query()
def composition_effects(s, d):
    """Effects of the diagnosis on the clusters' shares, from posterior draws."""
    c = cells(s, d)
    n = c.groupBy("sample", "cluster").agg(F.count("*").alias("n"))
    of = c.select("sample", (F.col("diagnosis") == "case").cast("int").alias("condition")).distinct()
    draws = posterior.composition_draws(n.join(of, "sample"), label="cluster", draws=200)
    return posterior.credible(draws).select("label", r6("mean", 3).alias("mean"), r6("wrong", 3).alias("wrong"), "credible")


@query()
def count_replicates(s, d):
    """Poisson replicates of the counts' means by cell and gene."""
    c = counts(s, d)
    cell = c.groupBy("cell_id").agg(F.sum("count").alias("a"))
    gene = c.groupBy("gene_id").agg(F.sum("count").alias("b"))
    total = c.agg(F.sum("count").alias("t"))
    mean = c.select("cell_id", "gene_id").join(cell, "cell_id").join(gene, "gene_id").crossJoin(F.broadcast(total)).select("cell_id", "gene_id", (F.col("a") * F.col("b") / F.col("t")).alias("mean"))  # one row
    return posterior.replicates(mean)


_NH = """ce AS (SELECT vec_id FROM vectors WHERE """ + UNIT_SQL.format("vec_id || ':' || 7") + """ < 0.1),
me AS (SELECT src AS nhood, dst AS vec_id FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS r FROM dd WHERE src IN (SELECT vec_id FROM ce)) WHERE r <= 20),
sa AS (SELECT vec_id % 6 AS sample, count(*) AS size, CASE WHEN vec_id % 6 < 3 THEN 1 ELSE 0 END AS c FROM vectors GROUP BY 1, 3),
co AS (SELECT g.nhood, sa.sample, size, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT nhood FROM me) g CROSS JOIN sa LEFT JOIN (SELECT nhood, vec_id % 6 AS sample, count(*) AS n FROM me GROUP BY 1, 2) USING (nhood, sample)),
pe AS (SELECT nhood, c, sum(n) AS y, sum(size) AS size, sum(size * size) AS square, (sum(n) + 0.5::DOUBLE) / sum(size) AS rate FROM co GROUP BY 1, 2),
di AS (SELECT greatest(avg(x), 0) AS d FROM (SELECT nhood, sum((n - rate * co.size) * (n - rate * co.size) - rate * co.size) / sum(rate * co.size * rate * co.size) AS x FROM co JOIN pe USING (nhood, c) GROUP BY 1)),
va AS (SELECT nhood, c, rate, 1 / (rate * size) + d * square / (size * size) AS v FROM pe, di)"""


def _nhoods(s, d):
    v = vectors(s, d)
    centres = v.filter(unit("vec_id", F.lit(7)) < 0.1)
    return v, vec_ops.nearest(v, 20, centres).select(F.col("src").alias("nhood"), F.col("dst").alias("vec_id"))


@query(sql("SELECT nhood, round(ln(max(rate) FILTER (c = 1)) - ln(max(rate) FILTER (c = 0)), 6) + 0.0::DOUBLE AS log_fc, round((ln(max(rate) FILTER (c = 1)) - ln(max(rate) FILTER (c = 0))) / sqrt(sum(v)), 6) + 0.0::DOUBLE AS z FROM va GROUP BY 1", "vectors", more=_D + ", " + _NH))
def nhood_abundance(s, d):
    v, members = _nhoods(s, d)
    named = v.withColumn("sample", F.col("vec_id") % 6)
    samples = named.groupBy("sample").agg(F.count("*").alias("size")).withColumn("condition", (F.col("sample") < 3).cast("int"))
    out = neighbourhoods.abundance_test(neighbourhoods.counts_by_sample(members, named), samples)
    return out.select("nhood", r6("log_fc").alias("log_fc"), r6("z").alias("z"))


@query()
def nhood_significance(s, d):
    """The test's p values, adjusted."""
    from loomframe.functions.distribution import two_sided_p

    p = nhood_abundance(s, d).withColumn("p", two_sided_p("z"))
    return matrix.bh_adjust(p, "p", [], ["nhood"]).select("nhood", "log_fc", r6("p").alias("p"), r6("p_adj").alias("p_adj"))


@query(sql("SELECT vec_id AS centre, 20::BIGINT AS size FROM ce", "vectors", more="ce AS (SELECT vec_id FROM vectors WHERE " + UNIT_SQL.format("vec_id || ':' || 7") + " < 0.1)"))
def nhood_sample(s, d):
    """A tenth of the vectors as centres of neighbourhoods, chosen by a digest, with the size of each."""
    return _nhoods(s, d)[1].groupBy(F.col("nhood").alias("centre")).agg(F.count("*").alias("size"))


def _weighted_nhoods(s, d):
    """Members with their distances, and both kinds of weights."""
    v = vectors(s, d)
    members = cut(vec_ops.nearest(v, 20, v.filter(unit("vec_id", F.lit(7)) < 0.1)).select(F.col("src").alias("nhood"), F.col("dst").alias("vec_id"), F.round("dist", 9).alias("dist")))
    by_overlap = abundance.overlap_weights(members).withColumnRenamed("weight", "by_overlap")
    return v, members, by_overlap.join(abundance.distance_weights(members).withColumnRenamed("weight", "by_distance"), "nhood")


_NW = """, mr AS (SELECT src AS nhood, dst AS vec_id, dist FROM (SELECT src, dst, round(dist, 9) AS dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS r FROM dd WHERE src IN (SELECT vec_id FROM ce)) WHERE r <= 20)"""


@query(sql("""SELECT a.nhood, round(count(*) / sum(often), 9) AS by_overlap, round(CASE WHEN max(dist) > 0 THEN 1 / max(dist) ELSE 0 END, 6) AS by_distance
FROM mr a JOIN (SELECT vec_id, count(*) AS often FROM mr GROUP BY 1) USING (vec_id) GROUP BY 1""", "vectors", more=_D + ", " + _NH + _NW))
def nhood_weights(s, d):
    """What a neighbourhood's test counts for among others, by shared members and by distance."""
    return _weighted_nhoods(s, d)[2].select("nhood", r6("by_overlap", 9).alias("by_overlap"), r6("by_distance").alias("by_distance"))


@query()
def nhood_differential(s, d):
    """Regressions of the neighbourhoods' counts on the condition, with rates by both kinds of weights."""
    v, members, weights = _weighted_nhoods(s, d)
    named = v.withColumn("sample", F.col("vec_id") % 6)
    samples = named.groupBy("sample").agg(F.count("*").alias("size")).withColumn("condition", (F.col("sample") < 3).cast("int"))
    n = members.join(named.select("vec_id", "sample"), "vec_id").groupBy("nhood", "sample").agg(F.count("*").alias("n"))
    fitted = abundance.abundance_regression(n, samples, "condition").join(weights, "nhood")
    rated = abundance.weighted_fdr(abundance.weighted_fdr(fitted, weight="by_distance", out="distance_fdr"), weight="by_overlap", out="overlap_fdr")
    return rated.select("nhood", *[r6(c).alias(c) for c in ("log_fc", "z", "dispersion", "p", "distance_fdr", "overlap_fdr")])


# draws and curves

@query(sql("SELECT * FROM cells WHERE " + UNIT_SQL.format("cell_id || ':' || 1") + " < 0.1", "cells"))
def count_sample(s, d):
    """A tenth of the cells, chosen by a digest of their ids."""
    return cells(s, d).filter(unit("cell_id", F.lit(1)) < 0.1)


@query(sql("SELECT params, epoch, value, event_type, event_id, rank FROM runs JOIN (SELECT params, row_number() OVER (ORDER BY min(value), params) AS rank FROM runs GROUP BY 1) USING (params) WHERE rank <= 20", "runs"))
def best_run_curves(s, d):
    """Curves of the 20 runs with the least value, in the order of their rank."""
    best = runs(s, d).groupBy("params").agg(F.min("value").alias("least")).orderBy("least", "params").limit(20)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("least", "params")).cast("long"))
    return runs(s, d).join(F.broadcast(ranked.select("params", "rank")), "params")


_TRIALS = ", ".join(f"list_extract([{v}], floor({UNIT_SQL.format(repr('0') + f' || {chr(39)}:{k}:{chr(39)} || i')} * {n})::INT + 1) AS {k}" for k, v, n in (("n_latent", "10, 20, 30, 50", 4), ("n_layers", "1, 2, 3", 3)))


@query(f"SELECT i AS trial, 'trial_' || lpad(i::VARCHAR, 3, '0') AS name, {_TRIALS}, round(exp({UNIT_SQL.format(repr('0') + ' || ' + repr(':lr:') + ' || i')} * (ln(0.01::DOUBLE) - ln(0.0001::DOUBLE)) + ln(0.0001::DOUBLE)), 9) AS lr FROM range(0, 75) t(i)")
def random_trials(s, d):
    """Draws of a search space; reads no table, as a search begins without one."""
    return posterior.random_trials(s, 75, {"n_latent": [10, 20, 30, 50], "n_layers": [1, 2, 3]}, {"lr": (1e-4, 1e-2)}).withColumn("lr", r6("lr", 9))


_PAIRS = """g AS (SELECT cell_id, cluster FROM cells WHERE cell_id IN (SELECT cell_id FROM counts)), n AS (SELECT cluster, count(*)::DOUBLE AS n FROM g GROUP BY 1),
pp AS (SELECT a.cluster AS a, b.cluster AS b, a.n AS n1, a.n + b.n AS nn FROM n a JOIN n b ON a.cluster < b.cluster),
e AS (SELECT pp.a, pp.b, gene_id, cluster, rank() OVER (PARTITION BY pp.a, pp.b, gene_id ORDER BY x) + (count(*) OVER (PARTITION BY pp.a, pp.b, gene_id, x) - 1) / 2 AS r FROM (SELECT gene_id, cluster, round(x, 9) AS x FROM lognorm JOIN g USING (cell_id)) JOIN pp ON cluster = pp.a OR cluster = pp.b),
z AS (SELECT a, b, gene_id, count(*) AS nnz, count(*) FILTER (cluster = a) AS pos, coalesce(sum(r) FILTER (cluster = a), 0) AS rs FROM e GROUP BY 1, 2, 3),
rk AS (SELECT a, b, gene_id, n1, nn, (n1 - pos) * (nn - nnz + 1) / 2 + rs + pos * (nn - nnz) AS r1 FROM z JOIN pp USING (a, b))"""


@query(sql("SELECT a, b, gene_id, round((r1 - n1 * (nn + 1) / 2) / sqrt(n1 * (nn - n1) * (nn + 1) / 12), 5) + 0.0::DOUBLE AS z FROM rk", "lognorm", "cells", more=_PAIRS))
def deg_all_pairs(s, d):
    """Rank-sum tests of each pair of clusters."""
    g = cells(s, d).join(counts(s, d).select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "cluster")
    ln = matrix.log_normalize(counts(s, d)).select("cell_id", "gene_id", F.round("x", 9).alias("x"))
    return matrix.rank_sum_pairs(ln, g, "cluster").select("a", "b", "gene_id", r6("z", 5).alias("z"))


@query()
def deg_p_values(s, d):
    """The pairs' p values, with Bonferroni's adjustment by the genes of each pair."""
    from loomframe.functions.distribution import two_sided_p

    p = deg_all_pairs(s, d).withColumn("p", two_sided_p("z"))
    return p.withColumn("p_adj", matrix.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy("a", "b"))))


# tables of fixed values

@query("SELECT 'S' AS phase, 43::BIGINT AS n UNION ALL SELECT 'G2M', 54")
def cycle_gene_numbers(s, d):
    from loomframe.constants import G2M_GENES, S_GENES

    rows = [("S", g) for g in S_GENES] + [("G2M", g) for g in G2M_GENES]
    return s.createDataFrame(rows, "phase string, gene_name string").groupBy("phase").agg(F.count_distinct("gene_name").alias("n"))


def _member_score(name: str, flag: str) -> str:
    return f"""r{name} AS (SELECT gene_id, ntile(10) OVER (ORDER BY round(sum(x), 6), gene_id) AS bin, gene_id IN (SELECT gene_id FROM genes WHERE {flag}) AS m FROM lognorm GROUP BY 1),
u{name} AS (SELECT gene_id, m FROM r{name} WHERE bin IN (SELECT bin FROM r{name} WHERE m)), k{name} AS (SELECT count(*) FILTER (m) AS a, count(*) FILTER (NOT m) AS b FROM u{name}),
s{name} AS (SELECT cell_id, coalesce(sum(x) FILTER (m), 0) / any_value(a) - coalesce(sum(x) FILTER (NOT m), 0) / any_value(b) AS score FROM lognorm LEFT JOIN u{name} USING (gene_id), k{name} GROUP BY 1)"""


@query(sql("SELECT cell_id, round(a, 6) + 0.0::DOUBLE AS s_score, round(b, 6) + 0.0::DOUBLE AS g2m_score, CASE WHEN round(a, 6) < 0 AND round(b, 6) < 0 THEN 'G1' WHEN round(a, 6) > round(b, 6) THEN 'S' ELSE 'G2M' END AS phase FROM (SELECT cell_id, sa.score AS a, sb.score AS b FROM sa JOIN sb USING (cell_id))", "lognorm", "genes", more=_member_score("a", "is_mt") + ", " + _member_score("b", "is_ribo")))
def cell_cycle_phase(s, d):
    """Scores of two sets of genes and the phase; the tables' two flags stand in for the sets of ``constants``."""
    ln, g = matrix.log_normalize(counts(s, d)).select("cell_id", "gene_id", "x"), genes(s, d)
    a = matrix.set_score(ln, g.filter("is_mt").select("gene_id")).select("cell_id", r6("score").alias("s_score"))
    b = matrix.set_score(ln, g.filter("is_ribo").select("gene_id")).select("cell_id", r6("score").alias("g2m_score"))
    return a.join(b, "cell_id").select("cell_id", "s_score", "g2m_score", matrix.phase(F.col("s_score"), F.col("g2m_score")).alias("phase"))
