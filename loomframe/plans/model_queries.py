"""Queries of fitted models, graphs and networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.functions import distribution
from loomframe.functions.shared import cut
from loomframe.model import cells, counts, genes, r6, runs, sql, vectors
from loomframe.operators import doublets, expression_pca, graphs, matrix, network, posterior, reduction
from loomframe.operators import vectors as vec_ops
from loomframe.plans.registry import query


def _scores(s, d):
    """A score in (0, 1) with two modes, by sample."""
    return cells(s, d).select("cell_id", "sample", "platform", "cluster", "score")


@query(sql("SELECT cell_id, round(ln(1 + score + 1e-10), 9) AS log, round(ln(p / (1 - p)), 9) AS logit, round(exp(ln(1 + score + 1e-10)) - 1, 6) AS log_back, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS logit_back FROM (SELECT cell_id, score, least(greatest(score, 1e-10), 1 - 1e-10) AS p FROM cells)", "cells"))
def score_transforms(s, d):
    c = F.col("score")
    t = {h: distribution.transform_score(c, h) for h in ("log", "logit")}
    return cells(s, d).select("cell_id", *[r6(t[h], 9).alias(h) for h in t], *[r6(distribution.restore_score(t[h], h)).alias(f"{h}_back") for h in t])


@query()
def score_probit(s, d):
    y = distribution.transform_score(F.col("score"), "probit")
    return cells(s, d).select("cell_id", y.alias("probit")).withColumn("back", distribution.restore_score(F.col("probit"), "probit"))


@query()
def gmm_threshold(s, d):
    return doublets.thresholds(doublets.fit_mixtures(_scores(s, d), "platform", "score"), "platform")


@query(sql("SELECT cell_id, CASE WHEN score >= t THEN 'doublet' ELSE 'singlet' END AS call FROM cells JOIN (SELECT sample, quantile_cont(score, 0.94) AS t FROM cells GROUP BY 1) USING (sample)", "cells"))
def doublet_call(s, d):
    limits = cells(s, d).groupBy("sample").agg(F.percentile("score", 0.94).alias("threshold"))
    return doublets.call(_scores(s, d), limits, "sample", "score").select("cell_id", "call")


@query(sql("SELECT sample, n, round(h, 6) AS homotypic, round(0.06 * n)::BIGINT AS n_expected, round(0.06::DOUBLE * n * (1 - h))::BIGINT AS n_adjusted FROM (SELECT sample, sum(c)::BIGINT AS n, sum(c * c) / (sum(c) * sum(c)) AS h FROM (SELECT sample, cluster, count(*) AS c FROM cells GROUP BY 1, 2) GROUP BY 1)", "cells"))
def doublet_expectation(s, d):
    return doublets.expected(_scores(s, d), "sample", "cluster", 0.06).withColumn("homotypic", r6("homotypic"))


@query()
def doublet_scores(s, d):
    return doublets.simulated_scores(vectors(s, d)).select("vec_id", r6("score").alias("score"))


@query(sql("SELECT platform, round(avg((score >= t)::INT), 6) AS fraction FROM cells JOIN (SELECT platform, quantile_cont(score, 0.9) AS t FROM cells WHERE platform <> 'ASIA' GROUP BY 1) USING (platform) GROUP BY 1", "cells"))
def doublet_fraction(s, d):
    limits = cells(s, d).filter("platform <> 'ASIA'").groupBy("platform").agg(F.percentile("score", 0.9).alias("threshold"))
    return doublets.call(_scores(s, d), limits, "platform", "score", strict=False).groupBy("platform").agg(r6(F.avg((F.col("call") == "doublet").cast("int"))).alias("fraction"))


def _edges(s, d, k=10):
    near = vec_ops.nearest(vectors(s, d), k)
    one = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (1 / (1 + F.col("dist"))).alias("weight")).dropDuplicates(["a", "b"])
    return one


_SPREAD = """dd AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.vec, b.vec) AS dist FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id), kn AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS r FROM dd) WHERE r <= 10),
un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 1 / (1 + round(dist, 9)) AS w FROM kn), ed AS (SELECT a AS src, b AS dst, w FROM un UNION ALL SELECT b, a, w FROM un),
st AS (SELECT src, sum(w) AS s FROM ed GROUP BY 1), sm AS (SELECT ed.src, ed.dst, w / sqrt(x.s * y.s) AS w FROM ed JOIN st x ON x.src = ed.src JOIN st y ON y.src = ed.dst),
y0 AS (SELECT vec_id AS node, label, 1.0::DOUBLE AS y FROM vectors WHERE vec_id % 2 = 0)"""
_ROUNDS = "".join(f", y{k + 1} AS (SELECT coalesce(g.node, y0.node) AS node, coalesce(g.label, y0.label) AS label, 0.2::DOUBLE * coalesce(g, 0) + 0.8::DOUBLE * coalesce(y0.y, 0) AS y FROM (SELECT src AS node, label, sum(w * y) AS g FROM sm JOIN y{k} ON node = dst GROUP BY 1, 2) g FULL JOIN y0 ON g.node = y0.node AND g.label = y0.label)" for k in range(4))


@query(sql("SELECT node, label, round(y, 8) AS score FROM y4", "vectors", more=_SPREAD + _ROUNDS))
def label_spreading(s, d):
    near = vec_ops.nearest(vectors(s, d), 10)
    un = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (1 / (1 + F.round("dist", 9))).alias("weight")).distinct()
    un = cut(un)  # it is read several times
    edges = un.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(un.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    labels = vectors(s, d).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("node"), "label")
    return graphs.spread_labels(edges, labels, 0.2, 4).withColumn("score", r6("score", 8))


@query()
def label_transfer_grid(s, d):
    """Every alpha of the grid, with the labels it gives the unlabelled half."""
    near = cut(vec_ops.nearest(vectors(s, d), 10))
    rbf = F.exp(-F.col("dist") * F.col("dist") / 20)
    edges = near.select("src", "dst", rbf.alias("weight")).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), rbf.alias("weight"))).dropDuplicates(["src", "dst"])
    edges = cut(edges)  # every alpha reads them several times
    labels = vectors(s, d).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("node"), "label")
    out = None
    for alpha in (0.1, 0.2, 0.5, 0.8):
        got = graphs.confident(graphs.spread_labels(edges, labels, alpha, 5)).join(labels.select("node"), "node", "left_anti").withColumn("alpha", F.lit(alpha))
        out = got if out is None else out.unionByName(got)
    return out


@query()
def pca_variance(s, d):
    return reduction.principal_components(vectors(s, d), 50)[2]


@query()
def pca_scores(s, d):
    return reduction.principal_components(vectors(s, d), 10)[0]


@query()
def pca_loading_extremes(s, d):
    from loomframe.operators.tables import extremes

    return extremes(reduction.principal_components(vectors(s, d), 5)[1], "pc", "loading", "dim", 10)


def _expression(s, d, most=2000):
    """The most variable genes' scaled entries, and all cells."""
    ln = matrix.log_normalize(counts(s, d)).select("cell_id", "gene_id", "x")
    top = matrix.variable_genes(ln).orderBy(F.round("dispersion_norm", 5).desc_nulls_last(), "gene_id").limit(most).select("gene_id")
    return matrix.scaled(ln).join(top, "gene_id", "left_semi"), ln.select("cell_id")


@query()
def expression_pca_variance(s, d):
    """The explained variance of 50 components of the scaled expression matrix."""
    return expression_pca.components(*_expression(s, d), 50).variances.select("pc", *[r6(c).alias(c) for c in ("variance", "ratio", "sd")])


@query()
def expression_pca_scores(s, d):
    return expression_pca.components(*_expression(s, d), 50).scores


@query()
def expression_pca_extremes(s, d):
    """The genes with the largest and smallest loadings of the first five components."""
    from loomframe.operators.tables import extremes

    loadings = expression_pca.components(*_expression(s, d), 5).loadings
    return extremes(loadings.withColumn("loading", r6("loading")), "pc", "loading", "gene_id", 10)


@query()
def expression_elbow(s, d):
    """How many components stand before the standard deviation falls below 1.5 times the mean of the last ten."""
    from loomframe.operators.tables import leading_count

    sd = expression_pca.components(*_expression(s, d), 50).variances.select(F.lit("expression").alias("reduction"), "pc", "sd")
    return leading_count(sd, ["reduction"], "pc", "sd").withColumn("threshold", r6("threshold"))


@query()
def vst_top_genes(s, d):
    return reduction.top_genes(reduction.smoothed_variance(counts(s, d)), 500)


@query()
def communities(s, d):
    return graphs.communities(_edges(s, d)).select(F.col("node").alias("vec_id"), "community")


@query()
def leaf_order(s, d):
    from loomframe.model import soft_labels

    m = vec_ops.fuzzy_overlap(soft_labels(s, d))
    return graphs.leaf_order(m.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("ochiai")).alias("value")))


@query(sql("SELECT label, round(avg(fc), 6) + 0.0::DOUBLE AS mean, round(any_value(low), 6) + 0.0::DOUBLE AS low, round(any_value(high), 6) + 0.0::DOUBLE AS high FROM lf JOIN hd USING (label) GROUP BY 1", "runs", more="""dr AS (SELECT params AS draw, label, avg(value) / 100 AS alpha, max(value) / 200 AS beta FROM (SELECT params, event_type AS label, value FROM runs) GROUP BY 1, 2),
ex AS (SELECT *, exp(alpha - max(alpha) OVER (PARTITION BY draw)) AS e0, exp(alpha + beta - max(alpha + beta) OVER (PARTITION BY draw)) AS e1 FROM dr),
lf AS (SELECT draw, label, (ln((e1 / sum(e1) OVER (PARTITION BY draw)) + 1e-12) - ln((e0 / sum(e0) OVER (PARTITION BY draw)) + 1e-12)) / ln(2) AS fc FROM ex),
o AS (SELECT label, fc, row_number() OVER (PARTITION BY label ORDER BY fc) AS i, count(*) OVER (PARTITION BY label) AS n FROM lf),
hd AS (SELECT label, low, high FROM (SELECT a.label, a.fc AS low, b.fc AS high, row_number() OVER (PARTITION BY a.label ORDER BY round(b.fc - a.fc, 9), a.i) AS r FROM o a JOIN o b ON a.label = b.label AND b.i = a.i + floor(0.95::DOUBLE * a.n)) WHERE r = 1)"""))
def posterior_log2fc_hdi(s, d):
    draws = runs(s, d).groupBy(F.col("params").alias("draw"), F.col("event_type").alias("label")).agg((F.avg("value") / 100).alias("alpha"), (F.max("value") / 200).alias("beta"))
    out = posterior.summary(posterior.log2_changes(draws), 0.95)
    return out.select("label", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query(sql("SELECT sample, cluster, round(l - avg(l) OVER (PARTITION BY sample), 6) + 0.0::DOUBLE AS clr FROM (SELECT sample, cluster, ln(count(*) + 0.5::DOUBLE) AS l FROM cells GROUP BY 1, 2)", "cells"))
def composition_clr(s, d):
    n = cells(s, d).groupBy("sample", "cluster").agg(F.count("*").alias("n"))
    return posterior.centred_log_ratio(n, "sample", "cluster").withColumn("clr", r6("clr"))


# networks

_NET = "e AS (SELECT c.platform AS source, c.cluster AS target, g.grp AS pathway, sum(count) / 1000 AS prob FROM counts JOIN cells c USING (cell_id) JOIN genes g USING (gene_id) WHERE c.diagnosis = 'case' GROUP BY 1, 2, 3)"


def _net(s, d, diagnosis="case"):
    c = cells(s, d).filter(F.col("diagnosis") == diagnosis).select("cell_id", F.col("platform").alias("source"), F.col("cluster").alias("target"))
    g = genes(s, d).select("gene_id", F.col("grp").alias("pathway"))
    return counts(s, d).join(c, "cell_id").join(g, "gene_id").groupBy("source", "target", "pathway").agg((F.sum("count") / 1000).alias("prob"))


@query(sql("SELECT coalesce(a.node, b.node) AS node, coalesce(out_degree, 0) AS out_degree, round(coalesce(out_strength, 0), 6) AS out_strength, coalesce(in_degree, 0) AS in_degree, round(coalesce(in_strength, 0), 6) AS in_strength FROM (SELECT source AS node, count(DISTINCT target) AS out_degree, sum(prob) AS out_strength FROM e GROUP BY 1) a FULL JOIN (SELECT target AS node, count(DISTINCT source) AS in_degree, sum(prob) AS in_strength FROM e GROUP BY 1) b ON a.node = b.node", "counts", "cells", "genes", more=_NET))
def network_strength(s, d):
    return network.strengths(_net(s, d)).withColumns({c: r6(c) for c in ("out_strength", "in_strength")})


@query(sql("SELECT pathway, source, target, count(*) AS n, round(sum(prob), 6) AS strength FROM e GROUP BY 1, 2, 3", "counts", "cells", "genes", more=_NET))
def network_by_pathway(s, d):
    return network.aggregate(_net(s, d), ("pathway",)).withColumn("strength", r6("strength"))


_LR = """lx AS (SELECT cell_id, gene_id % 40 + 1 AS gene_id, sum(count) AS x FROM counts GROUP BY 1, 2),
av AS (SELECT cluster, gene_id, (quantile_cont(x, 0.25) + 2 * quantile_cont(x, 0.5) + quantile_cont(x, 0.75)) / 4 AS t FROM (SELECT c.cluster, g.gene_id, coalesce(l.x, 0) AS x FROM (SELECT cell_id, cluster FROM cells WHERE cell_id IN (SELECT cell_id FROM counts)) c CROSS JOIN (SELECT gene_id FROM genes WHERE gene_id <= 40) g LEFT JOIN lx l ON l.cell_id = c.cell_id AND l.gene_id = g.gene_id) GROUP BY 1, 2),
pr AS (SELECT i AS ligand, i % 40 + 1 AS receptor, 'path' || (i % 4) AS pathway FROM range(1, 31) t(i))"""


@query(sql("SELECT a.cluster AS source, b.cluster AS target, ligand, receptor, pathway, round(a.t * b.t / (0.5::DOUBLE + a.t * b.t), 6) AS prob FROM pr JOIN av a ON a.gene_id = ligand JOIN av b ON b.gene_id = receptor WHERE a.t * b.t > 0", "counts", "cells", "genes", more=_LR))
def lr_probability(s, d):
    folded = counts(s, d).groupBy("cell_id", (F.col("gene_id") % 40 + 1).alias("gene_id")).agg(F.sum("count").alias("x"))
    groups = cells(s, d).join(counts(s, d).select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "cluster")
    i = F.col("id")
    pairs = s.range(1, 31).select(i.alias("ligand"), (i % 40 + 1).alias("receptor"), F.concat(F.lit("path"), (i % 4).cast("string")).alias("pathway"))
    out = network.interaction_probability(matrix.trimean(folded, groups, "cluster"), pairs, "cluster")
    return out.withColumn("prob", r6("prob"))


@query(sql("SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, round(coalesce(a.p, 0), 6) AS strength_a, round(coalesce(b.p, 0), 6) AS strength_b, round(coalesce(b.p, 0) - coalesce(a.p, 0), 6) + 0.0::DOUBLE AS difference FROM (SELECT source, target, sum(prob) AS p FROM e GROUP BY 1, 2) a FULL JOIN (SELECT c.platform AS source, c.cluster AS target, sum(count) / 1000 AS p FROM counts JOIN cells c USING (cell_id) WHERE c.diagnosis = 'normal' GROUP BY 1, 2) b ON a.source = b.source AND a.target = b.target", "counts", "cells", "genes", more=_NET))
def edge_compare(s, d):
    return network.compare(_net(s, d), _net(s, d, "normal")).withColumns({c: r6(c) for c in ("strength_a", "strength_b", "difference")})


@query(sql("SELECT a, b, round(s / (na + nb - s), 6) AS jaccard FROM (SELECT x.pathway AS a, y.pathway AS b, count(*) AS s FROM f x JOIN f y ON x.source = y.source AND x.target = y.target AND x.pathway < y.pathway GROUP BY 1, 2) JOIN (SELECT pathway AS a, count(*) AS na FROM f GROUP BY 1) USING (a) JOIN (SELECT pathway AS b, count(*) AS nb FROM f GROUP BY 1) USING (b)", "counts", "cells", "genes", more=_NET + ", f AS (SELECT * FROM e WHERE prob > 1)"))
def network_jaccard(s, d):
    return network.edge_jaccard(_net(s, d).filter("prob > 1")).withColumn("jaccard", r6("jaccard"))


@query()
def integration_scores(s, d):
    """One row: mean LISI, scaled silhouette, and agreement of communities with the labels."""
    v = vectors(s, d)
    near = vec_ops.nearest(v, 10)
    mixed = vec_ops.simpson(near, v).agg(F.avg("lisi").alias("lisi"))
    width = vec_ops.silhouette(v).agg(((F.avg("width") + 1) / 2).alias("silhouette"))
    found = v.join(communities(s, d), "vec_id")
    return mixed.crossJoin(width).crossJoin(vec_ops.agreement(found, "label", "community"))  # one row each
