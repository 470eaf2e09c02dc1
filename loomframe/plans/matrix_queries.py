"""Matrix, neighbour and differential queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.model import cells, counts, genes, r6, read, soft_labels, sql, vectors
from loomframe.operators import filters, matrix
from loomframe.operators import vectors as vec_ops
from loomframe.plans.registry import query


def _ln(s, d):
    return matrix.log_normalize(counts(s, d)).select("cell_id", "gene_id", "x")


@query(sql("SELECT cell_id, gene_id, round(x, 6) AS x FROM lognorm", "lognorm"))
def log_normalize(s, d):
    return _ln(s, d).withColumn("x", r6("x"))


_HVG = """m AS (SELECT gene_id, sum(e) / any_value(n) AS mu, (sum(e * e) - any_value(n) * (sum(e) / any_value(n)) * (sum(e) / any_value(n))) / (any_value(n) - 1) AS v FROM (SELECT gene_id, exp(x) - 1 AS e FROM lognorm), ncells GROUP BY 1),
g AS (SELECT gene_id, ln(1 + mu) AS mean, ln(v / mu) AS dispersion FROM m),
b AS (SELECT *, least(19, floor((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20))::BIGINT AS bin FROM g),
h AS (SELECT *, CASE WHEN coalesce(stddev_samp(dispersion) OVER w, 0) = 0 THEN 1.0::DOUBLE ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END AS dispersion_norm FROM b WINDOW w AS (PARTITION BY bin))"""


@query(sql("SELECT gene_id, round(mean, 5) AS mean, round(dispersion, 5) AS dispersion, bin, round(dispersion_norm, 5) + 0.0::DOUBLE AS dispersion_norm FROM h", "lognorm", "ncells", more=_HVG))
def hvg_dispersion(s, d):
    return matrix.variable_genes(_ln(s, d)).select("gene_id", "bin", *[r6(c, 5).alias(c) for c in ("mean", "dispersion", "dispersion_norm")])


@query(sql("SELECT gene_id FROM h WHERE mean BETWEEN 0.5 AND 10 AND dispersion_norm >= 0.5", "lognorm", "ncells", more=_HVG))
def mean_dispersion_window(s, d):
    return matrix.variable_genes(_ln(s, d)).filter("mean BETWEEN 0.5 AND 10 AND dispersion_norm >= 0.5").select("gene_id")


_BATCH = """l AS (SELECT platform, cell_id, gene_id, exp(x) - 1 AS e FROM lognorm JOIN cells USING (cell_id)), nb AS (SELECT platform, count(DISTINCT cell_id) AS n FROM l GROUP BY 1),
m AS (SELECT platform, gene_id, sum(e) / any_value(n) AS mu, (sum(e * e) - any_value(n) * (sum(e) / any_value(n)) * (sum(e) / any_value(n))) / (any_value(n) - 1) AS v FROM l JOIN nb USING (platform) GROUP BY 1, 2),
g AS (SELECT platform, gene_id, ln(1 + mu) AS mean, ln(v / mu) AS dispersion FROM m),
b AS (SELECT *, least(19, floor((mean - min(mean) OVER p) / (max(mean) OVER p - min(mean) OVER p) * 20))::BIGINT AS bin FROM g WINDOW p AS (PARTITION BY platform)),
h AS (SELECT *, CASE WHEN coalesce(stddev_samp(dispersion) OVER w, 0) = 0 THEN 1.0::DOUBLE ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END AS dn FROM b WINDOW w AS (PARTITION BY platform, bin)),
t AS (SELECT platform, gene_id, dn, row_number() OVER (PARTITION BY platform ORDER BY round(dn, 5) DESC, gene_id) <= 200 AS hit FROM h)"""


@query(sql("SELECT gene_id, n_batches, rank FROM (SELECT gene_id, n_batches, row_number() OVER (ORDER BY n_batches DESC, round(dn, 5) DESC, gene_id) AS rank FROM (SELECT gene_id, count(*) FILTER (hit) AS n_batches, avg(dn) AS dn FROM t GROUP BY 1)) WHERE rank <= 200", "lognorm", "cells", more=_BATCH))
def batch_hvg(s, d):
    both = _ln(s, d).join(cells(s, d).select("cell_id", "platform"), "cell_id")
    h = matrix.variable_genes(both, by=["platform"])
    hit = F.row_number().over(Window.partitionBy("platform").orderBy(F.round("dispersion_norm", 5).desc(), "gene_id")) <= 200
    per = h.withColumn("hit", hit).groupBy("gene_id").agg(F.count_if("hit").alias("n_batches"), F.avg("dispersion_norm").alias("dn"))
    top = per.orderBy(F.col("n_batches").desc(), F.round("dn", 5).desc(), "gene_id").limit(200)
    return top.select("gene_id", "n_batches", F.row_number().over(Window.orderBy(F.col("n_batches").desc(), F.round("dn", 5).desc(), "gene_id")).cast("long").alias("rank"))


_SCORE = """r AS (SELECT gene_id, ntile(10) OVER (ORDER BY round(sum(x), 6), gene_id) AS bin, gene_id IN (SELECT gene_id FROM genes WHERE is_mt) AS m FROM lognorm GROUP BY 1),
u AS (SELECT gene_id, m FROM r WHERE bin IN (SELECT bin FROM r WHERE m)), k AS (SELECT count(*) FILTER (m) AS a, count(*) FILTER (NOT m) AS b FROM u)"""


@query(sql("SELECT cell_id, round(coalesce(sum(x) FILTER (m), 0) / any_value(a) - coalesce(sum(x) FILTER (NOT m), 0) / any_value(b), 6) + 0.0::DOUBLE AS score FROM lognorm LEFT JOIN u USING (gene_id), k GROUP BY 1", "lognorm", "genes", more=_SCORE))
def set_score(s, d):
    return matrix.set_score(_ln(s, d), genes(s, d).filter("is_mt").select("gene_id")).select("cell_id", r6("score").alias("score"))


_MOM = "m AS MATERIALIZED (SELECT gene_id, sum(x) / any_value(n) AS mu, (sum(x * x) - any_value(n) * (sum(x) / any_value(n)) * (sum(x) / any_value(n))) / (any_value(n) - 1) AS v FROM lognorm, ncells GROUP BY 1)"


@query(sql("SELECT cell_id, gene_id, round(least(10, (x - mu) / sqrt(v)), 5) AS z, round(least(10, -mu / sqrt(v)), 5) AS zero FROM lognorm JOIN m USING (gene_id)", "lognorm", "ncells", more=_MOM))
def scaled_expression(s, d):
    return matrix.scaled(_ln(s, d)).select("cell_id", "gene_id", r6("z", 5).alias("z"), r6("zero", 5).alias("zero"))


@query(sql("SELECT gene_id, round(ka, 6) + 0.0::DOUBLE AS ka, round(kb, 6) + 0.0::DOUBLE AS kb, round((sy - ka * sa - kb * sb) / n, 6) + 0.0::DOUBLE AS k0 FROM (SELECT *, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) AS ka, (caa * cby - cab * cay) / (caa * cbb - cab * cab) AS kb FROM (SELECT *, saa - sa * sa / n AS caa, sbb - sb * sb / n AS cbb, sab - sa * sb / n AS cab, say - sa * sy / n AS cay, sby - sb * sy / n AS cby FROM (SELECT gene_id, sum(x) AS sy, sum(x * a) AS say, sum(x * b) AS sby FROM lognorm JOIN c USING (cell_id) GROUP BY 1), (SELECT count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM c)))", "lognorm", "qc", more="c AS (SELECT cell_id, log1p_total AS a, pct_mt / 100 AS b FROM qc)"))
def regress_out(s, d):
    from loomframe.operators import qc

    c = qc.cell_metrics(counts(s, d), genes(s, d)).select("cell_id", F.col("log1p_total").alias("a"), (F.col("pct_mt") / 100).alias("b"))
    return matrix.regress_out(_ln(s, d), c, "a", "b").select("gene_id", *[r6(k).alias(k) for k in ("k0", "ka", "kb")])


_GRP = """sz AS (SELECT cluster, count(*) AS n FROM cells WHERE cell_id IN (SELECT cell_id FROM counts) GROUP BY 1), tot AS (SELECT sum(n) AS nn FROM sz),
pg AS (SELECT cluster, gene_id, count(*) FILTER (x > 0) AS pos, sum(exp(x) - 1) AS raw FROM lognorm JOIN cells USING (cell_id) GROUP BY 1, 2),
al AS (SELECT gene_id, sum(pos)::BIGINT AS ap, sum(raw) AS ar FROM pg GROUP BY 1),
f AS (SELECT cluster, gene_id, 100 * pos / n AS pct_in, 100 * (ap - pos) / (nn - n) AS pct_rest, raw / n AS e1, (ar - raw) / (nn - n) AS e2 FROM pg JOIN al USING (gene_id) JOIN sz USING (cluster), tot)"""


def _groups(s, d):
    return cells(s, d).join(counts(s, d).select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "cluster")


def _in_rest(s, d):
    p = matrix.in_and_rest(matrix.group_expression(_ln(s, d), _groups(s, d), "cluster"), "cluster")
    return p.select("cluster", "gene_id", (100 * F.col("n_pos") / F.col("n")).alias("pct_in"), (100 * F.col("n_pos_rest") / F.col("n_rest")).alias("pct_rest"), (F.col("sum_raw") / F.col("n")).alias("e1"), (F.col("sum_rest") / F.col("n_rest")).alias("e2"))


@query(sql("SELECT cluster, gene_id, round(pct_in, 6) AS pct_in, round(pct_rest, 6) AS pct_rest, round(pct_in - pct_rest, 6) + 0.0::DOUBLE AS pct_diff, round(pct_in / (pct_rest + 1), 6) AS ratio FROM f", "lognorm", "cells", more=_GRP))
def pct_expressed(s, d):
    i, r = F.col("pct_in"), F.col("pct_rest")
    return _in_rest(s, d).select("cluster", "gene_id", r6(i).alias("pct_in"), r6(r).alias("pct_rest"), r6(i - r).alias("pct_diff"), r6(i / (r + 1)).alias("ratio"))


@query(sql("SELECT cluster, gene_id, round(e1, 5) AS mean_raw, round(ln(1 + e1), 6) AS avg_exp FROM f", "lognorm", "cells", more=_GRP))
def pseudobulk(s, d):
    return _in_rest(s, d).select("cluster", "gene_id", r6("e1", 5).alias("mean_raw"), r6(F.log1p("e1")).alias("avg_exp"))


@query(sql("SELECT cluster, gene_id, round(pct_in, 6) AS pct_in FROM f JOIN genes USING (gene_id) WHERE pct_in >= 2 AND pct_rest <= 2 AND NOT regexp_matches(gene_name, '^(hot|red)') AND gene_id NOT IN (SELECT gene_id FROM genes WHERE grp = 'Brand#11')", "lognorm", "cells", "genes", more=_GRP))
def identity_marker_filter(s, d):
    named = _in_rest(s, d).join(genes(s, d).select("gene_id", "gene_name"), "gene_id")
    panel = genes(s, d).filter("grp = 'Brand#11'").select("gene_id")
    return filters.markers(named, 2, 2, panel, "gene_id", "^(?!x)x").filter(~F.rlike("gene_name", F.lit("^(hot|red)"))).select("cluster", "gene_id", r6("pct_in").alias("pct_in"))


_RS = """e AS (SELECT gene_id, cluster, x, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2 AS r FROM (SELECT gene_id, cluster, round(x, 9) AS x FROM lognorm JOIN cells USING (cell_id))),
pr AS (SELECT gene_id, cluster, sum(r) AS rs, count(*) AS pos FROM e GROUP BY 1, 2), nz AS (SELECT gene_id, sum(pos) AS nnz FROM pr GROUP BY 1),
ti AS (SELECT gene_id, sum(t * t * t - t) AS ties FROM (SELECT gene_id, count(*)::DOUBLE AS t FROM e GROUP BY gene_id, x) GROUP BY 1),
rs AS (SELECT gene_id, cluster, n AS n1, nn - n AS n2, nn, nn - nnz AS z0, ties, (n - coalesce(pos, 0)) * (nn - nnz + 1) / 2 + coalesce(rs, 0) + coalesce(pos, 0) * (nn - nnz) AS r1 FROM nz CROSS JOIN sz LEFT JOIN pr USING (gene_id, cluster) JOIN ti USING (gene_id), tot)"""


@query(sql("SELECT cluster, gene_id, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (nn + 1) / 2) / sqrt(n1 * n2 * (nn + 1)::DOUBLE / 12), 6) + 0.0::DOUBLE AS z FROM rs", "lognorm", "cells", more=_GRP + ", " + _RS))
def rank_sum_markers(s, d):
    out = matrix.rank_sum(_ln(s, d).withColumn("x", F.round("x", 9)), _groups(s, d), "cluster")
    return out.select("cluster", "gene_id", r6("u", 4).alias("u"), r6("z").alias("z"))


@query()
def rank_sum_p_values(s, d):
    from loomframe.functions.distribution import two_sided_p

    out = matrix.rank_sum(_ln(s, d).withColumn("x", F.round("x", 9)), _groups(s, d), "cluster", tie_correct=True)
    p = out.withColumn("p", two_sided_p("z"))
    return matrix.bh_adjust(p.filter("p IS NOT NULL"), "p", ["cluster"], ["gene_id"]).select("cluster", "gene_id", "u", "z", "p", "p_adj")


_RW = """c2 AS (SELECT cell_id, cluster, diagnosis FROM cells WHERE cell_id IN (SELECT cell_id FROM counts)), s1 AS (SELECT cluster, diagnosis, count(*)::DOUBLE AS n1 FROM c2 GROUP BY 1, 2), s0 AS (SELECT cluster, sum(n1) AS nn FROM s1 GROUP BY 1),
e AS (SELECT cluster, gene_id, diagnosis, rank() OVER (PARTITION BY cluster, gene_id ORDER BY x) + (count(*) OVER (PARTITION BY cluster, gene_id, x) - 1) / 2 AS r FROM (SELECT c2.cluster, gene_id, diagnosis, round(x, 9) AS x FROM lognorm JOIN c2 USING (cell_id))),
pr AS (SELECT cluster, gene_id, diagnosis, sum(r) AS rs, count(*) AS pos FROM e GROUP BY 1, 2, 3), nz AS (SELECT cluster, gene_id, sum(pos) AS nnz FROM pr GROUP BY 1, 2),
rs AS (SELECT cluster, gene_id, diagnosis, n1, nn, (n1 - coalesce(pos, 0)) * (nn - nnz + 1) / 2 + coalesce(rs, 0) + coalesce(pos, 0) * (nn - nnz) AS r1 FROM nz JOIN s1 USING (cluster) JOIN s0 USING (cluster) LEFT JOIN pr USING (cluster, gene_id, diagnosis))"""


@query(sql("SELECT cluster, gene_id, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (nn + 1) / 2) / sqrt(n1 * (nn - n1) * (nn + 1) / 12), 6) + 0.0::DOUBLE AS z FROM rs WHERE diagnosis = 'case'", "lognorm", "cells", more=_RW))
def rank_sum_within_type(s, d):
    g = cells(s, d).join(counts(s, d).select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "cluster", "diagnosis")
    out = matrix.rank_sum(_ln(s, d).withColumn("x", F.round("x", 9)), g, "diagnosis", by=["cluster"])
    return out.filter("diagnosis = 'case'").select("cluster", "gene_id", r6("u", 4).alias("u"), r6("z").alias("z"))


@query("SELECT g, k, round(least(1.0::DOUBLE, min(p * n / r) OVER (PARTITION BY g ORDER BY p DESC, k DESC)), 9) AS p_adj, round(least(1.0::DOUBLE, p * n), 9) AS p_bonf FROM (SELECT c_mktsegment AS g, c_custkey AS k, (c_acctbal + 1000) / 11000 AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer)")
def bh_adjust(s, d):
    t = read(s, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), ((F.col("c_acctbal") + 1000) / 11000).alias("p"))
    out = matrix.bh_adjust(t, "p", ["g"], ["k"])
    return out.select("g", "k", r6("p_adj", 9).alias("p_adj"), r6(matrix.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy("g"))), 9).alias("p_bonf"))


_DEG = _GRP + ", " + _RS + ", dg AS (SELECT cluster, gene_id, pct_in / 100 AS pct_1, pct_rest / 100 AS pct_2, e1, e2, ln(e1 + 1) / ln(2) - ln(e2 + 1) / ln(2) AS fc, (r1 - n1 * (nn + 1) / 2) / sqrt(n1 * n2 * (nn + 1)::DOUBLE / 12) AS z FROM f JOIN rs USING (cluster, gene_id))"


def _deg(s, d):
    z = matrix.rank_sum(_ln(s, d).withColumn("x", F.round("x", 9)), _groups(s, d), "cluster")
    f = _in_rest(s, d).join(z, ["cluster", "gene_id"])
    return f.select("cluster", "gene_id", (F.col("pct_in") / 100).alias("pct_1"), (F.col("pct_rest") / 100).alias("pct_2"), "e1", "e2", (F.log2(F.col("e1") + 1) - F.log2(F.col("e2") + 1)).alias("avg_log2fc"), "z")


@query(sql("SELECT cluster, gene_id, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, round(e1, 5) AS avg_exp_1, round(e2, 5) AS avg_exp_2, round(fc, 5) + 0.0::DOUBLE AS avg_log2fc, round(z, 5) + 0.0::DOUBLE AS z FROM dg WHERE (pct_1 >= 0.02 OR pct_2 >= 0.02) AND abs(round(fc, 5)) >= 0.25", "lognorm", "cells", more=_DEG))
def deg_table(s, d):
    t = _deg(s, d).filter(((F.col("pct_1") >= 0.02) | (F.col("pct_2") >= 0.02)) & (F.abs(F.round("avg_log2fc", 5)) >= 0.25))
    return t.select("cluster", "gene_id", r6("pct_1").alias("pct_1"), r6("pct_2").alias("pct_2"), r6("e1", 5).alias("avg_exp_1"), r6("e2", 5).alias("avg_exp_2"), r6("avg_log2fc", 5).alias("avg_log2fc"), r6("z", 5).alias("z"))


@query(sql("SELECT cluster, gene_id, round(fc, 5) AS avg_log2fc FROM dg WHERE abs(round(fc, 5)) > 1 AND abs(round(z, 5)) > 0.5 AND (pct_1 > 0.02 OR pct_2 > 0.02) AND gene_id NOT IN (1, 2, 3)", "lognorm", "cells", more=_DEG))
def deg_filter(s, d):
    # the oracle has no normal tail: |z| stands for the adjusted p
    t = _deg(s, d).withColumns({"avg_log2fc": F.round("avg_log2fc", 5), "p_val_adj": -F.abs(F.round("z", 5))})
    return filters.differential(t, 1, -0.5, 0.02, exclude=[1, 2, 3]).select("cluster", "gene_id", r6("avg_log2fc", 5).alias("avg_log2fc"))


@query(sql("SELECT cluster, gene_id, round(fc, 5) AS avg_log2fc FROM dg WHERE round(fc, 5) >= 2 AND round(z, 5) >= 1 AND gene_id NOT IN (SELECT gene_id FROM genes WHERE grp = 'Brand#11')", "lognorm", "cells", "genes", more=_DEG))
def de_marker_filter(s, d):
    t = _deg(s, d).filter((F.round("avg_log2fc", 5) >= 2) & (F.round("z", 5) >= 1))
    return t.join(genes(s, d).filter("grp = 'Brand#11'").select("gene_id"), "gene_id", "left_anti").select("cluster", "gene_id", r6("avg_log2fc", 5).alias("avg_log2fc"))


@query(sql("SELECT cluster, gene_id, round((quantile_cont(x, 0.25) + 2 * quantile_cont(x, 0.5) + quantile_cont(x, 0.75)) / 4, 6) AS trimean FROM (SELECT c.cluster, g.gene_id, coalesce(l.x, 0) AS x FROM (SELECT cell_id, cluster FROM cells WHERE cell_id IN (SELECT cell_id FROM counts)) c CROSS JOIN genes g LEFT JOIN lognorm l ON l.cell_id = c.cell_id AND l.gene_id = g.gene_id) GROUP BY 1, 2 HAVING max(x) > 0", "lognorm", "cells", "genes"))
def trimean(s, d):
    out = matrix.trimean(_ln(s, d), _groups(s, d), "cluster")
    return out.select("cluster", "gene_id", r6("trimean").alias("trimean"))


@query(sql("SELECT a, b, round(o, 6) AS overlap, round(o / nullif(sqrt(ta * tb), 0), 6) AS ochiai FROM (SELECT x.label AS a, y.label AS b, sum(least(x.prob, y.prob)) AS o FROM soft x JOIN soft y USING (cell_id) GROUP BY 1, 2) JOIN (SELECT label AS a, sum(prob) AS ta FROM soft GROUP BY 1) USING (a) JOIN (SELECT label AS b, sum(prob) AS tb FROM soft GROUP BY 1) USING (b)", "soft"))
def fuzzy_overlap(s, d):
    return vec_ops.fuzzy_overlap(soft_labels(s, d)).select("a", "b", r6("overlap").alias("overlap"), r6("ochiai").alias("ochiai"))


_V2 = "w AS (SELECT vec_id, label, vec, list_transform(vec, lambda x, i: x * x + vec[(i % 64) + 1]) AS v2 FROM vectors), u AS (SELECT vec_id, unnest(range(64))::INTEGER AS dim, unnest(vec) AS x, unnest(v2) AS y FROM w), rk AS (SELECT dim, x, y, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY dim ORDER BY y) + (count(*) OVER (PARTITION BY dim, y) - 1) / 2 AS ry FROM u)"


@query(sql("SELECT dim, round(corr(x, y), 6) + 0.0::DOUBLE AS pearson, round(corr(rx, ry), 6) + 0.0::DOUBLE AS spearman FROM rk GROUP BY 1", "vectors", more=_V2))
def embedding_correlation(s, d):
    v = vectors(s, d)
    w = v.select("vec_id", F.transform("vec", lambda x, i: x * x + F.get("vec", (i + 1) % 64)).alias("vec"))
    return vec_ops.correlations(v, w).select("dim", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


_D = "dd AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, list_distance(a.vec, b.vec) AS dist FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id), kn AS (SELECT src, dst, dist, rank, la, lb FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM dd) WHERE rank <= 10)"


@query(sql("SELECT src, dst, round(dist, 6) AS dist, rank FROM kn", "vectors", more=_D))
def knn_graph(s, d):
    return vec_ops.nearest(vectors(s, d), 10).select("src", "dst", r6("dist").alias("dist"), "rank")


@query(sql("SELECT a, b, round(s / (22 - s), 6) AS weight FROM (SELECT x.src AS a, y.src AS b, count(*) AS s FROM li x JOIN li y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2)", "vectors", more=_D + ", li AS (SELECT src, dst FROM kn UNION ALL SELECT DISTINCT src, src FROM kn)"))
def snn_jaccard(s, d):
    return vec_ops.shared_neighbours(vec_ops.nearest(vectors(s, d), 10)).select("a", "b", r6("weight").alias("weight"))


@query(sql("SELECT src AS vec_id, la AS label, round((b - a) / greatest(a, b), 6) + 0.0::DOUBLE AS width FROM (SELECT src, any_value(la) AS la, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM (SELECT src, la, lb, avg(dist) AS m FROM dd GROUP BY 1, 2, 3) GROUP BY 1)", "vectors", more=_D))
def silhouette(s, d):
    return vec_ops.silhouette(vectors(s, d)).select("vec_id", "label", r6("width").alias("width"))


@query(sql("SELECT 'vec' AS reduction, 64::BIGINT AS dim, (SELECT count(DISTINCT label) FROM vectors) AS n_clusters, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM (SELECT src, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM (SELECT src, la, lb, avg(dist) AS m FROM dd GROUP BY 1, 2, 3) GROUP BY 1)", "vectors", more=_D))
def clustering_summary(s, d):
    w = vec_ops.silhouette(vectors(s, d))
    return w.agg(F.lit("vec").alias("reduction"), F.lit(64).cast("long").alias("dim"), F.count_distinct("label").alias("n_clusters"), r6(F.avg("width")).alias("silhouette"))


@query(sql("SELECT src AS a, dst AS b, round(dist, 6) AS dist FROM dd WHERE src < dst", "vectors", more=_D))
def distance_matrix(s, d):
    return vec_ops.all_distances(vectors(s, d)).withColumn("dist", r6("dist"))


@query(sql("SELECT round((c - ca * cb / tt) / ((ca + cb) / 2 - ca * cb / tt), 9) AS ari, round(2 * (ha + hb - hj) / (ha + hb), 9) AS nmi FROM (SELECT sum(n * (n - 1) / 2) AS c, -sum(n / t * ln(n / t)) AS hj FROM j), (SELECT sum(n * (n - 1) / 2) AS ca, -sum(n / t * ln(n / t)) AS ha FROM (SELECT cluster, sum(n) AS n, any_value(t) AS t FROM j GROUP BY 1)), (SELECT sum(n * (n - 1) / 2) AS cb, -sum(n / t * ln(n / t)) AS hb FROM (SELECT platform, sum(n) AS n, any_value(t) AS t FROM j GROUP BY 1)), (SELECT any_value(t) * (any_value(t) - 1) / 2 AS tt FROM j)", "cells", more="j AS (SELECT cluster, platform, count(*)::DOUBLE AS n, (SELECT count(*) FROM cells)::DOUBLE AS t FROM cells GROUP BY 1, 2)"))
def ari_nmi(s, d):
    return vec_ops.agreement(cells(s, d), "cluster", "platform").select(r6("ari", 9).alias("ari"), r6("nmi", 9).alias("nmi"))


@query(sql("SELECT src, round(sum(n) * sum(n) / sum(n * n), 6) AS lisi FROM (SELECT src, lb, count(*) AS n FROM kn GROUP BY 1, 2) GROUP BY 1", "vectors", more=_D))
def lisi(s, d):
    v = vectors(s, d)
    return vec_ops.simpson(vec_ops.nearest(v, 10), v).select("src", r6("lisi").alias("lisi"))


@query(sql("SELECT src, lb AS label, round(n / 10, 6) AS fraction, CASE WHEN n / 10 < 0.3 THEN 'Mixed' ELSE 'label_' || lb END AS call FROM (SELECT src, lb, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, lb) AS r FROM kn GROUP BY 1, 2) WHERE r = 1", "vectors", more=_D))
def nhood_majority(s, d):
    v = vectors(s, d)
    named = vec_ops.nearest(v, 10).join(v.select(F.col("vec_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "label"))).filter("r = 1")
    return top.select("src", "label", r6(F.col("n") / 10).alias("fraction"), F.when(F.col("n") / 10 < 0.3, "Mixed").otherwise(F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("call"))


@query(sql("SELECT a.src AS a, b.src AS b, count(*) AS shared FROM kn a JOIN kn b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2", "vectors", more=_D))
def nhood_overlap(s, d):
    k = vec_ops.nearest(vectors(s, d), 10)
    l, r = k.select(F.col("src").alias("a"), "dst"), k.select(F.col("src").alias("b"), "dst")
    return l.join(r, "dst").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
