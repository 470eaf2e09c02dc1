"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.model import cells, counts, genes, r6, read, runs, sql
from loomframe.operators import joins, tables
from loomframe.plans.registry import query
from loomframe.sources.sinks import quantile_report, summary_json

# joins


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'built' WHEN 'MACHINERY' THEN 'made' END AS kind FROM customer")
def annot_left_join(s, d):
    kinds = s.createDataFrame([("BUILDING", "built"), ("MACHINERY", "made")], "c_mktsegment string, kind string")
    return joins.annotate(read(s, d, "customer").select("c_custkey", "c_mktsegment"), read(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("m")), "c_custkey").drop("m").join(F.broadcast(kinds), "c_mktsegment", "left").select("c_custkey", "c_mktsegment", "kind")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, round(100 * coalesce(na, 0) / sum(coalesce(na, 0)) OVER (), 6) AS pct_a, round(100 * coalesce(nb, 0) / sum(coalesce(nb, 0)) OVER (), 6) AS pct_b FROM (SELECT c_nationkey AS k, count(*) AS na FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS nb FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k")
def count_full_outer(s, d):
    a = read(s, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("na"))
    b = read(s, d, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("nb"))
    out = tables.percent_of_total(tables.percent_of_total(joins.outer_counts(a, b, "k"), "na", "pct_a"), "nb", "pct_b")
    return out.select("k", "na", "nb", r6("pct_a").alias("pct_a"), r6("pct_b").alias("pct_b"))


@query(sql("SELECT gene_id, gene_name, 'in' AS side FROM genes WHERE gene_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT gene_id, gene_name, 'out' FROM genes WHERE gene_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", "genes"))
def panel_semi_anti(s, d):
    panel = read(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("gene_id")).distinct()
    g = genes(s, d).select("gene_id", "gene_name")
    return g.join(panel, "gene_id", "left_semi").withColumn("side", F.lit("in")).unionByName(g.join(panel, "gene_id", "left_anti").withColumn("side", F.lit("out")))


_CODE = "translate(lpad((k % 9000)::VARCHAR, 4, '0') || lpad((k * 7 % 1000)::VARCHAR, 4, '0'), '0123456789', 'ACGTACGTAC')"


@query(f"WITH a AS (SELECT o_orderkey AS id, o_custkey AS k FROM orders), l AS (SELECT id, {_CODE} || {_CODE} || '-1' AS key FROM a), r AS (SELECT id, key FROM (SELECT id, {_CODE} || {_CODE} || '-1' AS key, row_number() OVER (PARTITION BY {_CODE} ORDER BY id) AS n FROM (SELECT c_custkey AS id, c_custkey AS k FROM customer)) WHERE n = 1) SELECT l.id AS left_id, r.id AS right_id, key FROM l JOIN r USING (key)")
def barcode_match(s, d):
    def code(k):
        half = F.translate(F.concat(F.lpad((k % 9000).cast("string"), 4, "0"), F.lpad((k * 7 % 1000).cast("string"), 4, "0")), "0123456789", "ACGTACGTAC")
        return F.concat(half, half)

    a = read(s, d, "orders").select(F.col("o_orderkey").alias("left_id"), F.concat(F.lit("s1_"), code(F.col("o_custkey"))).alias("x"))
    b = read(s, d, "customer").select(F.col("c_custkey").alias("right_id"), F.concat(code(F.col("c_custkey")), F.lit("-1")).alias("y"))
    both = joins.match_normalised(a, b, joins.core_barcode(F.col("x")), joins.core_barcode(F.col("y")), ["right_id"])
    return both.select("left_id", "right_id", joins.core_barcode(F.col("x")).alias("key"))


@query(sql("SELECT a.cluster AS a, b.cluster AS b, k, a.cluster < b.cluster AS strict FROM (SELECT DISTINCT cluster FROM cells) a, (SELECT DISTINCT cluster FROM cells) b, (SELECT unnest([10, 20, 30, 50])::BIGINT AS k) WHERE a.cluster <= b.cluster", "cells"))
def pair_grid(s, d):
    ks = s.createDataFrame([(k,) for k in (10, 20, 30, 50)], "k long")
    pairs = joins.ordered_pairs(cells(s, d), "cluster")
    return joins.grid(pairs, ks).withColumn("strict", F.col("a") < F.col("b"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def composite_left_join(s, d):
    n, r = read(s, d, "nation"), read(s, d, "region")
    sup = read(s, d, "supplier").select("s_suppkey", "s_nationkey")
    one = sup.join(F.broadcast(n), (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_nationkey") % 2 == 0), "left")
    return one.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query(sql("SELECT gene_id, sum(CASE WHEN platform = 'ASIA' THEN count ELSE 0 END) AS asia, sum(CASE WHEN platform = 'EUROPE' THEN count ELSE 0 END) AS europe FROM counts JOIN cells USING (cell_id) WHERE platform IN ('ASIA', 'EUROPE') GROUP BY 1", "counts", "cells"))
def outer_align(s, d):
    both = counts(s, d).join(cells(s, d).select("cell_id", "platform"), "cell_id")
    part = lambda p: both.filter(F.col("platform") == p).select("cell_id", "gene_id", "count", "platform")
    out = joins.outer_align(part("ASIA"), part("EUROPE"))
    return tables.pivot_sum(out, "gene_id", "platform", ["ASIA", "EUROPE"], F.col("count")).select("gene_id", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"))


@query(sql("SELECT sample, count(*) AS n_before, count(*) FILTER (score < 0.9) AS n_after FROM cells GROUP BY 1", "cells"))
def before_after_pairs(s, d):
    c = cells(s, d)
    a = c.groupBy("sample").agg(F.count("*").alias("n_before"))
    b = c.groupBy("sample").agg(F.count_if(F.col("score") < 0.9).alias("n_after"))
    return a.join(b, "sample")


@query("SELECT l_orderkey, l_linenumber, p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def gene_lookup(s, d):
    p = read(s, d, "part").filter("p_size > 25").select("p_partkey", "p_size")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_size")


@query(sql("SELECT cell_id, r FROM cells LEFT JOIN (SELECT cell_id, row_number() OVER (ORDER BY score DESC, cell_id) AS r FROM cells WHERE diagnosis = 'case' AND cluster = 'BUILDING') USING (cell_id)", "cells"))
def scatter_back(s, d):
    c = cells(s, d)
    part = c.filter("diagnosis = 'case' AND cluster = 'BUILDING'").select("cell_id", F.row_number().over(Window.orderBy(F.col("score").desc(), "cell_id")).cast("long").alias("r"))
    return joins.scatter(c, part, "cell_id")


# aggregates


@query(sql("SELECT a.sample, b.cluster, count(c.cell_id) AS n FROM (SELECT DISTINCT sample FROM cells) a CROSS JOIN (SELECT DISTINCT cluster FROM cells) b LEFT JOIN cells c ON c.sample = a.sample AND c.cluster = b.cluster GROUP BY 1, 2", "cells"))
def contingency_zero_filled(s, d):
    return tables.contingency(cells(s, d), "sample", "cluster")


@query(sql("SELECT sample, count(*) FILTER (cluster = 'BUILDING') AS building, count(*) FILTER (cluster = 'MACHINERY') AS machinery FROM cells GROUP BY 1", "cells"))
def composition_pivot(s, d):
    out = tables.pivot_sum(cells(s, d), "sample", "cluster", ["BUILDING", "MACHINERY"], F.lit(1))
    return out.select("sample", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"))


@query(sql("SELECT sample, cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share FROM cells GROUP BY 1, 2", "cells"))
def composition_share(s, d):
    return tables.shares(cells(s, d), ["sample"], "cluster").withColumn("share", r6("share"))


@query(sql("SELECT sample, cluster, n FROM (SELECT sample, cluster, count(*) AS n, rank() OVER (PARTITION BY sample ORDER BY count(*) DESC) AS r FROM cells GROUP BY 1, 2) WHERE r = 1", "cells"))
def dominant_category(s, d):
    return tables.dominant(cells(s, d), "sample", "cluster")


@query(sql("SELECT cluster, count(*) FILTER (score >= 0.9) AS n_hit, round(avg((score >= 0.9)::INT), 6) AS fraction FROM cells GROUP BY 1", "cells"))
def conditional_fraction(s, d):
    hit = F.col("score") >= 0.9
    return cells(s, d).groupBy("cluster").agg(F.count_if(hit).alias("n_hit"), r6(F.avg(hit.cast("int"))).alias("fraction"))


@query(sql("SELECT params, epoch, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY params ORDER BY value, epoch) AS r FROM runs) WHERE r = 1", "runs"))
def best_epoch(s, d):
    return tables.first_by(runs(s, d), ["params"], ["value", "epoch"]).select("params", "epoch", r6("value").alias("value"))


@query(sql("SELECT params, round(last, 6) AS last FROM (SELECT params, coalesce(arg_max(value, epoch) FILTER (value IS NOT NULL), 'Infinity'::DOUBLE) AS last FROM (SELECT params, epoch, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM runs) GROUP BY 1) ORDER BY last, params LIMIT 20", "runs"))
def last_loss_topn(s, d):
    data = runs(s, d).withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
    return tables.last_value(data, "params", "value", "epoch").orderBy("last", "params").limit(20).select("params", r6("last").alias("last"))


@query(sql("SELECT cluster, n, round_even(mean, 0) AS mean_umi, round_even(overall, 0) AS overall, r = 1 AS least FROM (SELECT *, row_number() OVER (ORDER BY n, cluster) AS r FROM (SELECT cluster, count(*) AS n, avg(total) AS mean, any_value(o) AS overall FROM qc JOIN cells USING (cell_id), (SELECT avg(total) AS o FROM qc) GROUP BY 1))", "qc", "cells"))
def cluster_umi_summary(s, d):
    total = counts(s, d).groupBy("cell_id").agg(F.sum("count").alias("total"))
    overall = total.agg(F.avg("total").alias("o"))
    by = total.join(cells(s, d).select("cell_id", "cluster"), "cell_id").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("total").alias("mean")).crossJoin(F.broadcast(overall))
    return by.select("cluster", "n", F.bround("mean", 0).alias("mean_umi"), F.bround("o", 0).alias("overall"), (F.row_number().over(Window.orderBy("n", "cluster")) == 1).alias("least"))


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 0 THEN b WHEN s_suppkey % 5 = 0 THEN a ELSE (a + b) / 2 END, 6) AS mean, round(0.4::DOUBLE * a + 0.6::DOUBLE * b, 6) AS composite FROM (SELECT s_suppkey, s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier)")
def composite_score(s, d):
    k = F.col("s_suppkey")
    t = read(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    t = t.withColumns({"x": F.when(k % 3 != 0, F.col("a")), "y": F.when((k % 5 != 0) | (k % 3 == 0), F.col("b"))})
    return t.select("s_suppkey", r6(tables.mean_of_present("x", "y")).alias("mean"), r6(0.4 * F.col("a") + 0.6 * F.col("b")).alias("composite"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations, count(*) FILTER (c_acctbal < 0) AS n_case, count(*) FILTER (c_acctbal >= 0) AS n_normal, round(min(c_acctbal) - 0.05::DOUBLE * (max(c_acctbal) - min(c_acctbal)), 6) AS lo, round(max(c_acctbal) + 0.05::DOUBLE * (max(c_acctbal) - min(c_acctbal)), 6) AS hi FROM customer GROUP BY 1")
def condition_counts(s, d):
    v, pad = F.col("c_acctbal"), 0.05
    span = F.max(v) - F.min(v)
    return read(s, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("n_nations"), F.count_if(v < 0).alias("n_case"), F.count_if(v >= 0).alias("n_normal"), r6(F.min(v) - pad * span).alias("lo"), r6(F.max(v) + pad * span).alias("hi"))


@query(sql("SELECT a.sample, b.cluster, count(c.cell_id) FILTER (c.diagnosis = 'case') AS n_case, count(c.cell_id) AS n FROM (SELECT DISTINCT sample FROM cells) a CROSS JOIN (SELECT DISTINCT cluster FROM cells) b LEFT JOIN cells c ON c.sample = a.sample AND c.cluster = b.cluster GROUP BY 1, 2", "cells"))
def sample_type_counts(s, d):
    c = cells(s, d)
    some = c.filter("diagnosis = 'case'").groupBy("sample", "cluster").agg(F.count("*").alias("n_case"))
    return tables.contingency(c, "sample", "cluster").join(some, ["sample", "cluster"], "left").na.fill(0, ["n_case"])


@query("SELECT s_nationkey, min(s_acctbal) AS lo, round(quantile_cont(s_acctbal, 0.25), 6) AS q1, round(median(s_acctbal), 6) AS med, round(quantile_cont(s_acctbal, 0.75), 6) AS q3, max(s_acctbal) AS hi, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY 1")
def five_number(s, d):
    v = "s_acctbal"
    q = lambda p: r6(F.percentile(v, p))
    return read(s, d, "supplier").groupBy("s_nationkey").agg(F.min(v).alias("lo"), q(0.25).alias("q1"), q(0.5).alias("med"), q(0.75).alias("q3"), F.max(v).alias("hi"), r6(F.avg(v)).alias("mean"))


_QS = "[0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]"


@query(f"SELECT 'quantity' AS name, q, round(o, 6) AS observed, round(r, 6) AS replicate, round(o - r, 6) AS difference FROM (SELECT unnest({_QS}::DOUBLE[]) AS q, unnest(quantile_cont(l_quantity, {_QS})) AS o, unnest(quantile_cont(l_quantity * 2, {_QS})) AS r FROM lineitem)")
def quantile_report_rows(s, d):
    t = read(s, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 2).alias("r"))
    out = quantile_report(t, "quantity", "l_quantity", "r")
    return out.select("name", "q", *[r6(c).alias(c) for c in ("observed", "replicate", "difference")])


@query(sql("SELECT 'cell' AS axis, cell_id AS id, sum(count) AS total, count(*) AS detected, round(1 - count(*) / any_value(g), 6) AS zero_fraction, round(sum(count) / any_value(g), 6) AS mean FROM counts, (SELECT count(DISTINCT gene_id) AS g FROM counts) GROUP BY cell_id UNION ALL SELECT 'gene', gene_id, sum(count), count(*), round(1 - count(*) / any_value(c), 6), round(sum(count) / any_value(c), 6) FROM counts, (SELECT count(DISTINCT cell_id) AS c FROM counts) GROUP BY gene_id", "counts"))
def ppc_summary(s, d):
    c = counts(s, d)
    size = c.agg(F.count_distinct("gene_id").alias("gene_id"), F.count_distinct("cell_id").alias("cell_id"))  # one row

    def axis(name, key, other):
        out = c.groupBy(F.col(key).alias("id")).agg(F.sum("count").alias("total"), F.count("*").alias("detected")).crossJoin(F.broadcast(size))
        return out.select(F.lit(name).alias("axis"), "id", "total", "detected", r6(1 - F.col("detected") / F.col(other)).alias("zero_fraction"), r6(F.col("total") / F.col(other)).alias("mean"))

    return axis("cell", "cell_id", "gene_id").unionByName(axis("gene", "gene_id", "cell_id"))


# windows

_RUNS = "r AS (SELECT params, min(value) AS elbo, max(value) AS rec, avg(value) AS cyc, count(*)::DOUBLE AS kl FROM runs GROUP BY 1)"


@query(sql("SELECT params, rank_elbo, rank_rec, rank_cyc, rank_kl, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9), params) AS position FROM (SELECT *, 0.5::DOUBLE * rank_elbo + 0.2::DOUBLE * rank_rec + 0.2::DOUBLE * rank_cyc + 0.1::DOUBLE * rank_kl AS score FROM (SELECT params, rank() OVER (ORDER BY elbo) AS rank_elbo, rank() OVER (ORDER BY rec) AS rank_rec, rank() OVER (ORDER BY cyc DESC) AS rank_cyc, rank() OVER (ORDER BY kl) AS rank_kl FROM (SELECT params, elbo, rec, round(cyc, 6) AS cyc, kl FROM r)))", "runs", more=_RUNS))
def run_ranking(s, d):
    # a sum of doubles depends on their order, and the mean's last places decide its rounding: values are added by epoch, as in the SQL
    so_far = F.avg("value").over(Window.partitionBy("params").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    r = runs(s, d).withColumn("so_far", so_far).groupBy("params").agg(F.min("value").alias("elbo"), F.max("value").alias("rec"), r6(F.max_by("so_far", "epoch")).alias("cyc"), F.count("*").cast("double").alias("kl"))
    out = tables.rank_runs(r, {"elbo": (0.5, False), "rec": (0.2, False), "cyc": (0.2, True), "kl": (0.1, False)})
    return out.select("params", *[F.col(f"rank_{c}").cast("long").alias(f"rank_{c}") for c in ("elbo", "rec", "cyc", "kl")], r6("score").alias("score"), F.col("position").cast("long").alias("position"))


@query(sql("SELECT cluster, n, sum(n) OVER (ORDER BY cluster)::BIGINT AS upto FROM (SELECT cluster, count(*) AS n FROM cells GROUP BY 1)", "cells"))
def cumulative_boundary(s, d):
    n = cells(s, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
def top_markers_ties(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())
    return read(s, d, "part").select("p_brand", "p_partkey", "p_size").withColumn("_r", F.rank().over(w)).filter("_r <= 5").drop("_r")


@query(sql("SELECT platform, cluster, round((n - avg(n) OVER (PARTITION BY platform)) / stddev_samp(n) OVER (PARTITION BY platform), 6) + 0.0::DOUBLE AS z FROM (SELECT platform, cluster, count(*) AS n FROM cells GROUP BY 1, 2)", "cells"))
def gene_zscore(s, d):
    w = Window.partitionBy("platform")
    n = cells(s, d).groupBy("platform", "cluster").agg(F.count("*").alias("n"))
    return n.select("platform", "cluster", r6((F.col("n") - F.avg("n").over(w)) / F.stddev_samp("n").over(w)).alias("z"))


@query(sql("SELECT platform, sample, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY platform), 6) AS share FROM cells GROUP BY 1, 2", "cells"))
def partition_share(s, d):
    return tables.shares(cells(s, d), ["platform"], "sample").withColumn("share", r6("share"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_shipmode_ ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_shipmode_, l_quantity) - 1) / 2 AS avg_rank FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)")
def average_rank(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", tables.average_rank(["l_quantity"], ["l_returnflag"]).alias("avg_rank"))


_SD = "sd AS (SELECT c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i, c_acctbal AS sd FROM customer)"


@query(sql("SELECT g, round(any_value(t), 6) AS threshold, coalesce(min(i) FILTER (sd < t) - 1, max(n)) AS n_pcs FROM (SELECT *, 1.5::DOUBLE * avg(sd) FILTER (i > n - 10) OVER (PARTITION BY g) AS t FROM (SELECT *, max(i) OVER (PARTITION BY g) AS n FROM sd WHERE i <= 50)) GROUP BY g", more=_SD))
def n_pcs_rule(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    sd = read(s, d, "customer").select(F.col("c_mktsegment").alias("g"), F.row_number().over(w).cast("long").alias("i"), F.col("c_acctbal").alias("sd")).filter("i <= 50")
    out = tables.leading_count(sd, ["g"], "i", "sd")
    return out.select("g", r6("threshold").alias("threshold"), F.col("n").alias("n_pcs"))


@query("SELECT g, i FROM (SELECT g, i, lead(sg) OVER (PARTITION BY g ORDER BY i) - sg AS dd FROM (SELECT g, i, sign(sin(i / 10.0::DOUBLE + g) - cos(i / 10.0::DOUBLE)) AS sg FROM range(500) t(i), range(3) u(g))) WHERE dd <> 0")
def grid_intersection(s, d):
    g = s.range(500).select(F.col("id").alias("i")).crossJoin(F.broadcast(s.range(3).select(F.col("id").alias("g"))))
    g = g.select("g", "i", F.sin(F.col("i") / 10.0 + F.col("g")).alias("a"), F.cos(F.col("i") / 10.0).alias("b"))
    return tables.crossings(g, ["g"], "i", "a", "b").select("g", "i")


@query("WITH o AS (SELECT s_nationkey AS g, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), p AS (SELECT a.g, a.v AS low, b.v AS high, row_number() OVER (PARTITION BY a.g ORDER BY round(b.v - a.v, 9), a.i) AS r FROM o a JOIN o b ON a.g = b.g AND b.i = a.i + floor(0.8::DOUBLE * a.n)) SELECT g, low, high FROM p WHERE r = 1")
def hdi(s, d):
    t = read(s, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    return tables.shortest_interval(t, ["g"], "v", 0.8)


# sorts


@query(sql("SELECT gene_id, total FROM (SELECT gene_id, sum(count) AS total FROM counts GROUP BY 1) ORDER BY total DESC, gene_id LIMIT 10", "counts"))
def top_genes(s, d):
    return counts(s, d).groupBy("gene_id").agg(F.sum("count").alias("total")).orderBy(F.col("total").desc(), "gene_id").limit(10)


@query("SELECT c_mktsegment, c_custkey, c_acctbal, side, rank FROM (SELECT *, 'top' AS side, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) FROM customer) WHERE rank <= 10")
def loading_extremes(s, d):
    t = read(s, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return tables.extremes(t, "c_mktsegment", "c_acctbal", "c_custkey", 10)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 20")
def multi_sort_first_n(s, d):
    t = read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey").limit(20)
    return t.withColumn("place", F.row_number().over(Window.orderBy("o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey")).cast("long"))


@query("SELECT c_mktsegment, c_acctbal AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 5")
def kth_largest(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc())
    return read(s, d, "customer").select("c_mktsegment", "c_acctbal", F.row_number().over(w).alias("r")).filter("r = 5").select("c_mktsegment", F.col("c_acctbal").alias("threshold"))


@query("SELECT p_type, p_brand, row_number() OVER (ORDER BY p_brand, k) AS place FROM (SELECT p_type, p_brand, p_partkey AS k, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS r FROM part) WHERE r = 1")
def ordered_unique(s, d):
    one = tables.first_by(read(s, d, "part").select("p_type", "p_brand", "p_partkey"), ["p_type"], ["p_brand", "p_partkey"])
    return one.select("p_type", "p_brand", F.row_number().over(Window.orderBy("p_brand", "p_partkey")).cast("long").alias("place"))


# sets


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_any, round((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard")
def set_overlap_jaccard(s, d):
    t = read(s, d, "lineitem")
    mark = t.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)).alias("b"))
    return mark.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_any")).withColumn("jaccard", r6(F.col("n_both") / F.col("n_any")))


@query("SELECT k, 'any' AS side FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 UNION SELECT s_nationkey FROM supplier WHERE s_nationkey > 9) UNION ALL SELECT k, 'only' FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)")
def node_union_diff(s, d):
    a = read(s, d, "customer").filter("c_nationkey < 15").select(F.col("c_nationkey").alias("k"))
    b = read(s, d, "supplier").filter("s_nationkey > 9").select(F.col("s_nationkey").alias("k"))
    return a.union(b).distinct().withColumn("side", F.lit("any")).unionByName(a.distinct().join(b, "k", "left_anti").withColumn("side", F.lit("only")))


@query("SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"score\":' || (CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE s_nationkey::VARCHAR END) || '}' AS summary FROM supplier")
def run_summary_json(s, d):
    t = read(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 1, F.col("s_nationkey")).alias("score"))
    return t.select("s_suppkey", summary_json(["s_suppkey", "s_name", "score"]).alias("summary"))
