"""Quality-control and projection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.functions.shared import cut
from loomframe.model import cells, counts, genes, r6, read, runs, soft_labels, sql
from loomframe.operators import filters, labels, qc
from loomframe.plans.registry import query

METRICS = ("n_genes", "log1p_total", "pct_mt", "pct_ribo")


def _qc(s, d):
    return qc.cell_metrics(counts(s, d), genes(s, d)).join(cells(s, d), "cell_id")


def _measured(s, d):
    """The cells' metrics, written once: medians by counting read them many times."""
    return cut(_qc(s, d).select("cell_id", "platform", "sample", *METRICS))


@query(sql("SELECT cell_id, n_genes, total, round(log1p_n_genes, 6) AS log1p_n_genes, round(log1p_total, 6) AS log1p_total, round(pct_mt, 6) AS pct_mt, round(pct_ribo, 6) AS pct_ribo FROM qc", "qc"))
def qc_cell_metrics(s, d):
    return qc.cell_metrics(counts(s, d), genes(s, d)).select("cell_id", "n_genes", "total", *[r6(c).alias(c) for c in ("log1p_n_genes", "log1p_total", "pct_mt", "pct_ribo")])


@query(sql("SELECT sample, gene_id, count(*) FILTER (count > 0) AS n_cells, sum(count) AS total, round(sum(count) / any_value(n), 6) AS mean, round(100 * (1 - count(*) FILTER (count > 0) / any_value(n)), 6) AS pct_dropout FROM counts JOIN cells USING (cell_id) JOIN (SELECT sample, count(DISTINCT cell_id) AS n FROM counts JOIN cells USING (cell_id) GROUP BY 1) USING (sample) GROUP BY 1, 2", "counts", "cells"))
def qc_gene_metrics(s, d):
    both = counts(s, d).join(cells(s, d).select("cell_id", "sample"), "cell_id")
    return qc.gene_metrics(both, ["sample"]).select("sample", "gene_id", "n_cells", "total", r6("mean").alias("mean"), r6("pct_dropout").alias("pct_dropout"))


@query(sql("SELECT cell_id, sum(count) AS total, count(*) FILTER (count > 0) AS n_genes FROM counts GROUP BY 1 HAVING total >= 200 AND n_genes >= 10", "counts"))
def low_count_filter(s, d):
    return qc.low_count_cells(counts(s, d), 200, 10)


@query(sql("SELECT cell_id, gene_id, sample, count FROM c WHERE (sample, gene_id) IN (SELECT (sample, gene_id) FROM c GROUP BY sample, gene_id HAVING count(*) >= 3) AND cell_id IN (SELECT cell_id FROM c GROUP BY cell_id HAVING count(*) >= 20)", "counts", "cells", more="c AS (SELECT cell_id, gene_id, sample, count FROM counts JOIN cells USING (cell_id))"))
def two_axis_filter(s, d):
    both = counts(s, d).join(cells(s, d).select("cell_id", "sample"), "cell_id")
    return qc.two_axis(both, "sample", 3, 20).select("cell_id", "gene_id", "sample", "count")


_MAD_SQL = """long AS (SELECT cell_id, platform, sample, metric, value FROM (SELECT cell_id, platform, sample, n_genes::DOUBLE AS n_genes, log1p_total, pct_mt, pct_ribo FROM qc JOIN cells USING (cell_id)) UNPIVOT (value FOR metric IN (n_genes, log1p_total, pct_mt, pct_ribo))),
med AS (SELECT platform, metric, median(value) AS med FROM long GROUP BY 1, 2),
mad AS (SELECT platform, metric, any_value(med) AS med, median(abs(value - med)) / 0.6745::DOUBLE AS mad FROM long JOIN med USING (platform, metric) GROUP BY 1, 2),
mask AS (SELECT cell_id, sample, metric, value, (mad < 1e-8 OR (value > med - 3 * mad AND value < med + 3 * mad)) AS keep FROM long JOIN mad USING (platform, metric))"""


@query(sql("SELECT cell_id, bool_and(keep) AS keep FROM mask GROUP BY 1", "qc", "cells", more=_MAD_SQL))
def mad_mask_filter(s, d):
    return qc.mad_mask(_measured(s, d), METRICS)


@query(sql("SELECT sample, CASE WHEN contains(sample, '1') THEN 'case' ELSE 'normal' END AS diagnosis, metric, n_before, n_after, round(n_after / n_before, 6) AS retained, round(med, 6) AS med, round(mad, 6) AS mad, passed, round(passed / n_before, 6) AS passed_fraction FROM (SELECT m.sample, m.metric, count(*) AS n_before, sum(m.keep::INT)::BIGINT AS passed, any_value(sm.med) AS med, median(abs(m.value - sm.med)) / 0.6745::DOUBLE AS mad FROM mask m JOIN sm USING (sample, metric) GROUP BY 1, 2) JOIN after USING (sample)", "qc", "cells", more=_MAD_SQL + ", sm AS (SELECT sample, metric, median(value) AS med FROM mask GROUP BY 1, 2), after AS (SELECT sample, sum(k::INT)::BIGINT AS n_after FROM (SELECT sample, cell_id, bool_and(keep) AS k FROM mask GROUP BY 1, 2) GROUP BY 1)"))
def qc_sample_stats(s, d):
    data = _measured(s, d)
    long = qc.unpivot(data, ["cell_id", "platform", "sample"], METRICS)
    pooled = qc.robust_stats(long, ["platform", "metric"])
    masked = long.join(pooled, ["platform", "metric"]).withColumn("keep", qc.mad_keep(F.col("value"), F.col("med"), F.col("mad"))).drop("med", "mad")
    own = qc.robust_stats(masked, ["sample", "metric"])
    passed = masked.groupBy("sample", "metric").agg(F.count("*").alias("n_before"), F.count_if("keep").alias("passed"))
    after = masked.groupBy("sample", "cell_id").agg(F.bool_and("keep").alias("k")).groupBy("sample").agg(F.count_if("k").alias("n_after"))
    out = passed.join(own, ["sample", "metric"]).join(after, "sample")
    return out.select("sample", labels.status(F.col("sample"), "1", "case", "normal").alias("diagnosis"), "metric", "n_before", "n_after", r6(F.col("n_after") / F.col("n_before")).alias("retained"), r6("med").alias("med"), r6("mad").alias("mad"), "passed", r6(F.col("passed") / F.col("n_before")).alias("passed_fraction"))


@query(sql("SELECT cell_id, sample, CASE WHEN contains(sample, '1') THEN 'case' ELSE 'normal' END AS diagnosis, 'raw' AS stage, metric, round(value, 6) AS value FROM long", "qc", "cells", more=_MAD_SQL))
def qc_metrics_long(s, d):
    long = qc.unpivot(_qc(s, d), ["cell_id", "sample"], METRICS)
    return long.select("cell_id", "sample", labels.status(F.col("sample"), "1", "case", "normal").alias("diagnosis"), F.lit("raw").alias("stage"), "metric", r6("value").alias("value"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'hot') THEN 'hot' WHEN contains(lower(p_name), 'red') THEN 'red' ELSE 'other' END AS status FROM part")
def status_label(s, d):
    return read(s, d, "part").select("p_partkey", labels.first_match(F.col("p_name"), [("hot", "hot"), ("red", "red")], "other").alias("status"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS priority FROM orders")
def label_recode(s, d):
    return labels.recode(read(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}, "priority").select("o_orderkey", "priority")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_check(s, d):
    return qc.duplicate_keys(read(s, d, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"])


@query("SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE n >= 10")
def rare_label_filter(s, d):
    return filters.frequent_labels(read(s, d, "part").select("p_partkey", "p_type"), "p_type", 10)


@query(sql("SELECT label, round(sum(prob), 6) AS mass FROM soft GROUP BY 1 HAVING sum(prob) >= 2", "soft"))
def soft_label_filter(s, d):
    return filters.soft_mass(soft_labels(s, d), 2).select("label", r6("mass").alias("mass"))


@query(sql("SELECT cell_id, round(score, 6) AS score FROM c WHERE NOT gone AND score < (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC, cell_id) AS r FROM c WHERE NOT gone) WHERE r = (SELECT greatest(1, floor(count(*) * 0.06::DOUBLE)::BIGINT - count(*) FILTER (gone AND score >= 0.9::DOUBLE)) FROM c))", "cells", more="c AS (SELECT cell_id, score, cluster = 'BUILDING' AS gone FROM cells)"))
def top_score_removal(s, d):
    data = cells(s, d).select("cell_id", "score", (F.col("cluster") == "BUILDING").alias("gone"))
    n = data.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * F.lit(0.06)) - F.count_if(F.col("gone") & (F.col("score") >= 0.9))).alias("n"))
    return filters.below_kth(data.filter("NOT gone"), "score", ["cell_id"], n).select("cell_id", r6("score").alias("score"))


@query(sql("SELECT gene_id, gene_name, is_mt, is_ribo FROM genes", "genes"))
def gene_flags(s, d):
    return qc.flag_genes(genes(s, d).select("gene_id", "gene_name"), {"is_mt": ["hot"], "is_ribo": ["red", "blue"]})


@query(sql("SELECT cell_id, CASE WHEN cluster IN ('BUILDING', 'MACHINERY') THEN 'inner' ELSE 'outer' END AS region FROM cells", "cells"))
def membership_label(s, d):
    return cells(s, d).select("cell_id", F.when(F.col("cluster").isin("BUILDING", "MACHINERY"), "inner").otherwise("outer").alias("region"))


@query("SELECT c_custkey, CASE WHEN n = 0 THEN b ELSE b || '-' || n END AS name FROM (SELECT c_custkey, b, row_number() OVER (PARTITION BY b ORDER BY c_custkey) - 1 AS n FROM (SELECT c_custkey, c_mktsegment || '_' || c_nationkey AS b FROM customer))")
def key_prefix_dedup(s, d):
    return qc.unique_names(read(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], ["c_custkey"]).select("c_custkey", "name")


@query("SELECT p_partkey AS gene_id, p_name AS gene_name, 'part' AS origin, p_size, p_brand, p_retailprice AS layer FROM part WHERE p_name IS NOT NULL")
def projection_pack(s, d):
    df = read(s, d, "part")
    df = labels.coalesce_key(df, ["gene_ids", "p_partkey"], "gene_id").withColumnRenamed("p_name", "gene_name").withColumn("origin", F.lit("part"))
    df = df.withColumn("layer", F.col(labels.present(df, ["counts", "p_retailprice"])[0]))
    return labels.first_columns(labels.select_present(df, ["gene_id", "gene_name", "origin", "p_size", "p_brand", "layer", "no_such"]), ["gene_id", "gene_name"]).filter(F.col("gene_name").isNotNull())


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS ligand, string_split(p_name, ' ')[2] AS receptor FROM part")
def pair_split(s, d):
    return labels.split_pair(read(s, d, "part").select("p_partkey", "p_name"), "p_name", " ", "ligand", "receptor").select("p_partkey", "ligand", "receptor")


@query(sql("SELECT cell_id, CASE WHEN platform <> 'ASIA' OR prob >= 0.12::DOUBLE THEN label ELSE 'Unknown' END AS label, round(prob, 6) AS confidence FROM (SELECT cell_id, label, prob, row_number() OVER (PARTITION BY cell_id ORDER BY round(prob, 9) DESC, label) AS r FROM soft) JOIN cells USING (cell_id) WHERE r = 1", "soft", "cells"))
def low_confidence_unknown(s, d):
    top = labels.top_label(soft_labels(s, d)).join(cells(s, d).select("cell_id", "platform"), "cell_id")
    return top.select("cell_id", labels.unknown_below(F.col("label"), F.col("prob"), 0.12, F.col("platform") == "ASIA").alias("label"), r6("prob").alias("confidence"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE WHEN l_discount = 0.1 THEN '-Infinity'::DOUBLE ELSE ln(l_discount * 20) END AS fc, CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_tax END AS p FROM lineitem), m AS (SELECT max(fc) FILTER (isfinite(fc)) AS hi, min(fc) FILTER (isfinite(fc)) AS lo FROM t) SELECT l_orderkey, l_linenumber, round(-(CASE WHEN fc = 'Infinity'::DOUBLE THEN hi WHEN fc = '-Infinity'::DOUBLE THEN lo ELSE fc END), 6) + 0.0::DOUBLE AS fc, round(-log10(CASE WHEN p <= 0 THEN 1e-300 ELSE p END), 6) + 0.0::DOUBLE AS neg_log10_p FROM t, m")
def volcano_repair(s, d):
    inf = float("inf")
    t = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, F.lit(inf)).when(F.col("l_discount") == 0.1, F.lit(-inf)).otherwise(F.log(F.col("l_discount") * 20)).alias("fc"), F.col("l_tax").alias("p"))
    fixed = labels.repair_volcano(t, "fc", "p")
    return fixed.select("l_orderkey", "l_linenumber", r6(-F.col("fc")).alias("fc"), r6("neg_log10_p").alias("neg_log10_p"))


@query(sql("SELECT cell_id, CASE WHEN platform = 'ASIA' THEN -1 ELSE c END AS code FROM (SELECT cell_id, platform, dense_rank() OVER (ORDER BY cluster) - 1 AS c FROM cells)", "cells"))
def label_encode(s, d):
    data = cells(s, d).select("cell_id", "platform", "cluster")
    coded = labels.encode(data, "cluster", "code")
    return coded.select("cell_id", F.when(F.col("platform") == "ASIA", F.lit(-1).cast("long")).otherwise(F.col("code")).alias("code"))


@query("SELECT p_partkey, regexp_replace(p_name || '#' || p_brand, '[^A-Za-z0-9_.-]', '_', 'g') AS id FROM part")
def sanitize_id(s, d):
    return read(s, d, "part").select("p_partkey", labels.sanitize(F.concat_ws("#", "p_name", "p_brand")).alias("id"))


@query("SELECT s_suppkey, printf('trial_%03d', s_suppkey) AS trial FROM supplier")
def trial_ids(s, d):
    return read(s, d, "supplier").select("s_suppkey", F.format_string("trial_%03d", "s_suppkey").alias("trial"))


@query("SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo) * 5 + 1, 6) AS width, round((s_acctbal - lo) / (hi - lo) * 99 + 1)::BIGINT AS colour FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def minmax_rescale(s, d):
    data = labels.rescale(read(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", {"width": (1, 6), "c": (1, 100)})
    return data.select("s_suppkey", r6("width").alias("width"), F.round("c").cast("long").alias("colour"))


@query(sql("SELECT cell_id, sample, platform FROM cells WHERE score < 0.9 AND platform IN ('ASIA', 'EUROPE') AND sample IS NOT NULL", "cells"))
def singlets_only(s, d):
    return cells(s, d).filter((F.col("score") < 0.9) & F.col("platform").isin("ASIA", "EUROPE") & F.col("sample").isNotNull()).select("cell_id", "sample", "platform")


@query(sql("SELECT cell_id, cluster FROM cells WHERE cluster NOT IN ('BUILDING', 'FURNITURE')", "cells"))
def cluster_exclusion(s, d):
    return filters.without_ids(cells(s, d).select("cell_id", "cluster"), "cluster", "BUILDING, FURNITURE")


@query(sql("SELECT cluster, count(*) FILTER (diagnosis = 'case') AS n_case, count(*) FILTER (diagnosis = 'normal') AS n_normal FROM cells GROUP BY 1 HAVING n_case >= 25 AND n_normal >= 25", "cells"))
def both_conditions_gate(s, d):
    return filters.both_conditions(cells(s, d), "cluster", "diagnosis", "case", "normal", 25)


@query(sql("SELECT gene_id, sum(count) AS total FROM counts JOIN cells USING (cell_id) WHERE platform = 'ASIA' GROUP BY 1 HAVING sum(count) > 0", "counts", "cells"))
def expressed_genes(s, d):
    return counts(s, d).join(cells(s, d).filter("platform = 'ASIA'").select("cell_id"), "cell_id", "left_semi").groupBy("gene_id").agg(F.sum("count").alias("total")).filter("total > 0")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Parse' ELSE '10X_Chromium' END AS platform, CASE WHEN contains(f, 'Case') THEN 'disease' ELSE 'Normal' END AS status, 'batch' || (p_partkey % 7) AS folder FROM (SELECT p_partkey, 'batch' || (p_partkey % 7) || '/' || (CASE WHEN p_partkey % 2 = 0 THEN 'Case' ELSE 'N' END) || p_partkey || (CASE WHEN p_partkey % 3 = 0 THEN '.h5ad' ELSE '.h5' END) AS f FROM part)")
def platform_from_suffix(s, d):
    from loomframe.sources import readers

    k = F.col("p_partkey")
    path = F.concat(F.lit("batch"), (k % 7).cast("string"), F.lit("/"), F.when(k % 2 == 0, "Case").otherwise("N"), k.cast("string"), F.when(k % 3 == 0, ".h5ad").otherwise(".h5"))
    return read(s, d, "part").select("p_partkey", path.alias("f")).select("p_partkey", readers.platform_of(F.col("f")).alias("platform"), labels.status(F.col("f"), "Case", "disease", "Normal").alias("status"), F.regexp_extract("f", "([^/]+)/[^/]+$", 1).alias("folder"))


@query("SELECT s_suppkey::VARCHAR AS cell, label, coalesce(try_cast(v AS DOUBLE), 0.0::DOUBLE) AS value FROM (SELECT s_suppkey, unnest(['bal', 'name']) AS label, unnest([s_acctbal::VARCHAR, s_name]) AS v FROM supplier)")
def wide_to_long_cast(s, d):
    wide = read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("cell"), F.col("s_acctbal").cast("string").alias("bal"), F.col("s_name").alias("name"))
    return labels.long_numbers(wide, "cell", ["bal", "name"])


@query(sql("SELECT 'run_' || params AS params, epoch, round(value, 6) AS value FROM runs WHERE params % 2 = 0 UNION ALL SELECT 'run_' || params, epoch, round(value, 6) FROM runs WHERE params % 2 = 1", "runs"))
def file_provenance_union(s, d):
    data = runs(s, d)
    part = lambda k: data.filter(F.col("params") % 2 == k).select(F.concat(F.lit("run_"), F.col("params").cast("string")).alias("params"), "epoch", r6("value").alias("value"))
    return part(0).unionByName(part(1), allowMissingColumns=True)
