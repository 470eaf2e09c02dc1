"""The data model: long count tables with side tables for entities and features.

``counts(cell_id, gene_id, count)`` holds the non-zero entries only; an absent
row is a zero, so every mean and rank divides by the number of cells, not of
entries. ``cells`` and ``genes`` hold what is known of the axes. The builders
below map star-schema tables to this model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("count"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region are fixed tables of 25 and 5 rows
    nation = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("cell_id"), F.col("n_name").alias("sample"), F.col("r_name").alias("platform"),
        F.when(F.contains("n_name", F.lit("1")), "case").otherwise("normal").alias("diagnosis"),
        F.col("c_mktsegment").alias("cluster"), ((F.col("c_acctbal") + 1000) / 11000).alias("score"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), name.alias("gene_name"), name.startswith("hot").alias("is_mt"), (name.startswith("red") | name.startswith("blue")).alias("is_ribo"), F.col("p_brand").alias("grp"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles: distances of floats would tie."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("params"), F.row_number().over(order).cast("long").alias("epoch"), "value", "event_type", "event_id")


def soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    mass = counts(spark, sf_dir).join(genes(spark, sf_dir), "gene_id").groupBy("cell_id", F.col("grp").alias("label")).agg(F.sum("count").alias("n"))
    return mass.select("cell_id", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("cell_id"))).alias("prob"))


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison, as SQL's round does a double: the nearest whole number of ``places``-th parts; no negative zero.

    Spark's own round of a double rounds its shortest decimal form, which is another
    number where the product with ``10 ** places`` is rounded to or from a half.
    """
    scale = F.lit(float(10**places))
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale + F.lit(0.0)


#: The same tables as SQL.
CTES = {
    "counts": "SELECT o_custkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "cells": "SELECT c_custkey AS cell_id, n_name AS sample, r_name AS platform, CASE WHEN contains(n_name, '1') THEN 'case' ELSE 'normal' END AS diagnosis, c_mktsegment AS cluster, (c_acctbal + 1000) / 11000 AS score FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "genes": "SELECT p_partkey AS gene_id, p_name AS gene_name, p_name LIKE 'hot%' AS is_mt, (p_name LIKE 'red%' OR p_name LIKE 'blue%') AS is_ribo, p_brand AS grp FROM part",
    "vectors": "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings",
    "runs": "SELECT user_id AS params, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value, event_type, event_id FROM events",
    "soft": "SELECT cell_id, label, n / sum(n) OVER (PARTITION BY cell_id) AS prob FROM (SELECT cell_id, grp AS label, sum(count) AS n FROM counts JOIN genes USING (gene_id) GROUP BY 1, 2)",
    "qc": "SELECT cell_id, count(*) FILTER (count > 0) AS n_genes, sum(count) AS total, ln(1 + count(*) FILTER (count > 0)) AS log1p_n_genes, ln(1 + sum(count)) AS log1p_total, 100 * sum(CASE WHEN is_mt THEN count ELSE 0 END) / sum(count) AS pct_mt, 100 * sum(CASE WHEN is_ribo THEN count ELSE 0 END) / sum(count) AS pct_ribo FROM counts JOIN genes USING (gene_id) GROUP BY cell_id",
    "lognorm": "SELECT cell_id, gene_id, ln(1 + 10000 * count / sum(count) OVER (PARTITION BY cell_id)) AS x FROM counts",
    "ncells": "SELECT count(DISTINCT cell_id) AS n FROM counts",
}
_NEEDS = {"soft": ("counts", "genes"), "qc": ("counts", "genes"), "lognorm": ("counts",), "ncells": ("counts",)}


def sql(body: str, *names: str, more: str = "") -> str:
    """``body`` with the named tables (and what they need) as common table expressions."""
    wanted = [n for n in CTES if n in names or any(n in _NEEDS.get(x, ()) for x in names)]
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in wanted] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
