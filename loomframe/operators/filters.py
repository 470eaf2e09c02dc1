"""Filters that depend on groups, ranks or lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequent_labels(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose label stands in at least ``least`` rows."""
    names = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return df.join(names, label, "left_semi").select(*df.columns)


def soft_mass(soft: DataFrame, least: float) -> DataFrame:
    """(label, mass) of labels with that much probability in all; fewer than two is an error."""
    kept = soft.groupBy("label").agg(F.sum("prob").alias("mass")).filter(F.col("mass") >= least)
    if len(kept.select("label").limit(2).collect()) < 2:
        raise ValueError("fewer than two labels are left")
    return kept


def below_kth(df: DataFrame, score: str, ties: list[str], k: DataFrame) -> DataFrame:
    """Rows strictly below the ``k``-th largest score (``k``: one row, column n).

    The k largest scores aren't ranked in one task: distinct scores are counted
    and cumulated from above first.
    """
    levels = df.groupBy(score).agg(F.count("*").alias("_c"))
    upto = levels.withColumn("_upto", F.sum("_c").over(Window.orderBy(F.col(score).desc())))
    threshold = upto.crossJoin(F.broadcast(k)).filter("_upto >= n").agg(F.max(score).alias("_t"))
    return df.crossJoin(F.broadcast(threshold)).filter(F.col(score) < F.col("_t")).drop("_t")


def without_ids(df: DataFrame, col: str, listed: str) -> DataFrame:
    """``listed``: values split by commas."""
    return df.filter(~F.col(col).isin([x.strip() for x in listed.split(",")]))


def both_conditions(df: DataFrame, group: str, condition: str, a: str, b: str, least: int) -> DataFrame:
    """(group, n_a, n_b) of groups with at least ``least`` rows of either condition."""
    sizes = df.groupBy(group).agg(F.count_if(F.col(condition) == a).alias(f"n_{a}"), F.count_if(F.col(condition) == b).alias(f"n_{b}"))
    return sizes.filter((F.col(f"n_{a}") >= least) & (F.col(f"n_{b}") >= least))


def markers(df: DataFrame, in_least: float, rest_most: float, panel: DataFrame, name: str = "gene_name", prefixes: str = "^(MT-|RPL|RPS)") -> DataFrame:
    kept = df.filter((F.col("pct_in") >= in_least) & (F.col("pct_rest") <= rest_most) & ~F.rlike(name, F.lit(prefixes)))
    return kept.join(panel.select(name), name, "left_anti")


def differential(df: DataFrame, change: float, p: float, pct: float, exclude: list | None = None, include: list | None = None, name: str = "gene_id") -> DataFrame:
    """abs(avg_log2fc) > change, p_val_adj < p and either share > pct; nulls go."""
    out = df.filter((F.abs("avg_log2fc") > change) & (F.col("p_val_adj") < p) & ((F.col("pct_1") > pct) | (F.col("pct_2") > pct)))
    if exclude:
        out = out.filter(~F.col(name).isin(exclude))
    return out.filter(F.col(name).isin(include)) if include else out
