"""Quality control of cells and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A median absolute deviation divided by this estimates a standard deviation.
MAD_SCALE = 0.6745
#: Below this deviation a mask keeps everything.
MAD_FLOOR = 1e-8


def flag_genes(genes: DataFrame, flags: dict[str, Sequence[str]], name_col: str = "gene_name") -> DataFrame:
    """Boolean columns that tell whether a name begins with one of the prefixes; a flag that no gene has is an error."""
    out = genes
    for flag, prefixes in flags.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col(name_col).startswith(p)
        out = out.withColumn(flag, F.coalesce(hit, F.lit(False)))
    found = out.agg(*[F.max(F.col(f)).alias(f) for f in flags]).first()
    if missing := [f for f in flags if not found[f]]:
        raise ValueError(f"no gene has {', '.join(missing)}")
    return out


def cell_metrics(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, n_genes, total, log1p_n_genes, log1p_total, pct_mt, pct_ribo)."""
    joined = counts.join(genes.select("gene_id", "is_mt", "is_ribo"), "gene_id")
    share = lambda flag: 100 * F.sum(F.when(F.col(flag), F.col("count")).otherwise(0.0)) / F.sum("count")
    out = joined.groupBy("cell_id").agg(F.count_if(F.col("count") > 0).alias("n_genes"), F.sum("count").alias("total"), share("is_mt").alias("pct_mt"), share("is_ribo").alias("pct_ribo"))
    return out.select("cell_id", "n_genes", "total", F.log1p("n_genes").alias("log1p_n_genes"), F.log1p("total").alias("log1p_total"), "pct_mt", "pct_ribo")


def gene_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, gene_id, n_cells, total, mean, pct_dropout); means and dropout count all cells of the group, zeros too."""
    per_gene = counts.groupBy(*by, "gene_id").agg(F.count_if(F.col("count") > 0).alias("n_cells"), F.sum("count").alias("total"))
    size = counts.groupBy(*by).agg(F.count_distinct("cell_id").alias("_n"))
    joined = per_gene.join(size, list(by)) if by else per_gene.crossJoin(F.broadcast(size))  # one row
    return joined.select(*by, "gene_id", "n_cells", "total", (F.col("total") / F.col("_n")).alias("mean"), (100 * (1 - F.col("n_cells") / F.col("_n"))).alias("pct_dropout"))


def low_count_cells(counts: DataFrame, min_total: float = 200, min_genes: int = 100) -> DataFrame:
    """(cell_id, total, n_genes) of cells with both at least; the total is looked at first, the result is the same."""
    per_cell = counts.groupBy("cell_id").agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("n_genes"))
    return per_cell.filter((F.col("total") >= min_total) & (F.col("n_genes") >= min_genes))


def two_axis(counts: DataFrame, sample_col: str, min_cells: int, min_genes: int) -> DataFrame:
    """Entries of genes in ``min_cells`` cells of their sample and of cells that have ``min_genes`` genes; both judged on the input."""
    genes = counts.groupBy(sample_col, "gene_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_cells).select(sample_col, "gene_id")
    kept = counts.join(genes, [sample_col, "gene_id"], "left_semi")
    cells = counts.groupBy("cell_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_genes).select("cell_id")
    return kept.join(cells, "cell_id", "left_semi")


def robust_stats(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(*by, med, mad): exact medians, by counting; the deviation is scaled."""
    from loomframe.operators.orderstats import quantiles

    median = lambda df, out: quantiles(df, by, value, [0.5]).select(*by, F.element_at("q", 1).alias(out))
    med = median(long, "med")
    on = [F.col(f"l.{b}").eqNullSafe(F.col(f"m.{b}")) for b in by]
    away = long.alias("l").join(med.alias("m"), on).select(*[F.col(f"l.{b}").alias(b) for b in by], F.abs(F.col(f"l.{value}") - F.col("m.med")).alias(value))
    mad = median(away, "mad")
    return med.alias("l").join(mad.alias("m"), on).select(*[F.col(f"l.{b}").alias(b) for b in by], "med", (F.col("mad") / MAD_SCALE).alias("mad"))


def mad_keep(value: Column, med: Column, mad: Column, nmads: float = 3) -> Column:
    """Strictly inside the bounds; everything where the deviation vanishes."""
    return (mad < MAD_FLOOR) | ((value > med - nmads * mad) & (value < med + nmads * mad))


def unpivot(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def mad_mask(cells: DataFrame, metrics: Sequence[str], platform: str = "platform", nmads: float = 3) -> DataFrame:
    """(cell_id, keep): whether all metrics lie inside their platform's bounds, pooled before any mask is applied."""
    long = unpivot(cells, ["cell_id", platform], metrics)
    stats = robust_stats(long, [platform, "metric"])
    return long.join(stats, [platform, "metric"]).groupBy("cell_id").agg(F.bool_and(mad_keep(F.col("value"), F.col("med"), F.col("mad"), nmads)).alias("keep"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error that tells how many keys are repeated and the first 20."""
    twice = duplicate_keys(df, keys)
    if first := twice.orderBy(*keys).limit(20).collect():
        raise ValueError(f"{twice.count()} repeated keys, first {[tuple(r) for r in first]}")
    return df


def unique_names(df: DataFrame, parts: Sequence[str], order: Sequence[str], out: str = "name") -> DataFrame:
    """``parts`` joined by ``_``; later ones of equal names get a number."""
    named = df.withColumn("_base", F.concat_ws("_", *parts))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order)) - 1
    return named.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")
