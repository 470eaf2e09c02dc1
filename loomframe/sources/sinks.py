"""Sinks: tables, lists, run summaries and exchange bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shared import cut


def write_bundle(folder: str, counts: DataFrame, cells: DataFrame, genes: DataFrame, by: str | None = None, mode: str = "errorifexists") -> None:
    """A labelled matrix as Parquet tables side by side; counts in one folder for each value of ``by``."""
    writer = counts.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/counts")
    cells.write.mode(mode).parquet(f"{folder}/cells")
    genes.write.mode(mode).parquet(f"{folder}/genes")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("sep", "\t").csv(path)


def write_list(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def summary_json(columns: Sequence[str]) -> Column:
    """One JSON object; a number that is null or not a number is null in it."""
    clean = lambda c: F.when(~F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False)), F.col(c)).alias(c)
    return F.to_json(F.struct(*[clean(c) for c in columns]), {"ignoreNullFields": "false"})


def quantile_report(df: DataFrame, name: str, observed: str, replicate: str, points: Sequence[float] = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)) -> DataFrame:
    """(name, q, observed, replicate, difference) at nine points, by linear interpolation; one pass of counts for both columns."""
    from loomframe.operators.orderstats import quantiles

    long = df.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).cast("double").alias("x")) for side, c in ((0, observed), (1, replicate))])).alias("s")).select("s.*")
    both = quantiles(long, ["side"], "x", points).agg(F.any_value(F.when(F.col("side") == 0, F.col("q")), True).alias("o"), F.any_value(F.when(F.col("side") == 1, F.col("q")), True).alias("r"))  # two rows
    qs = F.array(*[F.lit(float(q)) for q in points])
    rows = both.select(F.posexplode(F.arrays_zip(qs.alias("q"), F.col("o"), F.col("r"))))
    return rows.select(F.lit(name).alias("name"), F.col("col.q").alias("q"), F.col("col.o").alias("observed"), F.col("col.r").alias("replicate"), (F.col("col.o") - F.col("col.r")).alias("difference"))


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").option("header", "true").option("sep", "\t").csv(path)


def numbered(df: DataFrame, key: str, out: str = "_at") -> DataFrame:
    """``df`` with places from 1 in the order of ``key``: sorted by ranges, whose sizes (a number each) reach the driver."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    ranged = cut(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    upto, offsets = 0, {}
    for r in sorted(ranged.groupBy("_p").count().collect()):
        offsets[r["_p"]] = upto
        upto += r["count"]
    if not offsets:
        return df.withColumn(out, F.lit(0).cast("long"))
    base = F.element_at(F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets) + 1)]), F.col("_p") + 1)
    return ranged.withColumn(out, base + F.col("_i") + 1).drop("_p", "_i")


def write_mtx(counts: DataFrame, cells: DataFrame, genes: DataFrame, folder: str, fraction: float | None = None, seed: int = 0, feature_type: str = "Gene Expression") -> None:
    """A 10x-like bundle: matrix (genes x cells, 1-based), features, barcodes and an annotation table.

    ``cells``: cell_id and annotations; ``genes``: gene_id, gene_name. The axes
    are numbered by their sorted keys. ``fraction`` samples cells.
    """
    cells = cells.sample(fraction=fraction, seed=seed) if fraction is not None else cells
    cells, genes = numbered(cells, "cell_id"), numbered(genes, "gene_id")
    entries = counts.join(cells.select("cell_id", F.col("_at").alias("_c")), "cell_id").join(genes.select("gene_id", F.col("_at").alias("_g")), "gene_id").filter("count <> 0")
    n_cells, n_genes, n = cells.count(), genes.count(), entries.count()
    spark = counts.sparkSession
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 1, f"{n_genes} {n_cells} {n}")], "_c int, _g int, value string")
    body = entries.select("_c", "_g", F.concat_ws(" ", "_g", "_c", F.col("count").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("_c", "_g").sortWithinPartitions("_c", "_g").select("value").write.text(f"{folder}/matrix.mtx")
    ordered = lambda df: df.repartitionByRange(1, "_at").sortWithinPartitions("_at")
    ordered(genes).select(F.concat_ws("\t", "gene_id", "gene_name", F.lit(feature_type)).alias("value")).write.text(f"{folder}/features.tsv")
    ordered(cells).select(F.col("cell_id").cast("string").alias("value")).write.text(f"{folder}/barcodes.tsv")
    write_csv(ordered(cells).drop("_at"), f"{folder}/annotation")


def zip_bundle(folder: str, out: str) -> None:
    """Zips a bundle in a local folder; on a cluster, copy it there first."""
    import shutil

    shutil.make_archive(out.removesuffix(".zip"), "zip", folder)
