"""Sources: matrices, tables and the files of runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def platform_of(path: Column) -> Column:
    """By suffix; any other suffix is an error when the row is read."""
    return F.when(F.endswith(path, F.lit(".h5ad")), "Parse").when(F.endswith(path, F.lit(".h5")), "10X_Chromium").otherwise(F.raise_error(F.concat(F.lit("unknown suffix: "), path)))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, sample_id, grandparent) of files below ``path`` whose whole name matches the regular expression, sorted; names only, contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    return found.filter(F.rlike(name, F.lit(f"^(?:{pattern})$"))).select("file", F.regexp_replace(name, r"\.[^.]+$", "").alias("sample_id"), F.get(F.split("file", "/"), F.size(F.split("file", "/")) - 3).alias("grandparent")).orderBy("file")


def read_mtx(spark: SparkSession, folder: str, feature_type: str | None = "Gene Expression") -> DataFrame:
    """(cell_id, gene_id, gene_name, count) of a bundle matrix.mtx, barcodes.tsv, features.tsv, with or without ``.gz``.

    Lines are numbered by where they stand in their file, which is read as one
    split each: the two name files are as long as the matrix's axes.
    ``feature_type`` picks one modality where the features name several.
    """

    def numbered(name: str, columns: list[str]) -> DataFrame:
        rows = spark.read.text(f"{folder}/{name}*", wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")))
        return rows.select((F.col("pos") + 1).cast("long").alias("at"), *[F.get(F.split("col", "\t"), F.lit(k)).alias(c) for k, c in enumerate(columns)])

    genes = numbered("features.tsv", ["gene_id", "gene_name", "feature_type"])
    if feature_type is not None:
        genes = genes.filter(F.coalesce("feature_type", F.lit(feature_type)) == feature_type)
    cells = numbered("barcodes.tsv", ["cell_id"])
    lines = spark.read.text(f"{folder}/matrix.mtx*").filter(~F.startswith("value", F.lit("%")))
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.select(*[F.get(parts, F.lit(k)).cast("double").alias(c) for k, c in enumerate("gcv")])
    # the header (rows, columns, entries) is the first line of the file's first block; an entry may look like it
    head = lines.filter("_metadata.file_block_start = 0").limit(1).first()
    header = F.lit(True)
    for c, x in zip("gcv", head[0].split(), strict=True):
        header = header & (F.col(c) == float(x))
    again = entries.filter(header).count() - 1
    body = entries.filter(~header)
    body = body.unionByName(entries.filter(header).limit(again)) if again else body
    named = body.join(genes, F.col("g").cast("long") == genes["at"]).join(cells, F.col("c").cast("long") == cells["at"])
    return named.select("cell_id", "gene_id", "gene_name", F.col("v").alias("count"))


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a labelled matrix that were written side by side."""
    names = ("counts", "cells", "genes")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", "true").option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_first_column(spark: SparkSession, path: str, out: str = "gene_name") -> DataFrame:
    df = read_table(spark, path)
    return df.select(F.col(df.columns[0]).alias(out))


def read_wide(spark: SparkSession, path: str, key: str = "cell_id") -> DataFrame:
    """(key, label, value) of a TSV whose first row holds labels and whose first column holds keys; what isn't a number is 0."""
    from loomframe.operators.labels import long_numbers

    df = read_table(spark, path, sep="\t")
    return long_numbers(df.withColumnRenamed(df.columns[0], key), key, df.columns[1:])


def read_runs(spark: SparkSession, pattern: str, name: str = r"([^/]+)\.csv$", out: str = "params") -> DataFrame:
    """All CSV files that match, with a column from the file's name; none is an error."""
    try:
        df = read_table(spark, pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(pattern) from e
        raise
    return with_epoch(df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), name, 1)), out)


def with_epoch(df: DataFrame, by: str = "params") -> DataFrame:
    """``epoch`` by name, else from the first unnamed column, else an error."""
    if "epoch" in df.columns:
        return df
    unnamed = [c for c in df.columns if c in ("_c0", "", "Unnamed: 0", "index")]
    if not unnamed:
        raise ValueError("no epoch column")
    return df.withColumnRenamed(unnamed[0], "epoch")


def newest(spark: SparkSession, path: str, prefix: str) -> str:
    """The folder with the prefix that was changed last."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = [s for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    if not found:
        raise FileNotFoundError(f"{path}/{prefix}*")
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString()


def written(spark: SparkSession, path: str) -> bool:
    """Whether a whole table stands there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    if not written(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def recover_order(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "row") -> DataFrame:
    """An explicit place, from 1, on which 'the first n rows' can be decided."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def copy_missing(spark: SparkSession, ids: DataFrame, found: DataFrame, source: str, target: str, key: str = "sample_id") -> list[str]:
    """Copies what ``source`` holds under the ids that were selected but not found, and gives their names; the ids are few."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    copied = []
    for r in ids.select(key).distinct().join(found.select(key), key, "left_anti").orderBy(key).collect():
        a, b = path(f"{source}/{r[key]}"), path(f"{target}/{r[key]}")
        if a.getFileSystem(conf).exists(a):
            jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
            copied.append(str(r[key]))
    return copied


def read_pairs(spark: SparkSession, path: str, ligand: str = "ligand", receptor: str = "receptor", pathway: str = "pathway_name") -> DataFrame:
    """(ligand, receptor, pathway) of a table of interactions, as databases of them are shipped; a complex is split at ``_`` into its parts."""
    df = read_table(spark, path)
    split = lambda c: F.explode(F.split(F.upper(F.trim(F.col(c))), "_"))
    one = df.filter(F.col(ligand).isNotNull() & F.col(receptor).isNotNull()).select(split(ligand).alias("ligand"), receptor, F.col(pathway).alias("pathway"))
    return one.select("ligand", split(receptor).alias("receptor"), "pathway").distinct()
