"""Joins and alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_map(df: DataFrame, mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(mapping, list(on), "left")


def annotate(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on a key that must be unique on both sides."""
    from loomframe.operators.qc import require_unique

    return require_unique(df, [key]).join(require_unique(other, [key]), key, "left")


def outer_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "full").na.fill(0)


def core_barcode(c: Column) -> Column:
    """The 16 letters and the number at the end of an id, number 1 where there is none; other ids stay."""
    base, n = F.regexp_extract(c, "([ACGT]{16})(?:-[0-9]+)?$", 1), F.regexp_extract(c, "[ACGT]{16}-([0-9]+)$", 1)
    return F.when(base == "", c).otherwise(F.concat_ws("-", base, F.when(n == "", "1").otherwise(n)))


def match_normalised(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, order: Sequence[str]) -> DataFrame:
    """Inner join on normalised keys; of the right side's equals, the first by ``order`` stays."""
    right = b.withColumn("_k", key_b)
    right = right.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_r = 1").drop("_r")
    return a.withColumn("_k", key_a).join(right, "_k").drop("_k")


def outer_align(*tables: DataFrame) -> DataFrame:
    """Long tables one below the other: the union of their genes, with absent entries as zeros."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def ordered_pairs(df: DataFrame, col: str, same: bool = True) -> DataFrame:
    """(a, b) with a <= b (a < b without ``same``); for sets of labels, which are few."""
    names = df.select(col).distinct()
    a, b = names.select(F.col(col).alias("a")), names.select(F.col(col).alias("b"))
    return a.join(b, F.col("a") <= F.col("b") if same else F.col("a") < F.col("b"))


def grid(*parameters: DataFrame) -> DataFrame:
    """All combinations of small parameter tables."""
    out = parameters[0]
    for p in parameters[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def scatter(axis: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results on a part of the axis, null elsewhere."""
    return axis.select(key).join(results, key, "left")
