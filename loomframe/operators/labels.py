"""Projections: labels, keys and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(c: Column, part: str, yes: str, no: str) -> Column:
    """Case-sensitive; a null is ``no``."""
    return F.when(F.contains(c, F.lit(part)), yes).otherwise(no)


def first_match(c: Column, cases: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first part that the text contains, whatever the case; a null gets the default."""
    out = None
    for part, label in cases:
        hit = F.contains(F.lower(c), F.lit(part.lower()))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def recode(df: DataFrame, col: str, mapping: dict[str, str], out: str) -> DataFrame:
    """Labels by a map; others become null. The map is given in the program, so it is small."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, pairs[F.col(col)])


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    found = [n for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of {list(names)} is there")
    return found


def select_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*present(df, names))


def coalesce_key(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """The first of the named columns that the table has, under the name ``out``."""
    return df.withColumnRenamed(present(df, names)[0], out)


def first_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def split_pair(df: DataFrame, col: str, sep: str, left: str, right: str) -> DataFrame:
    import re

    parts = F.split(F.col(col), re.escape(sep))
    return df.withColumns({left: F.get(parts, F.lit(0)), right: F.get(parts, F.lit(1))})


def top_label(soft: DataFrame) -> DataFrame:
    """Each cell's most likely label; of equals, the first by name."""
    best = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.round("prob", 9).desc(), "label"))
    return soft.withColumn("_r", best).filter("_r = 1").drop("_r")


def unknown_below(label: Column, confidence: Column, least: float, where: Column, name: str = "Unknown") -> Column:
    return F.when(where & (confidence < least), name).otherwise(label)


def repair_volcano(df: DataFrame, fc: str, p: str, floor: float = 1e-300) -> DataFrame:
    """Infinite changes become the largest and least finite ones; p that is null, not finite or not positive becomes ``floor``."""
    finite = F.abs(F.col(fc)) < float("inf")
    ends = df.agg(F.max(F.when(finite, F.col(fc))).alias("_hi"), F.min(F.when(finite, F.col(fc))).alias("_lo"))
    out = df.crossJoin(F.broadcast(ends))  # one row
    good = F.when(F.isnan(p) | (F.col(p) <= 0) | F.col(p).isNull(), floor).otherwise(F.col(p))
    fixed = F.when(F.col(fc) == float("inf"), F.col("_hi")).when(F.col(fc) == float("-inf"), F.col("_lo")).otherwise(F.col(fc))
    return out.withColumns({fc: fixed, "neg_log10_p": -F.log10(good)}).drop("_hi", "_lo")


def encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """0 to n - 1 in the order of the labels, null as -1; numbered on the distinct labels, then joined."""
    names = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = names.withColumn(out, F.row_number().over(Window.orderBy(col)).cast("long") - 1)
    return df.join(codes, col, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def sanitize(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def rescale(df: DataFrame, col: str, targets: dict[str, tuple[float, float]]) -> DataFrame:
    """Linear maps of the column's range to others; a constant column gives each target's lower end."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = df.crossJoin(F.broadcast(ends))  # one row
    span = F.col("_hi") - F.col("_lo")
    share = F.when(span == 0, 0.0).otherwise((F.col(col) - F.col("_lo")) / span)
    return out.withColumns({n: share * (b - a) + a for n, (a, b) in targets.items()}).drop("_lo", "_hi")


def long_numbers(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, label, value): the columns as rows; what isn't a number is 0."""
    long = wide.unpivot([key], [F.col(c).cast("string").alias(c) for c in columns], "label", "value")
    return long.withColumn("value", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)))
