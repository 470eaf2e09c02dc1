"""Sharding by sampled splitters, in DataFrame operations only.

Law ``bytes``: records are laid out in one global order of (key hash, id), and
shard ``s`` takes the records whose first byte falls into the ``s``-th equal
part of all bytes. Two shards differ by less than two of the largest records.

1. A size-weighted sample of keys is drawn; its weighted quantiles are the
   splitters of ``n_shards * ranges_per_shard`` ranges.
2. Exact bytes and rows of each range are counted. Overfull ranges are sampled
   again, more densely, and subdivided. The id is part of the key, so a hot
   group of equal texts is split like any other range.
3. A window inside each range gives each record its exact global offset; the
   offset gives shard and slot.

What reaches the driver is a number of splitters and sums: ``n_shards`` times
``ranges_per_shard``, or one for each ``rows_per_range`` rows where that is more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import materialise, table

_KEY = ("_lf_h", "_lf_id")


def _splitters(keys: DataFrame, ranges: Column, wanted: dict[int, tuple[int, int]], sample: int, seed: int) -> list[tuple[int, int]]:
    """Weighted quantiles of each range in ``wanted``: range -> (bytes, parts)."""
    whole = F.expr(f"map({', '.join(f'{r}, {total}D' for r, (total, _) in wanted.items())})")
    parts = F.expr(f"map({', '.join(f'{r}, {n}' for r, (_, n) in wanted.items())})")
    picked = (
        keys.select(*_KEY, "_lf_size", ranges.alias("r"))
        .filter(F.col("r").isin(list(wanted)))
        .select("*", (whole[F.col("r")] / (parts[F.col("r")] * sample)).alias("step"), parts[F.col("r")].alias("parts"))
        .filter(F.rand(seed) * F.col("step") < F.col("_lf_size"))
        .select(*_KEY, "r", "parts", F.greatest("_lf_size", "step").alias("weight"))
    )
    order = Window.partitionBy("r").orderBy(*_KEY)
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy("r"))
    cut = picked.select(*_KEY, F.floor((upto - F.col("weight")) / total * F.col("parts")).alias("a"), F.floor(upto / total * F.col("parts")).alias("b"), "parts")
    return sorted({(x[0], x[1]) for x in cut.filter("b > a AND b < parts").select(*_KEY).collect()})


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of splitters that are not beyond a record's key; a search of two levels."""
    if not bounds:
        return F.lit(0)
    key, step = F.struct(*[F.col(c).alias(c) for c in _KEY]), max(1, math.isqrt(len(bounds)))
    points = lambda some: f"array({', '.join(f'named_struct({_KEY[0]!r}, {h}L, {_KEY[1]!r}, {i}L)' for h, i in some)})"
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    passed = lambda some: F.size(F.filter(some, lambda b: b <= key))
    group = F.greatest(passed(F.expr(points([g[0] for g in groups]))) - 1, F.lit(0))
    fine = F.element_at(F.expr(f"array({', '.join(map(points, groups))})"), (group + 1).cast("int"))
    return (group * step + passed(fine)).cast("int")


def assign_shards(df: DataFrame, n_shards: int = 16, key: Column | str = "key", id_col: str = "doc_id", size_col: str = "size", ranges_per_shard: int = 32, samples_per_range: int = 16, seed: int = 7, rows_per_range: int = 2_000_000) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` decides the order before ``id_col``; equal keys stand together. A
    null key or id sorts as the smallest long, a null size counts 0. Repeated
    rows get slots of their own, in any order among themselves. An empty table
    gives an empty result. The columns ``shard`` and ``slot`` of ``df``, if any,
    are replaced. All sizes together times ``n_shards`` must stay below 2 ** 63.
    """
    key = F.col(key) if isinstance(key, str) else key
    low = F.lit(-(2**63)).cast("long")
    keys = materialise(
        df.drop("shard", "slot").withColumns({"_lf_h": F.coalesce(key.cast("long"), low), "_lf_id": F.coalesce(F.col(id_col).cast("long"), low), "_lf_size": F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long"))}),
        "shard-keys",
    )
    rows, total = keys.agg(F.count("*"), F.sum("_lf_size")).first()
    if not rows:
        return keys.drop(*_KEY, "_lf_size").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total = max(total or 0, 1)
    # more ranges for more rows, so that none is more than a task can sort
    n_ranges = max(n_shards * ranges_per_shard, -(-rows // rows_per_range))
    bounds = _splitters(keys, F.lit(0), {0: (total, n_ranges)}, samples_per_range, seed)
    for again in range(4):
        ranges = _range_of(bounds)
        stats = {r["r"]: (r["b"] or 0, r["n"], r["n"] > 1 and r["lo"] != r["hi"]) for r in keys.groupBy(ranges.alias("r")).agg(F.sum("_lf_size").alias("b"), F.count("*").alias("n"), F.min(F.struct(*_KEY)).alias("lo"), F.max(F.struct(*_KEY)).alias("hi")).collect()}
        fair = total / n_ranges
        over = {r: (b, math.ceil(b / fair)) for r, (b, _, divides) in stats.items() if b > 2 * fair and divides}
        more = sorted({*bounds, *_splitters(keys, ranges, over, samples_per_range * 4**again, seed + again + 1)}) if over and again < 3 else bounds
        if more == bounds:
            break
        bounds = more
    offsets, ranks, at, rank = [], [], 0, 0
    for r in range(len(bounds) + 1):
        offsets.append(at)
        ranks.append(rank)
        at, rank = at + stats.get(r, (0, 0))[0], rank + stats.get(r, (0, 0))[1]
    shard_at = lambda byte: min(n_shards - 1, byte * n_shards // total)
    base = lambda values: F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), F.col("_lf_r") + 1)
    inside = Window.partitionBy("_lf_r").orderBy(*_KEY, "_lf_size").rowsBetween(Window.unboundedPreceding, 0)

    def placed(frame: DataFrame) -> DataFrame:
        laid = frame.withColumns({"_lf_at": base(offsets) + F.sum("_lf_size").over(inside) - F.col("_lf_size"), "_lf_rank": base(ranks) + F.count("*").over(inside) - 1})
        return laid.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.expr(f"_lf_at * {n_shards} div {total}"))).cast("int"))

    ranged = keys.withColumn("_lf_r", ranges)
    first: dict[int, int] = {}
    for r in sorted(stats):
        first.setdefault(shard_at(offsets[r]), ranks[r])
    crossed = [r for r in stats if stats[r][1] > 1 and shard_at(offsets[r]) != shard_at(offsets[r] + max(0, stats[r][0] - 1))]
    if crossed:
        for s, least in placed(ranged.filter(F.col("_lf_r").isin(crossed))).groupBy("shard").agg(F.min("_lf_rank")).collect():
            first[s] = min(first.get(s, least), least)
    begins = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)]), F.col("shard") + 1)
    return placed(ranged).withColumn("slot", F.col("_lf_rank") - begins).drop(*_KEY, "_lf_size", "_lf_r", "_lf_at", "_lf_rank")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its records in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by a digest of the text; a null text has size 1 and the checksum of an empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    digests = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), key.alias("key"))
    return assign_shards(digests, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_steps() -> list[int]:
    """What a byte does to a CRC-32 (the reflected polynomial 0xEDB88320)."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: The global order, and every record's first byte in it, decide shard and slot.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, strlen(text) + 1 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key,
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(({_crc_steps()}::BIGINT[])[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS text_crc32 FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id) - size AS first, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(15, (first * 16) // total)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
