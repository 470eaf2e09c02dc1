"""Nearly all nearest neighbours of all vectors, by descent: neighbours of a vector are likely to be neighbours of each other."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.shared import cut, uncut
from loomframe.functions.shipping import ships

ships(__name__)

#: Cells of the start, and numbers of all their centres: they are on the driver and in each task.
MOST_CELLS, CENTRES = 20_000, 1 << 22
#: Vectors that the start compares with each other; larger cells are split at random.
LEAF = 512


def _first(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of each src, ties by key; Spark keeps ``n`` of a src in each task before it shuffles them."""
    order = Window.partitionBy("src").orderBy(F.round("dist", 9), "dst")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def started(points: DataFrame, width: int, probes: int) -> DataFrame:
    """(src, dst, dist, rank): the ``width`` nearest among those that share one of a vector's ``probes`` nearest cells.

    The cells' centres are the vectors with the least hashes of their keys: the root of
    the number of vectors, but at most ``MOST_CELLS``. Of larger cells than ``LEAF``, a vector meets
    a random part of about that size, so the work is at most ``probes`` x ``LEAF`` for each.
    """
    import numpy as np
    import pandas as pd

    kind, n = points.schema["id"].dataType.simpleString(), points.count()
    wide = points.agg(F.max(F.size("v"))).first()[0] or 1
    some = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_CELLS, CENTRES // wide, round(n**0.5)))).collect()
    shared = points.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in some], float).reshape(len(some), wide))
    each = min(probes, len(some))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        step = max(1, CENTRES // max(1, len(c)))
        for whole in frames:
            for k in range(0, len(whole), step):
                f = whole.iloc[k : k + step]
                x = np.stack(f["v"].to_numpy()).astype(float)
                near = np.argpartition((c * c).sum(1) - 2 * x @ c.T, each - 1, axis=1)[:, :each]
                yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), each), "v": list(np.repeat(x, each, axis=0)), "cell": near.ravel()})

    placed = cut(points.mapInPandas(assign, f"id {kind}, v array<double>, cell int"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / LEAF).alias("parts"))
    leaf = F.pmod(F.xxhash64("id", "cell"), F.col("parts"))
    leaves = placed.join(F.broadcast(parts), "cell").groupBy("cell", leaf.alias("leaf")).agg(F.collect_list(F.struct("id", "v")).alias("of"))  # at most MOST_CELLS

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for of in frame["of"]:
                name, x = np.array([r["id"] for r in of]), np.array([r["v"] for r in of], float)
                m = min(width, len(x) - 1)
                if m:
                    rough = (x * x).sum(1) - 2 * x @ x.T
                    np.fill_diagonal(rough, np.inf)
                    cols = np.argpartition(rough, m - 1, axis=1)[:, :m].ravel()
                    rows = np.repeat(np.arange(len(x)), m)
                    yield pd.DataFrame({"src": name[rows], "dst": name[cols], "dist": np.sqrt(((x[rows] - x[cols]) ** 2).sum(1))})

    found = leaves.select("of").mapInPandas(best, f"src {kind}, dst {kind}, dist double")
    out = cut(_first(found.groupBy("src", "dst").agg(F.min("dist").alias("dist")), width))
    uncut(placed)
    return out


def improved(lists: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """(src, dst, dist, rank, fresh): ``lists`` after one round, ``fresh`` where a neighbour has come in.

    Each list is met by the vectors of its neighbours, ``width`` of them, and
    each pair of these is measured if one of the two was fresh. What is nearer than the last in
    the other's list is passed on, and so is the list's own vector.
    """
    import numpy as np
    import pandas as pd

    kind = points.schema["id"].dataType.simpleString()
    last = lists.groupBy("src").agg(F.when(F.count("*") >= width, F.max("dist")).otherwise(float("inf")).alias("last"))
    ends = points.join(last.withColumnRenamed("src", "id"), "id", "left").select(F.col("id").alias("dst"), "v", F.coalesce("last", F.lit(float("inf"))).alias("last"))
    met = lists.join(ends, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "dist", "fresh", "last", "v")).alias("near")).filter(F.exists("near", lambda x: x["fresh"]))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for u, near in zip(frame["src"], frame["near"], strict=True):
                name, v = np.array([x["dst"] for x in near]), np.array([x["v"] for x in near], float)
                fresh, limit = np.array([x["fresh"] for x in near]), np.array([x["last"] for x in near])
                own = np.array([x["dist"] for x in near])
                dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
                take = (fresh[:, None] | fresh[None]) & (dist <= limit[:, None] + 1e-9)
                np.fill_diagonal(take, False)
                rows, cols = np.nonzero(take)
                back = np.flatnonzero(fresh & (own <= limit + 1e-9))
                yield pd.DataFrame({"src": np.concatenate([name[rows], name[back]]), "dst": np.concatenate([name[cols], np.full(len(back), u, name.dtype)]), "dist": np.concatenate([dist[rows, cols], own[back]])})

    found = met.mapInPandas(pairs, f"src {kind}, dst {kind}, dist double")
    every = found.withColumn("old", F.lit(False)).unionByName(lists.select("src", "dst", "dist", F.lit(True).alias("old")))
    once = every.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("old").alias("old"))
    return _first(once, width).select("src", "dst", "dist", "rank", (~F.col("old")).alias("fresh"))


def measured(lists: DataFrame) -> int:
    """The pairs that ``improved`` measures for ``lists``."""
    n = lists.groupBy("src").agg(F.count("*").alias("n"), F.sum((~F.col("fresh")).cast("long")).alias("o"))
    return n.agg(F.sum(F.expr("n * (n - 1) / 2 - o * (o - 1) / 2"))).first()[0] or 0


def nearest_by_descent(df: DataFrame, k: int, width: int | None = None, probes: int = 6, rounds: int = 8, still: float = 0.01, vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(src, dst, dist, rank): nearly the ``k`` nearest other vectors of all vectors, ties by key.

    Lists of ``width`` neighbours (two and a half times ``k`` unless given) start from ``started`` and are improved in rounds, until less than the share ``still`` of their
    entries is new, or for ``rounds``. A round measures at most ``width``^2 / 2 pairs for each vector and moves
    ``width`` vectors for each. Tests measure the recall.

    Keys are not null and different. Vectors that are null or empty, or that hold
    null or non-finite numbers, or have another length than the least key's,
    have no neighbours and are nobody's. Equal vectors are one
    in the lists, however many; each then gets the least keys of its own copies and of its neighbours'.
    An empty table, or one of a single vector, gives no rows.
    """
    width = width or 5 * k // 2 + 1
    number = F.col(vec).cast("array<double>")
    fine = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(number, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    sound = cut(df.filter(fine).select(F.col(key).alias("id"), F.transform(number, lambda x: x + 0.0).alias("v")))
    whole = sound.filter(F.size("v") == (sound.agg(F.min_by(F.size("v"), "id")).first()[0] or 0))
    points = cut(whole.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    start = started(points, width, probes)
    lists = start.withColumn("fresh", F.lit(True))
    size = lists.count()
    for _ in range(rounds if size else 0):
        before, lists = lists, cut(improved(lists, points, width))
        uncut(before, start)
        if lists.filter("fresh").count() < still * size:
            break
    # copies: the least keys of each class stand for it
    named = cut(whole.join(points.withColumnRenamed("id", "rep"), "v").select("rep", "id"))
    least = cut(_first(named.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")), k + 1).select("src", "dst", "dist"))
    others = lists.select("src", F.col("dst").alias("rep"), "dist").join(least.select(F.col("src").alias("rep"), "dst"), "rep").select("src", "dst", "dist")
    best = _first(others.unionByName(least), k + 1).select(F.col("src").alias("rep"), "dst", "dist")
    out = cut(_first(named.select("rep", F.col("id").alias("src")).join(best, "rep").filter("src <> dst").select("src", "dst", "dist"), k))
    uncut(sound, points, start, lists, named, least)
    return out
